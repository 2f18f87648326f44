from pyspark.sql import functions as F

from concord.operators import changes, dashboard
from concord.operators.aggregate import canonical_events
from concord.operators.observe import observations
from concord.sources import feeds, html

EVENT = "id long, performer string, venue string, date string, time_start string, source string, url string, observed_at string"


def test_rows_of_the_dashboard(spark):
    raw = spark.createDataFrame([(1, "Zoe", "Papa Surf", "2026-08-08", "6 pm", "venue", None, "2026-08-01 x"), (2, "Max", "AJ's Grayton", "2026-08-07", "6 - 9 pm", "seed", "u", None), (3, "Ann", None, "2026-08-09", None, None, None, None)], EVENT)
    obs = observations(raw)
    venues, people = spark.createDataFrame([(" papa SURF",), ("",)], "venue string"), spark.createDataFrame([("zoe", "N", 0), ("Zoe ", "Y", 1)], "performer string, favorite string, ord int")
    max_, zoe, ann = dashboard.dashboard_rows(canonical_events(obs), obs, venues, people).collect()
    assert (zoe.venue_class, zoe.favorite, zoe.performer_favorite, zoe.url, zoe.time_shown) == ("vt-ps", "Y", "Y", "https://instagram.com/papasurfburgerbar", "6:00 PM")
    assert (max_.external, max_.url, max_.favorite, max_.time_shown) == ("https://www.google.com/maps/search/?api=1&query=AJ%27s+Grayton+Beach%2C+FL", "u", "N", "6:00 PM - 9:00 PM")
    assert (ann.embed, ann.venue, ann.venue_class, ann.url, ann.time_shown) == (None, "", "vt-def", "", "") and zoe.said[0].seen == "2026-08-01"


def test_form_encoding(spark):
    from urllib.parse import quote_plus

    texts = ["a b&c", "~*-_.", "é/ü?", "100%", "it's"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(dashboard.form_encoded(F.col("t")).alias("q")).collect()
    assert [r.q for r in got] == [quote_plus(t) for t in texts]


def test_report_and_summary(spark):
    made = lambda *names: canonical_events(observations(spark.createDataFrame([(i, n, "Hall", "2026-08-08", "6 pm", "seed", None, None) for i, n in enumerate(names)], EVENT)))
    found = changes.compare_runs(made("A", "B"), made("B", "C"))
    sheets = dashboard.report(made("A", "B"), found, "2026-08-09")
    assert sheets["All Events"].count() == 2 and sheets["Upcoming"].count() == 0 and [r.performer for r in sheets["Changes: new"].collect()] == ["A"]
    assert dashboard.run_summary({"Events saved": 2}, found) == ["Events saved: 2", "1 new, 0 changed, 1 removed", "A @ Hall  2026-08-08 6:00 PM"]
    assert dashboard.run_summary({}, changes.compare_runs(made("A"), made("A"))) == ["No changes since last run."]


def test_image_inbox(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name in ("a.png", "b.JPG", "c.txt"):
        (box / name).write_bytes(name.encode())

    def read(file, content):
        if file == "b.JPG":
            raise ValueError("dark")
        return content.decode()

    results = feeds.read_images(feeds.inbox(spark, str(box)), read).cache()
    assert sorted(map(tuple, results.collect()), key=str) == [("a.png", "a.png", None), ("b.JPG", None, "ValueError: dark")]
    feeds.settle(results, str(box), str(tmp_path / "done"), str(tmp_path / "bad"))
    assert not (box / "a.png").exists() and (tmp_path / "done" / "a.png").exists() and (tmp_path / "bad" / "b.JPG").exists() and (box / "c.txt").exists()
    assert [feeds.importer(*x) for x in ((None, True, True), (None, False, True), ("OCR", True, False), (None, False, False), ("vision", False, False))] == ["vision", "ocr", "ocr", None, "vision"]


def test_pages_with_several_observations(spark):
    lineup = "<h1>Series</h1><p>Where: Hall</p><p>When: July 1, 2026</p><table><tr><td>July 8</td><td>7:00 pm</td><td>Zoe Blue</td></tr><tr><td>July 15</td><td>7:00 pm</td><td>Max Red</td></tr></table>"
    prose = "<h1>Summer Sounds</h1><p>When: July 1, 2026</p><p>Time: 6:00 pm to 9:00 pm</p><p>July 1: Zoe Blue July 8: TBA</p>"
    plain = "<h1>Zoe Blue at The Hall</h1><p>When: July 1, 2026</p>"
    pages = spark.createDataFrame([(1, lineup), (2, prose), (3, plain), (4, ""), (5, None)], "page_id long, html string")
    found = html.page_observations(html.page_parts(pages), "https://h.example").cache()
    got = {i: [(r.date, r.performer) for r in sorted(found.filter(F.col("page_id") == i).collect(), key=lambda r: r.at)] for i in range(1, 6)}
    assert got[1] == [("2026-07-08", "Zoe Blue"), ("2026-07-15", "Max Red")]
    assert got[2] == [("2026-07-01", "Zoe Blue"), ("2026-07-08", None)]
    assert [d for d, _ in got[3]] == ["2026-07-01"] and got[4] == [] and got[5] == []
    assert {r.page_id for r in html.first_observation(found).collect()} == {1, 2, 3}
