import pyarrow as pa
from pyspark.sql import functions as F

from concord.operators.aggregate import canonical_events
from concord.operators.observe import observations
from concord.operators.store import Store
from concord.plans import feeds as feeds_plans
from concord.sources import feeds, html, paged
from concord.streaming.accumulate import accumulate
from concord.streaming.inbox import watch

LISTING = """<table class="x views-table"><caption>Saturday, August 8, 2026</caption>
<tr><td>6:00 pm to 9:00 pm</td><td><a href="/e/1">Zoe @ Hall</a></td></tr><tr><td>7:00 pm</td><td>no link</td></tr>
<tr><td>late</td><td><a href="https://o.example/2">Max &amp; Co</a></td></tr><tr><td>x</td><td><a href="/3">%s</a></td></tr></table>
<table class="views-table"><caption>Someday</caption><tr><td>1:00 pm</td><td><a href="/4">No date</a></td></tr></table>""" % ("long " * 40)
DETAIL = """<h1>Live Music @ Crackings</h1><div>When: Saturday, August 8, 2026<br>Time: 5:00 pm to 8:00 pm<br>Where: The Barn<br></div><p>When: x</p><p>With Zoe Blue &amp; friends.</p>
<table><tr><td>July 4</td><td>7:00 pm</td><td>featuring Max Gray</td></tr><tr><td>Karaoke</td><td>July 5</td></tr><tr><td>one cell</td></tr></table>
<div class="view-date-calendar-lists"><table class="views-table"><caption>8/9/2026</caption><tr><td>1:00 pm</td><td><a href="/w">Widget</a></td></tr></table></div>"""
SECTION = """<section id="s1"><var class="atc_event"><var class="atc_title">Live Music: Zoe Blue</var><var class="atc_date_start">2026-07-19 17:00:00</var><var class="atc_date_end">2026-07-19 20:30:00</var></var></section>
<section id="s2"><var class="atc_event"><var class="atc_title">Happy Hour</var><var class="atc_date_start">2026-07-19 17:00:00</var></var></section><section id="s3">none</section>"""


def pages(spark):
    return spark.createDataFrame([(1, LISTING), (2, DETAIL), (3, SECTION), (4, None), (5, "<table><tr><td>open")], "page_id long, html string")


def test_calendar(spark):
    parts = html.parts(pages(spark)).cache()
    got = sorted(((r.date, r.time_start, r.time_end, r.title, r.url) for r in html.calendar_rows(parts, "https://h.example").filter("page_id = 1").collect()), key=str)
    assert got == [("2026-08-08", "6:00 pm", "9:00 pm", "Zoe @ Hall", "https://h.example/e/1"), ("2026-08-08", None, None, "Max & Co", "https://o.example/2")]
    assert [r.title for r in html.calendar_rows(parts, "").filter("in_widget").collect()] == ["Widget"]


def test_lineup_and_detail(spark):
    parts = html.parts(pages(spark)).cache()
    rows = html.lineup_rows(parts.filter("page_id = 2"), 2026).orderBy("row").collect()
    assert [(r.performer, r.date, r.time_start, r.resolved) for r in rows] == [("Max Gray", "2026-07-04", "7:00 pm", True), (None, "2026-07-05", None, False)]
    page = {r.page_id: r for r in html.detail_pages(parts).collect()}[2]
    assert (page.title, page.venue, page.date, page.time_start, page.time_end) == ("Live Music @ Crackings", "The Barn", "2026-08-08", "5:00 pm", "8:00 pm")
    assert page.performer == "Zoe Blue" and page.extraction_method == "description"


def test_a_page_gives_its_year_and_its_widget(spark):
    page = """<h1>Old House Nights</h1><p>When: Wednesday, July 15, 2026</p><p>Where: Old House</p><table><tr><td>July 22</td><td>Zoe Blue</td></tr><tr><td>July 29</td><td>Max Red</td></tr></table>
<div class="view-date-calendar-lists"><table class="views-table"><caption>August 5, 2026</caption><tr><td>6:00 pm</td><td><a href="/8">Jake &amp; Aimee @ Old House</a></td></tr></table>
<table class="views-table"><caption>July 15, 2026</caption><tr><td>6:00 pm</td><td><a href="/7">Own @ Old House</a></td></tr></table>
<table class="views-table"><caption>August 6, 2026</caption><tr><td>6:00 pm</td><td><a href="/9">Old House Nights</a></td></tr></table></div>"""
    other = page.replace("2026", "2025").replace("<h1>Old House Nights</h1>", "")
    pages = spark.createDataFrame([(1, page), (2, other), (3, None)], "page_id long, html string")
    found = html.page_observations(html.page_parts(pages), "https://h.example").orderBy("page_id", "at").collect()
    assert [(r.page_id, r.performer, r.venue, r.date, r.url) for r in found] == [
        (i, *row) for i, y in ((1, 2026), (2, 2025))
        for row in (("Zoe Blue", "Old House", f"{y}-07-22", None), ("Max Red", "Old House", f"{y}-07-29", None), ("Jake & Aimee", "Old House", f"{y}-08-05", "https://h.example/8"))
    ]


def test_sections(spark):
    got = html.section_events(html.parts(pages(spark)), "The Deck", "https://d.example", "deck").collect()
    assert [(r.performer, r.date, r.time_start, r.time_end, r.url) for r in got] == [("Zoe Blue", "2026-07-19", "5:00 pm", "8:30 pm", "https://d.example#s1")]


def test_discovery_and_enrichment(spark):
    listing = spark.createDataFrame([(1, 1, "2026-08-09", "Live Music", "u2"), (1, 0, "2026-08-08", " live music", "u1"), (1, 2, "2026-08-08", "Other", "u3")], "page_id long, row int, date string, title string, url string")
    tracked = spark.createDataFrame([("Live Music ",)], "title string")
    assert [(r.k, r.url) for r in html.discover(listing, tracked).collect()] == [("live music", "u1")]
    details = spark.createDataFrame([("Live Music", "The Barn", "with Zoe Blue")], "title string, venue string, description string")
    got = {r.url: r for r in html.enriched(listing, details).collect()}
    assert (got["u2"].venue, got["u2"].performer) == ("The Barn", "Zoe Blue") and (got["u3"].venue, got["u3"].performer) == (None, "Other")


def test_calendar_feed(spark):
    text = "BEGIN:VEVENT\nSUMMARY:One\nSUMMARY:Two\\, Inc\nDTSTART:20260113T010000Z\nURL:https://x.example\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:Local\nDTSTART:20260113T010000\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:cut"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "feed_id long, text string")
    got = feeds.ics_events(rows, "Gulley", "gulley").collect()
    assert [(r.performer, r.date, r.time_start, r.time_end, r.url, r.name) for r in got] == [("Two, Inc", "2026-01-12", "7:00 pm", None, "https://x.example", "Two, Inc at Gulley")]


def test_json_pages(spark):
    page = '{"events": [{"summary": "Live Music", "timezoneStart": "2026-07-19T16:00:00", "longDescription": "<b>2026 LINEUP</b> \U0001f3b6 July 19 - Zoe Blue"}, {"summary": "Live Music", "timezoneStart": "2026-07-20T16:00:00"}, {"summary": "Max", "timezoneStart": "2026-07-21T00:30:00"}]}'
    got = feeds.json_events(spark.createDataFrame([(1, page), (2, "not json"), (3, None)], "page_no long, payload string"), "Bay", "bay").orderBy("row").collect()
    assert [(r.performer, r.date, r.time_start) for r in got] == [("Zoe Blue", "2026-07-19", "4:00 pm"), ("Max", "2026-07-21", "12:30 am")]
    store = {"a": {"pages": {"nextPage": "b"}}, "b": {"pages": {"nextPage": "c"}}, "c": None}
    assert len(feeds.follow_pages(store.get, "a")) == 2 and len(feeds.follow_pages(lambda u: {"pages": {"nextPage": u}}, "a")) == 8


def test_rosters_and_registry(spark, tmp_path):
    (tmp_path / "a.csv").write_text("performer,favorite\nZoe,Y\n,N\nMax,N\n")
    assert [(r.ord, r.performer, r.favorite) for r in feeds.roster(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()] == [(1, "Zoe", "Y"), (3, "Max", "N")]
    (tmp_path / "b.csv").write_text('performer,favorite\n"Zoe, Max",Y\n')
    assert [(r.ord, r.performer, r.favorite) for r in feeds.roster(spark, str(tmp_path / "b.csv")).collect()] == [(1, "Zoe, Max", "Y")]
    registry, failed = feeds.Registry(), []
    registry.add("late", lambda s: s.createDataFrame([("x",)], "performer string").withColumn("ord", F.raise_error(F.lit("late")).cast("int")))
    registry.add("one", lambda s: s.createDataFrame([("Zoe", 1)], "performer string, ord int"))
    registry.add("bad", lambda s: 1 / 0)
    registry.add("two", lambda s: s.createDataFrame([("Max", "u")], "performer string, url string"))
    rows = registry.fetch_all(spark, lambda name, error: failed.append(name))
    assert sorted(((r.performer, r.url) for r in rows.collect())) == [("Max", "u"), ("Zoe", None)]
    assert failed == ["late", "bad"] and feeds.Registry().fetch_all(spark) is None
    assert feeds.limited(rows, 1).count() == 1 and feeds.limited(rows, None).count() == 2


def test_status_filter(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "named", True), (3, "named", None), (4, "category", False)], "id int, performer_status string, resolved boolean")
    assert [r.id for r in feeds.admitted(rows).orderBy("id").collect()] == [1, 2]


def test_stream_restarts(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Act {i % 3}", "Hall", "2026-08-08", "crawler") for i in range(12)], "id long, performer string, venue string, date string, source string")
    rows.repartition(4, "id").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    accumulate(stream(), store, str(tmp_path / "p")).awaitTermination()
    first = store.version()
    assert first >= 1 and store.read("events").count() == 3
    accumulate(stream(), store, str(tmp_path / "p")).awaitTermination()
    assert store.version() == first
    rows.limit(1).withColumn("performer", F.lit("New")).write.mode("append").parquet(str(tmp_path / "in"))
    accumulate(stream(), store, str(tmp_path / "p")).awaitTermination()
    assert store.read("events").count() == 4


def test_stream_by_id_gives_the_events_of_one_batch(spark, tmp_path):
    says = [(1, "6 pm", "venue", 0.1), (2, "7 pm", "seed", 1.0), (3, "6 pm", "venue", 1.0), (4, "7 pm", "venue", 0.1), (5, "7 pm", "seed", 0.9)]
    rows = spark.createDataFrame([(i, "Zoe", "Hall", "2026-08-08", t, s, c) for i, t, s, c in says], "id long, performer string, venue string, date string, time_start string, source string, model_confidence double")
    store = Store(spark, str(tmp_path / "store"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for ids in ("id <= 2", "id = 3", "id > 3", "id = 3"):
        rows.filter(ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        accumulate(stream(), store, str(tmp_path / "p"), by_id=True).awaitTermination()
    shown = ["id", "source", "time_start", "confidence", "verification_count", "source_count", "observation_count"]
    assert store.read("events").select(shown).collect() == canonical_events(observations(rows)).select(shown).collect()


def test_paged_feeds(spark):
    def fetch(url):
        name, _, n = url.partition("/")
        if name == "bad" and n == "2":
            raise OSError("gone")
        if name == "odd":
            return ["no page"]
        return {"events": [{"summary": f"Act {name}{n}", "timezoneStart": "2026-07-19T16:00:00"}], "pages": {"nextPage": f"{name}/{int(n) + 1}" if name != "one" else None}}

    pages = paged.paged(spark, {"one": "one/0", "many": "many/0", "bad": "bad/0", "odd": "odd/0"}, fetch)
    assert pages.rdd.getNumPartitions() == 4
    found = feeds.json_events(pages, "Bay", "bay", id_col="feed").groupBy("feed").count().collect()
    assert {r.feed: r["count"] for r in found} == {"one": 1, "many": paged.MOST_PAGES, "bad": 2}


def test_inbox_is_watched_by_one_run(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name in ("a.png", "b.jpg", "c.txt"):
        (box / name).write_bytes(name.encode())

    def read(file, content):
        if file == "b.jpg":
            raise ValueError("dark")
        return '[{"artist": "Zoe %s", "venue": "Hall", "date": "2026-08-08", "confidence": 0.9}]' % file[0]

    store = Store(spark, str(tmp_path / "s"))
    run = lambda owner: watch(spark, str(box), read, store, str(tmp_path / "p"), "2026-08-01", str(tmp_path / "done"), str(tmp_path / "bad"), owner)
    with store.lease("other"):
        assert run("me") is None and (box / "a.png").exists()
    assert run("me") == 2 and run("me") == 0
    (box / "d.png").write_bytes(b"d")
    assert run("me") == 1 and sorted(r.performer for r in store.read("events").collect()) == ["Zoe a", "Zoe d"]
    assert sorted(x.name for x in (tmp_path / "done").iterdir() if not x.name.startswith(".")) == ["a.png", "d.png"] and (tmp_path / "bad" / "b.jpg").exists() and (box / "c.txt").exists()


def test_small_curated_pages_are_handed_back_together(spark, monkeypatch):
    made = {}
    frame = type(spark.range(1))
    kept = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, ddl, *a: made.update(f=f) or kept(self, f, ddl, *a))
    page = '<table><tbody id="tb"><tr data-date="2026-01-01" data-venue="Hall" data-performer="A"><td>x</td></tr></tbody></table>'
    html.curated_rows(spark.createDataFrame([(1, page)], "page_id long, html string"))
    batch = pa.record_batch({"id": pa.array(range(50), pa.int64()), "html": pa.array([page, None, ""] * 16 + [page] * 2)})
    out = list(made["f"](iter([batch])))
    assert len(out) == 1 and out[0].column("id").to_pylist() == [i for i in range(50) if i % 3 == 0 or i >= 48]


def test_non_music_filter_reads_its_table_once(spark):
    from concord.plans import catalogue

    plan = catalogue.QUERIES["non_music_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


PLAIN_PAGES = [
    "", "text only &amp; more", "a &lt b", "<h1>A &#233; B</h1><p>x<br>y<br/>z</p>", "<DIV Class='view-date-calendar-lists' hidden><table class=\"views-table\"><tr><td>1</td><td><a href='/w'>n</a></td></tr></table></DIV>",
    "<td></td></p><tr><td>x", '<img class="a b" src="/f/1.jpg"><section id="s"><var class="atc_event">1</var></section>',
]
ODD_PAGES = ["a < b <p>c</p>", "<script>if (a<b) {}</script><p>x</p>", "<title>a<b>c</title>", '<a href="?a=1&amp;b=2">x</a>', "<!-- c --><p>x</p>", "<p a=b>x</p>", '<p a="1"b="2">x</p>', "</p x>y", "x\r\ny\0", "<p", "<!doctype html><p>x", "x <", "&amp", "<br / >"]


def test_plain_pages_give_what_the_parser_gives():
    def fed(page):
        parser = html.Parts()
        parser.feed(page)
        parser.close()
        parser.end_row()
        return parser.rows, parser.everything

    for page in PLAIN_PAGES + ODD_PAGES:
        parser = html.Parts()
        plain = html.plainly(parser, page)
        assert plain == (page in PLAIN_PAGES or page == "&amp"), page
        if plain:
            parser.end_row()
            assert (parser.rows, parser.everything) == fed(page), page
        assert html.parts_of(page)[:-1] == fed(page)[0]


def test_pages_made_of_one_split_are_parsed_by_many_tasks(spark, tmp_path):
    import datetime

    from concord.plans import catalogue

    spark.createDataFrame([(i, i % 7, datetime.date(1996, 1, 1 + i % 28)) for i in range(200)], "o_orderkey long, o_custkey long, o_orderdate date").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("html_rows", "curated_listing"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_only_pages_that_show_a_flyer_meet_what_was_read(spark, monkeypatch):
    # The join with a reader's rows shuffled every page with all its parts once these were too many to broadcast.
    given = []
    monkeypatch.setattr(html, "page_observations", lambda pages, host, flyers=None, *a, keep=html.page_observations, **k: given.append((pages, flyers)) or keep(pages, host, flyers, *a, **k))
    feeds_plans.page_observations(spark, "/root/testdata/sf0.001")
    images = {r.o_orderkey for pages, flyers in given if flyers is not None for r in pages.select("o_orderkey").collect()}
    others = {r.o_orderkey for pages, flyers in given if flyers is None for r in pages.select("o_orderkey").collect()}
    assert images and others and all(k % 10 == 9 for k in images) and not any(k % 10 == 9 for k in others)
