import pytest
from pyspark.sql import functions as F

from concord.operators import changes, featured, rules, store
from concord.operators.aggregate import canonical_events, health, with_observations
from concord.operators.observe import RAW, observations
from concord.plans.view import observed
from concord.sources import legacy

SCHEMA = "id long, performer string, venue string, date string, time_start string, stage string, url string, source string, model_confidence double, observed_at string"


def raw(spark, *rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    made = [{"id": i + 1, "performer": "Zoe", "venue": "Hall", "date": "2026-08-08", "source": "crawler"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in made], SCHEMA)


def canonical(spark, *rows):
    return canonical_events(observations(raw(spark, *rows)))


def test_observation_rules(spark):
    rows = raw(spark, {"performer": "  "}, {"date": "someday"}, {"date": None}, {"performer": "Zoe at hall", "time_start": "18:00-21:00"}, {"performer": "COCONUT RADIO", "venue": None, "source": None}, {"performer": "Zoe", "venue": "papasurf"}, {"date": "2026-02-30"})
    got = {r.id: r for r in observations(rows).collect()}
    assert set(got) == {4, 5, 6, 7}
    assert (got[4].performer, got[4].time_start, got[4].time_end, got[4].name) == ("Zoe", "6:00 PM", "9:00 PM", "Zoe at Hall")
    assert (got[5].performer, got[5].source, got[5].name, got[5].observation_type) == ("Coconut Radio", "crawler", "Coconut Radio", "website")
    assert (got[6].venue, got[6].time_start, got[6].time_end) == ("Papa Surf", "6:00 PM", "9:00 PM")
    assert got[4].confidence == 0.9 and got[7].extraction_confidence == 0.75
    assert set(RAW) >= {"name", "time_end"}


def test_no_spelling_is_made_twice(spark):
    plan = observed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Spellings fold capitals word by word, by a lambda; the filter at the bottom is none of their readers.
    assert "Filter" in plan and "lambda" not in plan[plan.index("Filter") :] and plan.count("get_json_object") == 1


def test_agreement_and_conflict(spark):
    one = canonical(spark, {"time_start": "6 pm"}, {"time_start": "6:00 - 9:00 PM", "source": "venue"}).first()
    assert (one.source_count, one.verification_count, one.conflict_flag, one.confidence_reason, one.source) == (2, 2, 0, "2 sources agree", "venue")
    assert one.time_end == "9:00 PM"
    two = canonical(spark, {"time_start": "6 pm"}, {"time_start": "7 pm", "source": "venue"}).first()
    assert (two.conflict_flag, two.conflict_reason, two.verification_count) == (1, "Time mismatch: 6:00 PM vs 7:00 PM", 1)
    stage = canonical(spark, {"time_start": "6 pm", "stage": "Main"}, {"time_start": "6 pm", "stage": " patio", "source": "venue"}).first()
    assert stage.conflict_reason == "Source conflict"
    assert canonical(spark, {}).first().confidence_reason == "single source (crawler)"


def test_gaps_are_filled_and_ties_go_to_the_latest(spark):
    got = canonical(spark, {"source": "venue", "time_start": "6 pm"}, {"stage": "Main", "url": "u1"}, {"source": "seed", "url": "u2", "stage": "Lawn"}).first()
    assert (got.time_start, got.stage, got.url) == ("6:00 PM", "Main", "u1")
    tie = canonical(spark, {"time_start": "6 pm", "observed_at": "2026-01-01"}, {"time_start": "7 pm", "observed_at": "2026-01-02"}, {"time_start": "8 pm", "observed_at": "2026-01-02"}).first()
    assert tie.time_start == "7:00 PM"


def test_order_of_rows_does_not_matter(spark):
    rows = [{"source": s, "time_start": t, "stage": g} for s in ("venue", "seed", "ocr:1") for t in ("6 pm", "7 pm") for g in (None, "Main")]
    a = canonical(spark, *[r | {"id": i} for i, r in enumerate(rows)]).collect()
    b = canonical(spark, *[r | {"id": i} for i, r in reversed(list(enumerate(rows)))]).collect()
    assert a == b


def test_site_over_aggregator(spark):
    obs = observations(raw(spark, {"performer": "A", "source": "aggregator", "time_start": "6 pm"}, {"performer": "B", "source": "venue", "time_start": "6 pm"}, {"performer": "C", "source": "aggregator", "time_start": "7 pm"}, {"performer": "D", "source": "aggregator", "time_start": "7 pm"}, {"performer": "E", "source": "aggregator", "time_start": "6 pm", "venue": "Barn"}, {"performer": "F", "source": "aggregator"}, {"performer": "G"}))
    events = canonical_events(obs)
    gone = lambda e: {r.performer for r in rules.site_over_aggregator(e, obs).filter("drop").collect()}
    assert gone(events) == {"A"}
    assert gone(events.filter("performer != 'A'")) == set()


def test_schedule_anomalies(spark):
    events = canonical(spark, {"performer": "A", "time_start": "6 pm"}, {"performer": "B", "time_start": "6 pm"}, {"performer": "C", "time_start": "6 pm", "stage": "Lawn"}, {"performer": "D", "time_start": "6 pm", "date": "2026-09-01"}, {"performer": "E", "time_start": "6 pm", "date": "2026-09-01", "stage": "x"})
    assert [(r.venue, r.date, r.performers) for r in rules.same_night_collisions(events).collect()] == [("Hall", "2026-08-08", ["A", "B"])]
    dates = {"A": ["2026-08-03", "2026-08-09", "2026-08-10"], "B": ["2026-08-03", "2026-08-10", "2026-08-17"], "C": ["2026-08-03", "2026-09-18"]}
    events = canonical(spark, *[{"performer": p, "date": d} for p, ds in dates.items() for d in ds])
    assert [(r.performer, r.dates) for r in rules.irregular_recurrences(events).collect()] == [("A", dates["A"])]


def test_purges_and_renames(spark):
    events = spark.createDataFrame([(1, "A", "Hall", "2026-01-01"), (2, "A", "Hall", None), (3, "A", "Hall", ""), (4, "Farmers Market", "Hall", "2027-01-01"), (5, "A", "northbeachsocial", "2027-01-01"), (6, "A", "North Beach Social", "2027-01-01")], "id long, performer string, venue string, date string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(rules.not_past(events, "2026-06-01")) == [2, 4, 5, 6]
    assert ids(rules.dated(events)) == [1, 4, 5, 6]
    assert 4 not in ids(rules.only_music(events))
    moved = {r.id: r for r in rules.renamed(events, "venue").collect()}
    assert moved[5].renamed and not moved[5].merged and moved[6].merged and moved[6].survivor == 5
    obs = observations(raw(spark, {"performer": "A", "source": "seed"}, {"performer": "B", "source": "seed"}, {"performer": "B"}))
    left, kept = rules.purge_source(canonical_events(obs), obs, "seed")
    assert [r.performer for r in left.collect()] == ["B"] and kept.count() == 1


def test_finalize_twice_changes_nothing(spark):
    obs = observations(raw(spark, {"performer": "A", "time_start": "6 pm"}, {"performer": "B", "source": "venue", "time_start": "6 pm"}, {"performer": "C", "venue": "redfishtaco", "url": "u", "observed_at": "1"}, {"performer": "D", "venue": "Red Fish Taco", "url": "u", "observed_at": "2"}, {"performer": "5k Run"}))
    once, left = rules.finalize(canonical_events(obs), obs, "2026-01-01", "crawler")
    once, left = once.cache(), left.cache()
    names = sorted(r.performer for r in once.collect())
    assert names == ["B", "D"]
    twice, _ = rules.finalize(once, left, "2026-01-01", "crawler")
    assert sorted(r.performer for r in twice.collect()) == names


def test_run_differences(spark):
    old = canonical(spark, {"performer": "A", "time_start": "6 pm"}, {"performer": "B"}, {"performer": "C"})
    new = canonical(spark, {"performer": "A", "time_start": "7 pm"}, {"performer": "B", "source": "venue"}, {"performer": "D"})
    found = changes.compare_runs(new, old)
    assert {r.identity_key.split("|")[0]: r.status for r in found.collect()} == {"a": "changed", "b": "unchanged", "c": "removed", "d": "new"}
    assert changes.change_summary(found).first().asDict() == {"new": 1, "changed": 1, "removed": 1, "unchanged": 1, "total_delta": 2}
    lines = changes.log_text(changes.changelog(found), changes.change_summary(found), "r1", "now").orderBy("place").collect()
    text = "\n".join(r.line for r in lines)
    assert [r.line for r in lines if r.line.endswith(":")] == ["New (1):", "Changed (1):", "Removed (1):"] and text.startswith("Changelog: r1\nRecorded: now\n+")
    assert "+1 new  ~1 changed  -1 removed  1 unchanged" in text and "      time_start: '6:00 PM' -> '7:00 PM'" in text and "  · D @ Hall  2026-08-08" in text


def test_changelog_files(spark, tmp_path):
    same = changes.compare_runs(canonical(spark, {}), canonical(spark, {}))
    assert not changes.write_changelog(same, str(tmp_path), "r0", "now")
    some = changes.compare_runs(canonical(spark, {}), canonical(spark, {"performer": "Old"}))
    for run in ("r1", "r2"):
        assert changes.write_changelog(some, str(tmp_path), run, "now")
    assert {r.run_id for r in changes.latest_changelog(spark, str(tmp_path)).collect()} == {"r2"}
    assert [tuple(r) for r in changes.changelogs(spark, str(tmp_path)).collect()] == [("r1", 1, 0, 1), ("r2", 1, 0, 1)]
    assert changes.changelog_of(spark, str(tmp_path), "r1").count() == 2 and changes.changelog_of(spark, str(tmp_path), "r9").count() == 0
    text = [r.line for r in changes.shown_changelog(spark, str(tmp_path), "r2").collect()]
    assert text == spark.read.text(str(tmp_path / "latest.txt")).toPandas()["value"].tolist() and any("+1 new" in x for x in text)
    (tmp_path / "r1.json").rename(tmp_path / "r1.gone")
    assert {r.run_id for r in changes.latest_changelog(spark, str(tmp_path)).collect()} == {"r2"}  # other runs are not read
    lines = spark.createDataFrame([("a\nb\r\t\\",)], "v string").select(changes.quoted(F.col("v")).alias("q"))
    assert [r.q for r in lines.collect()] == [repr("a\nb\r\t\\")]
    shown = spark.createDataFrame([("a'b",), ("a'b\"c",), (None,), ("x",)], "v string").select(changes.quoted(F.col("v")).alias("q"))
    assert [r.q for r in shown.collect()] == [repr(v) for v in ("a'b", "a'b\"c", None, "x")]


def test_store_accumulates(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.version() == 0 and s.read("events") is None
    batch = lambda *rows: observations(raw(spark, *rows))
    assert s.upsert(batch({"time_start": "6 pm", "url": "u"}, {"time_start": "6 pm", "id": 2}), "r1") == {"new": 1, "changed": 0, "unchanged": 0}
    assert s.read("observations").count() == 2  # a new identity keeps equal rows
    assert s.upsert(batch({"id": 10, "time_start": "6 pm", "observed_at": "later"}), "r2") == {"new": 0, "changed": 0, "unchanged": 1}
    assert s.read("observations").count() == 2 and {r.observed_at for r in s.read("observations").collect()} == {"later"}
    assert s.upsert(batch({"id": 11, "source": "venue", "time_start": "7 pm"}, {"id": 12, "performer": "New"}), "r3") == {"new": 1, "changed": 1, "unchanged": 0}
    events = {r.performer: r for r in s.read("events").collect()}
    assert events["Zoe"].id == 1 and events["Zoe"].time_start == "7:00 PM" and events["Zoe"].source_count == 2 and events["Zoe"].url == "u"
    assert s.version() == 3 and events["New"].run_id == "r3"


def test_runs_and_migrations(spark):
    runs = spark.createDataFrame([(1, "a", "t", 5), (2, "b", "t", 6)], "id long, run_id string, started_at string, events_saved int")
    again = store.record_run(runs, "a", "t2", 9)
    assert sorted(tuple(r) for r in again.collect()) == [(2, "b", "t", 6), (3, "a", "t2", 9)]
    assert store.previous_run(again).first().run_id == "b" and store.previous_run(again.limit(1)).count() == 0
    events = spark.createDataFrame([(1, "A", "Hall", "2026-01-01", "6:00 PM", "seed"), (2, "a ", "hall", "2026-01-01", "7:00 PM", "image:x"), (3, "B", "Hall", "2026-01-01", None, "crawler")], "id long, performer string, venue string, date string, time_start string, source string")
    seen = spark.createDataFrame([(1, 1, "seed", 0.6, "c1", "2026"), (2, 2, "image:x", 0.8, "c2", "2026"), (3, 2, "image:x", 0.8, "c2", "2026")], "id long, event_id long, source string, confidence double, checksum string, observed_at string")
    new, version = store.migrate(spark, {"events": events, "event_sources": seen})
    got = {r.id: r for r in new["events"].collect()}
    assert version == 6 and set(got) == {1, 3} and set(new) == {"events", "runs", "observations"}
    assert (got[1].source_count, got[1].conflict_flag, got[1].confidence_reason) == (2, 1, "2 sources, conflict: Time mismatch: 6:00 PM vs 7:00 PM")
    assert (got[3].confidence, got[3].confidence_reason, got[3].run_id, got[3].identity_key) == (0.9, "backfilled at v2 migration from source trust", "legacy", "b|hall|2026-01-01")
    assert sorted((r.id, r.event_id, r.time_start, r.observation_type) for r in new["observations"].collect()) == [(1, 1, "6:00 PM", "manual"), (2, 1, "7:00 PM", "image")]
    again, _ = store.migrate(spark, new)
    assert all(sorted(map(str, again[t].select(new[t].columns).collect())) == sorted(map(str, new[t].collect())) for t in new)


def test_store_keeps_its_schema_version_and_few_old_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), keep=2)
    s.commit(events=spark.createDataFrame([(1, "A", "Hall", "2026-01-01", "seed")], "id long, performer string, venue string, date string, source string"))
    assert s.schema() == 0 and s.migrate() == 6 and s.schema() == 6 and s.read("observations").count() == 0
    version = s.version()
    assert s.migrate() == 6 and s.version() == version
    t = store.Store(spark, str(tmp_path / "t"), keep=2)
    for i in range(4):
        t.upsert(observations(raw(spark, {"id": i, "performer": f"P{i}", "date": f"2026-01-0{i + 1}"})), f"r{i}", before="2026-01-02")
    assert t.schema() == 6 and sorted(t.numbers("_versions")) == [3, 4] and t.names(1) == []
    assert sorted(r.performer for r in t.read("events").collect()) == ["P1", "P2", "P3"] and t.read("observations").count() == 3


def test_an_upsert_writes_the_parts_of_its_identities_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), keep=5, buckets=4)
    batch = lambda *rows: observations(raw(spark, *rows))
    s.upsert(batch(*[{"id": i, "performer": f"P{i}", "date": f"2026-0{1 + i % 3}-05"} for i in range(60)]), "r1")
    first = s.manifest(1)["tables"]["events"]["parts"]
    assert len(first) == 12
    assert s.upsert(batch({"id": 100, "performer": "P0", "date": "2026-01-05", "source": "venue"}), "r2") == {"new": 0, "changed": 0, "unchanged": 1}
    second = s.manifest(2)["tables"]["events"]["parts"]
    assert set(second) == set(first) and sum(second[p] != first[p] for p in first) == 1
    assert s.read("events").count() == 60 and s.read("events").filter("run_id = 'r2'").count() == 1 and s.load_events("r2").first().source_count == 2
    assert [r.date for r in s.load_events().collect()] == sorted(f"2026-0{1 + i % 3}-05" for i in range(60))
    assert s.read("events", version=1).filter("source_count = 2").count() == 0


def test_expiry_drops_months_unread_and_splits_the_last(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), keep=1, buckets=2)
    batch = lambda *rows: observations(raw(spark, *rows))
    s.upsert(batch(*[{"id": i, "performer": f"P{i}", "date": f"2026-0{1 + i % 3}-{5 + i // 3:02d}"} for i in range(30)]), "r1")
    old = {p: f for p, f in s.manifest(1)["tables"]["events"]["parts"].items() if "2026-01" in p}
    for part, folder in old.items():  # what expires is not read: it may even be damaged
        for file in (tmp_path / "s" / "events" / folder / part).glob("*.parquet"):
            file.write_bytes(b"damaged")
    s.upsert(batch({"id": 200, "performer": "New", "date": "2026-03-09"}, {"id": 201, "performer": "Late", "date": "2026-01-31"}), "r2", before="2026-02-08")
    found = s.read("events")
    assert found.agg(F.min("date")).first()[0] == "2026-02-08" and found.count() == 10 + 7 + 1
    assert s.read("observations").count() == 18 and s.read("observations").join(found, "identity_key", "left_anti").count() == 0
    assert all("2026-01" not in p for t in s.manifest(2)["tables"].values() for p in t["parts"])
    assert not [f for f in (tmp_path / "s" / "events").rglob("*.parquet") if "2026-01" in str(f)]


def test_of_two_writers_one_begins_again(spark, tmp_path):
    one, two = (store.Store(spark, str(tmp_path / "s"), buckets=2) for _ in range(2))
    batch = lambda *rows: observations(raw(spark, *rows))
    one.upsert(batch({"id": 1, "performer": "A"}), "r1")
    merge, calls = two.merge, []

    def late(n, *rest):
        if not calls:
            calls.append(n)
            one.upsert(batch({"id": 2, "performer": "B"}), "r2")  # commits while the other one is at work
        return merge(n, *rest)

    two.merge = late
    assert two.upsert(batch({"id": 3, "performer": "C"}), "r3")["new"] == 1
    assert sorted(r.performer for r in two.read("events").collect()) == ["A", "B", "C"] and two.version() == 3
    with pytest.raises(store.Conflict):
        one.commit(set(), 1, events=one.read("events"))
    assert sorted(f.name[:7] for f in (tmp_path / "s" / "events").iterdir()) == ["v000001", "v000002", "v000003"]


def test_legacy_import_is_a_run_that_can_be_repeated(spark, tmp_path):
    rows = "".join(f'<tr data-date="2026-08-0{i}" data-venue="Hall" data-performer="P{i}"><td></td><td></td><td>6:00 PM</td><td></td></tr>' for i in range(1, 4))
    pages = spark.createDataFrame([(1, f'<tbody id="tb">{rows}<tr data-date="soon" data-performer="Q"></tr></tbody>'), (2, None)], "page_id long, html string")
    s = store.Store(spark, str(tmp_path / "s"), buckets=2)
    assert legacy.import_curated(s, pages, "a", "t1") == {"run_id": "legacy_a", "rows_parsed": 4, "new": 3, "changed": 0, "unchanged": 0}
    assert legacy.import_curated(s, pages, "a", "t2") == {"run_id": "legacy_a", "rows_parsed": 4, "new": 0, "changed": 0, "unchanged": 3}
    assert [tuple(r) for r in s.read("runs").collect()] == [(2, "legacy_a", "t2", 3)] and s.read("observations").count() == 3


def test_lease(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    with s.lease("a"):
        with pytest.raises(store.Busy), store.Store(spark, str(tmp_path / "s")).lease("b"):
            pass
    with s.lease("b", seconds=-1), s.lease("c"):  # one that is over doesn't count
        pass
    with s.lease("d"):
        pass


def test_old_events_get_a_fixed_confidence(spark):
    rows = [(i, f"P{i}", "2026-01-01", s) for i, s in enumerate(["venue_site", "image:x", "OCR local", "crawler", "seed", None])]
    found, _ = store.migrate_confidence(spark, {"events": spark.createDataFrame(rows, "id long, performer string, date string, source string").withColumn("run_id", F.lit("r"))}), None
    assert [r.confidence for r in found["events"].orderBy("id").collect()] == [0.5, 0.8, 0.5, 0.9, 0.6, 0.5]


def test_favourite_marks(spark):
    events = spark.createDataFrame([(1, None, "Zoe", "Hall", "2026-01-01", 0.5)], "id long, name string, performer string, venue string, date string, confidence double")
    for mark, n in (("y", 1), (" Y ", 1), ("Yes", 0), (None, 0)):
        people = spark.createDataFrame([("Zoe", mark, 1)], "performer string, favorite string, ord int")
        assert featured.featured(events, spark.createDataFrame([], "venue string"), people, "2026-01-01", "2026-01-02").count() == n


def test_featured(spark):
    events = spark.createDataFrame([(1, "Zoe", "Hall", "2026-08-08", 0.9), (2, "Max", "Hall", "2026-08-07", 0.9), (3, "Zoe", "Barn", "2026-08-06", 0.5), (4, "Ann", "Hall", "2026-08-09", 0.7), (5, "Zoe", "Hall", "2027-01-01", 0.9), (6, "Ann", "Barn", "2026-08-08", None)], "id long, performer string, venue string, date string, confidence double").withColumn("name", F.lit(None).cast("string"))
    venues = spark.createDataFrame([("hall ",)], "venue string")
    people = spark.createDataFrame([("Max", "N", 0), ("Zoe", "Y", 1), ("Ann", "Y", 2)], "performer string, favorite string, ord int")
    pick = lambda **k: [r.id for r in featured.featured(events, venues, people, "2026-08-01", "2026-08-31", **k).orderBy("place").collect()]
    assert pick() == [1] and pick(all_ties=True) == [1, 4] and pick(all_performers=True) == [3, 1, 6, 4]
    nobody = spark.createDataFrame([], people.schema)
    assert [r.id for r in featured.featured(events, venues, nobody, "2026-08-01", "2026-08-31", all_performers=True).collect()] == [2]


def test_reports(spark):
    events = canonical(spark, {"performer": "b"}, {"performer": "A", "venue": None}, {"performer": "c", "venue": "Barn"})
    assert [r.name for r in featured.roster_names(events, "performer").collect()] == ["A", "b", "c"]
    assert [(r.venue_title, r.group_start) for r in featured.by_venue(events).collect()] == [("Barn", True), ("Hall", True), ("Unknown Venue", True)]
    found = changes.compare_runs(canonical(spark, *[{"performer": f"P{i}"} for i in range(5)]), canonical(spark, {"performer": "Q"}))
    assert [r.line for r in featured.notification(found, "crawler", 3).collect()][-1] == "...and 2 more"
    assert health(events, observations(raw(spark, {}))).first().total == 3
    assert len(with_observations(events, observations(raw(spark, {"performer": "b"}, {"performer": "b", "source": "seed"}))).filter("performer = 'b'").first().observations) == 2


@pytest.mark.parametrize("empty", [True])
def test_empty_tables(spark, empty):
    none = raw(spark, {}).limit(0)
    obs = observations(none)
    assert canonical_events(obs).collect() == [] and rules.same_night_collisions(canonical_events(obs)).collect() == []


def test_purge_computes_what_is_left_again(spark):
    obs = observations(raw(spark, {"performer": "A", "source": "seed"}, {"performer": "A", "source": "venue"}, {"performer": "B", "source": "seed"}, {"performer": "C", "source": None}))
    events = canonical_events(obs)
    left, kept = rules.purge_source(events, obs, "seed")
    alone = canonical_events(kept)
    derived = ["performer", *rules.DERIVED]
    assert sorted(map(str, left.select(derived).collect())) == sorted(map(str, alone.select(derived).collect()))
    assert {r.performer: r.source_count for r in left.collect()} == {"A": 1, "C": 1}
    assert tuple(rules.purge_counts(events, obs, "seed").first()) == (2, 1, 2)
    assert tuple(rules.purge_counts(events, obs, "nobody").first()) == (0, 0, 0)


def test_strip_takes_every_white_space(spark):
    from concord.functions.text import strip

    every = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = [(f"{c}a b{c}{c}",) for c in every] + [("\u200bz\u200b",), ("",), (None,)]
    frame = spark.createDataFrame(rows, "x string")
    for r in frame.select("x", strip("x").alias("y")).collect():
        assert r.y == (r.x.strip() if r.x is not None else None), repr(r.x)


def test_canonical_events_shuffle_observations_once(spark):
    plan = canonical_events(observed(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
