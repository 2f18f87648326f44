"""Queries over observations and events: scores, canonical events, rules, merges, differences, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.names import signature
from concord.functions.scores import band, score_reason, sql_rounded
from concord.functions.text import sql_strip
from concord.operators import changes, dashboard, featured, rules, store
from concord.operators.aggregate import best_url, canonical_events, health, marked, source_confidences, combined_confidence, with_observations
from concord.plans.view import EVENTS, OBS, SEEN, TRUST, observed, raw, sql_events, table
from concord.session import checkpoint

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: What events are made of; the view has more columns, which need not be computed and written for events alone.
OF_EVENTS = ["id", "identity_key", "name", "performer", "venue", "date", "time_start", "time_end", "stage", "url", "source", "confidence", "observed_at", "start_minutes"]
OF_CONFLICTS = ["id", "identity_key", "time_start", "stage", "source", "confidence", "observed_at", "start_minutes"]


def written(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The observation view or some columns of it, written once for queries that read it more than once."""
    rows = observed(spark, sf_dir)
    return checkpoint(rows.select(columns) if columns else rows)


def events_of(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    obs = written(spark, sf_dir, columns)
    return canonical_events(obs), obs


def events_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(observed(spark, sf_dir))


@query(f"{SEEN} SELECT id, identity_key, source, observation_type, source_confidence, extraction_confidence, confidence, time_start, stage FROM obs")
def observation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("id", "identity_key", "source", "observation_type", "source_confidence", "extraction_confidence", "confidence", "time_start", "stage")


CANONICAL = "identity_key, id, name, performer, venue, date, time_start, time_end, stage, url, source, confidence, confidence_reason, source_count, verification_count, conflict_flag, conflict_reason, observation_count"


@query(f"{EVENTS} SELECT {CANONICAL} FROM ev")
def canonical_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_only(spark, sf_dir).select(*CANONICAL.split(", "))


QUERIES["canonical_events"], ORACLES["canonical_events"] = QUERIES.pop("canonical_events_query"), ORACLES.pop("canonical_events_query")


@query(f"""{SEEN}, b AS (SELECT identity_key, source, max(confidence) AS c FROM obs GROUP BY ALL), s AS (SELECT identity_key, max(c) AS best, product(1 - 0.5 * c) AS product, count(*) AS sources FROM b GROUP BY ALL)
SELECT identity_key, sources, {sql_rounded("least(1 - (1 - best) * (product / (1 - 0.5 * best)), 0.99) + 1e-9")} AS confidence FROM s""")
def canonical_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_confidences(observed(spark, sf_dir), ["identity_key"]).select("identity_key", "sources", combined_confidence().alias("confidence"))


@query(f"{EVENTS} SELECT identity_key, id, source, time_start, stage, conflicting FROM marked")
def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(written(spark, sf_dir, OF_CONFLICTS)).select("identity_key", "id", "source", "time_start", "stage", "conflicting")


@query(f"{EVENTS} SELECT l.identity_key, coalesce(nullif(l.stage, ''), f_stage) AS stage, coalesce(nullif(l.url, ''), f_url) AS url, l.stage IS NULL AND f_stage IS NOT NULL AS stage_filled FROM lead l JOIN facts f USING (identity_key)")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, obs = events_of(spark, sf_dir)
    from concord.operators.aggregate import rank_of

    lead = obs.groupBy("identity_key").agg(F.max_by(F.struct("stage"), rank_of())["stage"].alias("own"))
    return events.join(lead, "identity_key").select("identity_key", "stage", "url", (F.col("own").isNull() & F.col("stage").isNotNull()).alias("stage_filled"))


@query(f"{EVENTS}, n AS (SELECT identity_key, list(source ORDER BY confidence DESC, id) AS sources, count(*) AS n FROM obs GROUP BY ALL) SELECT identity_key, sources, n FROM n JOIN ev USING (identity_key)")
def nested_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, obs = events_of(spark, sf_dir)
    return with_observations(events, obs).select("identity_key", F.transform("observations", lambda o: o["source"]).alias("sources"), F.size("observations").cast("long").alias("n"))


@query(f"""{SEEN} SELECT identity_key, id, run_id, source FROM (
  SELECT *, 'run_' || (id % 3) AS run_id, row_number() OVER (PARTITION BY identity_key ORDER BY 'run_' || (id % 3) DESC, id DESC) AS r FROM obs) WHERE r = 1""")
def latest_per_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observed(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run_"), (F.col("id") % 3).cast("string")))
    return rules.latest_per_identity(rows).select("identity_key", "id", "run_id", "source")


@query(f"""{EVENTS} SELECT identity_key, source, url, date FROM (
  SELECT *, row_number() OVER (PARTITION BY source, url, date ORDER BY observed_at DESC, id) AS r FROM ev WHERE coalesce(url, '') <> '' AND source IS NOT NULL) WHERE r > 1""")
def stale_url_relisting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stale_url_relistings(*events_of(spark, sf_dir, OF_EVENTS)).select("identity_key", "source", "url", "date")


@query(f"""{EVENTS} SELECT identity_key, venue, date, time_start FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(venue), date, time_start, lower(trim(coalesce(stage, ''))) ORDER BY observed_at DESC, id) AS r FROM ev WHERE source ILIKE 'image:%') WHERE r > 1""")
def stale_image_relisting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stale_image_relistings(*events_of(spark, sf_dir, OF_EVENTS)).select("identity_key", "venue", "date", "time_start")


@query(f"""{EVENTS}, s AS (SELECT identity_key, bool_and(source = 'aggregator') AS only_a, bool_or(source <> 'aggregator') AS other FROM obs GROUP BY ALL),
slot AS (SELECT e.identity_key, e.venue, e.date, e.time_start, only_a, bool_or(other) OVER (PARTITION BY lower(e.venue), e.date, e.time_start) AS site FROM ev e JOIN s USING (identity_key))
SELECT identity_key, venue, date, time_start, only_a AND site AS "drop" FROM slot""")
def site_vs_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.site_over_aggregator(*events_of(spark, sf_dir, OF_EVENTS)).select("identity_key", "venue", "date", "time_start", "drop")


@query(f"""{EVENTS}, p AS (SELECT DISTINCT venue, date, coalesce(lower(trim(stage)), '') AS stage, time_start, performer FROM ev),
s AS (SELECT venue, date, stage, time_start FROM p GROUP BY ALL HAVING count(*) > 1)
SELECT venue, date, list_sort(list_distinct(list(performer))) AS performers FROM p JOIN s USING (venue, date, stage, time_start) GROUP BY ALL""")
def same_night_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.same_night_collisions(events_only(spark, sf_dir)).select("venue", "date", "performers")


IRREGULAR = """a AS (SELECT venue, performer || ' ' || time_start AS performer, date FROM ev), g AS (SELECT *, CAST(date AS DATE) - lag(CAST(date AS DATE)) OVER (PARTITION BY venue, performer ORDER BY date) AS gap FROM a),
irregular AS (SELECT venue, performer, list(date ORDER BY date) AS dates FROM g GROUP BY ALL HAVING bool_or(gap BETWEEN 6 AND 8) AND bool_or(gap BETWEEN 1 AND 3))"""


def by_slot(events: DataFrame) -> DataFrame:
    """Events whose performers are acts of one start time, so that not every act plays every day."""
    return events.withColumn("performer", F.concat("performer", F.lit(" "), "time_start"))


@query(f"{EVENTS}, {IRREGULAR} SELECT * FROM irregular")
def irregular_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.irregular_recurrences(by_slot(events_only(spark, sf_dir))).select("venue", "performer", "dates")


@query(f"""WITH {OBS}, {sql_events()}, {IRREGULAR}, q AS (SELECT DISTINCT e.venue, e.date, coalesce(lower(trim(e.stage)), '') AS stage, e.time_start, e.performer || ' ' || e.time_start AS performer FROM ev e),
s AS (SELECT venue, date, stage, time_start FROM q GROUP BY ALL HAVING count(*) > 1)
SELECT 'same_night' AS kind, venue, date, list_sort(list_distinct(list(performer))) AS performers, CAST(NULL AS VARCHAR[]) AS dates FROM q JOIN s USING (venue, date, stage, time_start) GROUP BY ALL
UNION ALL SELECT 'irregular_recurrence', venue, NULL, [performer], dates FROM irregular""")
def schedule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.schedule_conflicts(checkpoint(by_slot(events_only(spark, sf_dir))))


@query(f"""{EVENTS}, kept AS (SELECT * FROM obs WHERE source <> 'aggregator'), {sql_events("kept", "k_")}
SELECT {", ".join(("k." if c in rules.DERIVED else "e.") + c for c in CANONICAL.split(", "))} FROM ev e JOIN k_ev k USING (identity_key)""")
def source_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.purge_source(*events_of(spark, sf_dir), "aggregator")[0].select(*CANONICAL.split(", "))


@query(f"""{SEEN}, n AS (SELECT identity_key, count(*) FILTER (WHERE source = 'aggregator') AS gone, count(*) FILTER (WHERE source <> 'aggregator') AS kept FROM obs GROUP BY ALL)
SELECT CAST(sum(gone) AS BIGINT) AS observations_deleted, count(*) FILTER (WHERE gone > 0 AND kept = 0) AS events_deleted, count(*) FILTER (WHERE kept > 0) AS events_recomputed FROM n""")
def source_purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.purge_counts(*events_of(spark, sf_dir), "aggregator")


@query(f"{SEEN} SELECT identity_key FROM obs WHERE source = 'aggregator' EXCEPT SELECT identity_key FROM obs WHERE source <> 'aggregator'")
def orphan_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observed(spark, sf_dir)
    return rules.orphaned_by(obs, "aggregator")


@query(f"{SEEN} SELECT min(id) AS id, identity_key, source, checksum FROM obs GROUP BY identity_key, source, checksum")
def dedup_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.distinct_observations(observed(spark, sf_dir)).select("id", "identity_key", "source", "checksum")


@query(f"{SEEN} SELECT id, identity_key, checksum FROM obs")
def identity_and_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).select("id", "identity_key", "checksum")


SIGN = "lower(name || '|' || date || '|' || coalesce(time_start, '') || '|' || coalesce(time_end, '') || '|' || venue || '|' || performer || '|' || trim(coalesce(stage, '')))"
TWO_RUNS = f"""WITH {OBS}, o1 AS (SELECT * FROM obs WHERE id % 10 < 7), o2 AS (SELECT * FROM obs WHERE id % 10 >= 3), {sql_events("o1", "a_")}, {sql_events("o2", "b_")},
d AS (SELECT coalesce(a.identity_key, b.identity_key) AS identity_key, CASE WHEN a.identity_key IS NULL THEN 'new' WHEN b.identity_key IS NULL THEN 'removed' WHEN a.s = b.s THEN 'unchanged' ELSE 'changed' END AS status,
  a.time_start AS t0, b.time_start AS t1, a.stage AS s0, b.stage AS s1
  FROM (SELECT *, {SIGN} AS s FROM a_ev) a FULL JOIN (SELECT *, {SIGN} AS s FROM b_ev) b ON a.identity_key = b.identity_key)"""


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = written(spark, sf_dir)
    return changes.compare_runs(canonical_events(obs.filter("id % 10 >= 3")), canonical_events(obs.filter("id % 10 < 7")))


@query(f"{TWO_RUNS} SELECT identity_key, status FROM d")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_runs(spark, sf_dir).select("identity_key", "status")


@query(f"{TWO_RUNS} SELECT count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status IN ('new', 'changed')) AS total_delta FROM d")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_summary(two_runs(spark, sf_dir))


@query(f"""{TWO_RUNS}, f AS (SELECT identity_key, 'time_start' AS field, t0 AS before, t1 AS after FROM d WHERE status = 'changed' AND t0 IS DISTINCT FROM t1
UNION ALL SELECT identity_key, 'stage', s0, s1 FROM d WHERE status = 'changed' AND s0 IS DISTINCT FROM s1) SELECT * FROM f""")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = two_runs(spark, sf_dir).filter("status = 'changed'")
    return rows.select("identity_key", F.explode(changes.field_diff(["time_start", "stage"])).alias("d")).select("identity_key", "d.field", "d.before", "d.after")


MERGED = f"""WITH {OBS}, st AS (SELECT * FROM obs WHERE id % 2 = 0), inc AS (SELECT * FROM obs WHERE id % 2 = 1),
again AS (SELECT identity_key, source, checksum, max(observed_at) AS seen FROM inc GROUP BY ALL),
known AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity_key, source, checksum ORDER BY id) AS n FROM inc i
  WHERE identity_key IN (SELECT identity_key FROM st) AND NOT EXISTS (SELECT 1 FROM st s WHERE s.identity_key = i.identity_key AND s.source = i.source AND s.checksum = i.checksum)) WHERE n = 1),
allo AS (SELECT s.* REPLACE (coalesce(a.seen, s.observed_at) AS observed_at) FROM st s LEFT JOIN again a USING (identity_key, source, checksum)
  UNION ALL SELECT * EXCLUDE (n) FROM known UNION ALL SELECT * FROM inc WHERE identity_key NOT IN (SELECT identity_key FROM st)),
{sql_events("st", "p_")}, {sql_events("allo", "n_")}"""


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = written(spark, sf_dir)
    stored, incoming = obs.filter("id % 2 = 0"), obs.filter("id % 2 = 1")
    both = store.merge_observations(stored, incoming)
    return store.merge_events(canonical_events(stored), both, incoming.select("identity_key")), both


@query(f"{MERGED} SELECT id, identity_key, source, checksum, observed_at FROM allo")
def merge_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)[1].select("id", "identity_key", "source", "checksum", "observed_at")


@query(f"""{MERGED} SELECT n.identity_key, coalesce(p.id, n.id) AS id, n.confidence, n.source_count,
CASE WHEN n.identity_key NOT IN (SELECT identity_key FROM inc) THEN 'kept' WHEN p.id IS NULL THEN 'new' WHEN p.s = n.s THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT *, {SIGN} AS s FROM n_ev) n LEFT JOIN (SELECT *, {SIGN} AS s FROM p_ev) p USING (identity_key)""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)[0].select("identity_key", "id", "confidence", "source_count", "status")


@query(f"""{EVENTS} SELECT count(*) AS total, {sql_rounded("sum(confidence) / count(confidence)", 2)} AS avg_confidence, count(*) FILTER (WHERE verification_count > 1) AS verified,
count(*) FILTER (WHERE conflict_flag = 1) AS conflicts, (SELECT count(DISTINCT source) FROM obs) AS sources FROM ev""")
def kpi_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(*events_of(spark, sf_dir))


@query(f"""{EVENTS} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS events FROM ev GROUP BY ALL""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_only(spark, sf_dir).groupBy(band("confidence").alias("band")).agg(F.count("*").alias("events"))


@query(f"""{EVENTS}, u AS (SELECT identity_key, first(url ORDER BY confidence DESC, id) FILTER (WHERE url IS NOT NULL) AS u FROM obs GROUP BY ALL)
SELECT identity_key, coalesce(u, CASE lower(venue) WHEN 'venue 3' THEN 'https://example.org/three' WHEN 'venue 4' THEN 'https://example.org/four' END) AS best_url FROM ev JOIN u USING (identity_key)""")
def best_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, obs = events_of(spark, sf_dir)
    own = {"venue 3": "https://example.org/three", "venue 4": "https://example.org/four"}
    return best_url(events, obs, own).select("identity_key", "best_url")


FAVORITES = """rv AS (SELECT 'venue ' || (n_nationkey % 20) AS v FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
rp AS (SELECT 'act ' || c_custkey AS p, arg_max(c_mktsegment <> 'BUILDING', c_custkey) AS fav, max(c_custkey) AS ord FROM customer GROUP BY ALL),
tiers AS (SELECT e.*, coalesce(rp.ord, 1073741824) AS ord, coalesce(rp.fav, false) AS pf, rv.v IS NOT NULL AS vf,
  CASE WHEN coalesce(rp.fav, false) AND rv.v IS NOT NULL THEN 0 WHEN coalesce(rp.fav, false) THEN 1 WHEN rv.v IS NOT NULL THEN 2 ELSE 3 END AS tier
  FROM ev e LEFT JOIN rp ON lower(e.performer) = rp.p LEFT JOIN (SELECT DISTINCT v FROM rv) rv ON lower(e.venue) = rv.v WHERE date BETWEEN '2024-01-08' AND '2024-01-14')"""


def rosters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Favourite venues are those of one region's nations; the roster is all customers, its favourites by their segment."""
    home = table(spark, sf_dir, "region").filter("r_name = 'ASIA'").select("r_regionkey")
    venues = table(spark, sf_dir, "nation").join(home, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.concat(F.lit("Venue "), (F.col("n_nationkey") % 20).cast("string")).alias("venue"))
    people = table(spark, sf_dir, "customer")
    return venues, people.select(F.concat(F.lit("Act "), F.col("c_custkey").cast("string")).alias("performer"), F.when(F.col("c_mktsegment") != "BUILDING", "Y").otherwise("N").alias("favorite"), F.col("c_custkey").alias("ord"))


@query(f"{EVENTS}, {FAVORITES} SELECT identity_key, tier, 1 AS place FROM tiers WHERE tier < 3 ORDER BY tier, date, ord, confidence DESC, id LIMIT 1")
def featured_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured.featured(events_only(spark, sf_dir), *rosters(spark, sf_dir), "2024-01-08", "2024-01-14").select("identity_key", "tier", "place")


@query(f"{EVENTS}, {FAVORITES} SELECT identity_key, tier, CAST(row_number() OVER (ORDER BY date, tier, ord, confidence DESC, id) AS INTEGER) AS place FROM tiers WHERE pf")
def featured_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured.featured(events_only(spark, sf_dir), *rosters(spark, sf_dir), "2024-01-08", "2024-01-14", all_performers=True).select("identity_key", "tier", "place")


@query(f"{EVENTS} SELECT identity_key, venue, date, row_number() OVER (PARTITION BY venue ORDER BY date, id) = 1 AS group_start FROM ev")
def by_venue_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured.by_venue(events_only(spark, sf_dir)).select("identity_key", "venue", "date", "group_start")


@query(f"""{EVENTS} SELECT id, strftime(CAST(date AS DATE), '%A') AS day, strftime(CAST(date AS DATE), '%b %d, %Y') AS date_shown, strftime(CAST(date AS DATE), '%a %b %d') AS short_date,
performer, venue, time_start, printf('%.2f', {sql_rounded("confidence", 2)}) || CASE WHEN confidence >= 0.8 THEN ' (high)' WHEN confidence >= 0.5 THEN ' (medium)' ELSE ' (low)' END AS confidence_shown, date < '2024-01-15' AS is_past FROM ev""")
def report_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured.sheet(events_only(spark, sf_dir), "2024-01-15")


@query(f"{EVENTS} SELECT identity_key, date, time_start, venue FROM ev WHERE date >= '2024-01-20' ORDER BY date, time_start")
def upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.not_past(events_only(spark, sf_dir), "2024-01-20").select("identity_key", "date", "time_start", "venue").orderBy("date", "time_start")


@query(f"{EVENTS} SELECT identity_key, venue, date FROM ev WHERE venue IN ('Venue 3', 'Venue 7') AND performer IN ('Act 3', 'Act 7', 'Act 27') AND date BETWEEN '2024-01-05' AND '2024-01-25'")
def filtered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.filtered(events_only(spark, sf_dir), ["Venue 3", "Venue 7"], ["Act 3", "Act 7", "Act 27"], "2024-01-05", "2024-01-25")
    return found.select("identity_key", "venue", "date")


@query(f"""{SEEN} SELECT id, 'source=' || source || ' (trust ' || printf('%.2f', {sql_rounded("source_confidence", 2)}) || '); extraction ' || printf('%.2f', {sql_rounded("extraction_confidence", 2)}) || '; model ' || printf('%.2f', {sql_rounded("m", 2)}) AS reason FROM obs""")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    return rows.select("id", score_reason(trust=TRUST).alias("reason"))


@query(f"""{TWO_RUNS}, x AS (SELECT b.* FROM b_ev b JOIN d USING (identity_key) WHERE d.status = 'new')
SELECT performer || ' @ ' || venue || '  ' || date || ' ' || coalesce(time_start, '') AS line FROM x""")
def changelog_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changelog(two_runs(spark, sf_dir)).filter("status = 'new'").select("line")


@query(f"""WITH {OBS}, {sql_events()}, who AS (SELECT identity_key, bool_and(source = 'aggregator') AS only_a, bool_or(source <> 'aggregator') AS other FROM obs GROUP BY ALL),
slot AS (SELECT e.*, only_a AND bool_or(other) OVER (PARTITION BY lower(venue), date, time_start) AS gone FROM ev e JOIN who USING (identity_key)), f1 AS (SELECT * EXCLUDE (gone) FROM slot WHERE NOT gone),
f2 AS (SELECT * EXCLUDE (r) FROM (SELECT *, CASE WHEN coalesce(url, '') <> '' THEN row_number() OVER (PARTITION BY source, url, date ORDER BY observed_at DESC, id) ELSE 1 END AS r FROM f1) WHERE r = 1),
f3 AS (SELECT * EXCLUDE (r) FROM (SELECT *, CASE WHEN source ILIKE 'image:%' THEN row_number() OVER (PARTITION BY source ILIKE 'image:%', lower(venue), date, time_start, {sql_strip("lower(coalesce(stage, ''))")} ORDER BY observed_at DESC, id) ELSE 1 END AS r FROM f2) WHERE r = 1),
left_obs AS (SELECT * EXCLUDE (r) FROM (SELECT o.*, row_number() OVER (PARTITION BY identity_key, source, checksum ORDER BY id) AS r FROM obs o WHERE identity_key IN (SELECT identity_key FROM f3)) WHERE r = 1),
{sql_events("left_obs", "z_")} SELECT identity_key, f.id, f.name, f.date, z.time_start, f.venue, f.performer, f.url, z.confidence, z.source_count FROM f3 f JOIN z_ev z USING (identity_key) WHERE f.date >= '2024-01-10'""")
def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule chain."""
    events, _ = rules.finalize(*events_of(spark, sf_dir, [*OF_EVENTS, "checksum"]), "2024-01-10")
    return events.select("identity_key", "id", "name", "date", "time_start", "venue", "performer", "url", "confidence", "source_count")


@query(f"{EVENTS}, s AS (SELECT identity_key, {SIGN} AS signature FROM ev) SELECT * FROM s")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_only(spark, sf_dir).select("identity_key", signature().alias("signature"))


@query(f"{TWO_RUNS}, x AS (SELECT b.* FROM b_ev b JOIN d USING (identity_key) WHERE d.status = 'new') SELECT identity_key, performer || ' @ ' || venue || '  ' || date || ' ' || coalesce(time_start, '') AS line FROM x ORDER BY id LIMIT 5")
def first_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's summary shows of its new events; the limit is the feature."""
    return dashboard.first_new(two_runs(spark, sf_dir))


@query(f"""{EVENTS}, {FAVORITES.split("tiers AS")[0].rstrip().rstrip(",")}, u AS (SELECT identity_key, first(url ORDER BY confidence DESC, id) FILTER (WHERE url IS NOT NULL) AS u FROM obs GROUP BY ALL),
n AS (SELECT identity_key, list(source ORDER BY confidence DESC, id) AS said FROM obs GROUP BY ALL),
q AS (SELECT *, CASE venue WHEN 'Venue 4' THEN 'Hall+%26+Barn%2C+FL' ELSE replace(venue, ' ', '+') END AS enc FROM ev)
SELECT identity_key, q.id, performer, CASE venue WHEN 'Venue 5' THEN 'Five' ELSE venue END AS venue_shown, CASE venue WHEN 'Venue 3' THEN 'vt-3' ELSE 'vt-def' END AS venue_class,
CASE WHEN rv.v IS NOT NULL THEN 'Y' ELSE 'N' END AS favorite, CASE WHEN coalesce(rp.fav, false) THEN 'Y' ELSE 'N' END AS performer_favorite, 'https://www.google.com/maps?q=' || enc || '&output=embed' AS embed,
'https://www.google.com/maps/search/?api=1&query=' || enc AS external, coalesce(u.u, '') AS url, strftime(CAST(date AS DATE), '%a %b %d') AS date_shown, time_start AS time_shown,
printf('%.2f', {sql_rounded("confidence", 2)}) AS confidence_shown, CASE WHEN confidence >= 0.8 THEN 'cf-hi' WHEN confidence >= 0.5 THEN 'cf-md' ELSE 'cf-lo' END AS band_class, CASE WHEN conflict_flag = 1 THEN conflict_reason END AS conflict, n.said
FROM q JOIN u USING (identity_key) JOIN n USING (identity_key) LEFT JOIN rp ON lower(performer) = rp.p LEFT JOIN (SELECT DISTINCT v FROM rv) rv ON lower(venue) = rv.v""")
def dashboard_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dashboard.dashboard_rows(*events_of(spark, sf_dir), *rosters(spark, sf_dir), classes={"venue 3": "vt-3"}, names={"venue 5": "Five"}, searches={"venue 4": "Hall & Barn, FL"}, fallback={})
    return rows.drop("date", "venue").withColumn("said", F.transform("said", lambda o: o["source"]))


@query(f"""WITH {OBS}, left_obs AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY identity_key, source, checksum ORDER BY id) AS r FROM obs) WHERE r = 1), {sql_events("left_obs", "z_")}
SELECT identity_key, z.id, z.confidence, z.confidence_reason, z.source_count, z.verification_count, z.conflict_flag, z.conflict_reason FROM z_ev z""")
def migrated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the oldest schema, one event per sighting, brought to the newest: one event per identity."""
    obs = written(spark, sf_dir)
    events = obs.select("id", "name", "performer", "venue", "date", "time_start", "time_end", "stage", "url", "source")
    sources = obs.select("id", F.col("id").alias("event_id"), "source", "url", "confidence", "checksum", "observed_at")
    tables, _ = store.migrate(spark, {"events": events, "event_sources": sources})
    return tables["events"].select("identity_key", "id", "confidence", "confidence_reason", "source_count", "verification_count", "conflict_flag", "conflict_reason")
