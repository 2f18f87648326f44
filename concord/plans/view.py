"""The observation view: raw rows made from the events table, and the same view in SQL.

All resolution queries read it, so each has a SQL twin over the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions.scores import sql_rounded
from concord.functions.text import sql_strip
from concord.operators.observe import observations
from concord.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    user, kind = F.col("user_id"), F.col("event_type")
    text = lambda c: c.cast("string")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("Act "), text(user)).alias("performer"), F.concat(F.lit("Venue "), text(user % 20)).alias("venue"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:00").alias("time_start"), F.when(k % 3 == 0, "Main").when(k % 3 == 1, "Patio \u00a0").alias("stage"),
        F.when(k % 4 != 0, F.concat(F.lit("https://example.org/"), text(user % 20), F.lit("/"), text(k % 3))).alias("url"),
        F.when(kind == "click", "aggregator").when(kind == "view", "venue").when(kind == "purchase", "image:flyer.png").when(kind == "signup", "seed").otherwise("ocr:scan").alias("source"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("model_confidence"), F.when(user % 4 == 0, "title").when(user % 4 == 1, "description").when(user % 4 == 2, "lineup").alias("extraction_method"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("observed_at"),
    )


#: The view's own trust: the known sources, and its aggregator.
TRUST = fixed.SOURCE_TRUST | {"aggregator": 0.90}


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(raw(spark, sf_dir), TRUST)


STAGE = f"lower({sql_strip('coalesce(stage, $$$$)')})".replace("$$$$", "''")

#: obs: the observation view. Times in it are all of the form H:00 AM/PM, so minutes come from the hour.
OBS = f"""
raw AS (
  SELECT event_id AS id, 'Act ' || user_id AS performer, 'Venue ' || (user_id % 20) AS venue, strftime(ts, '%Y-%m-%d') AS date,
         CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id,
         CASE event_type WHEN 'click' THEN 'aggregator' WHEN 'view' THEN 'venue' WHEN 'purchase' THEN 'image:flyer.png' WHEN 'signup' THEN 'seed' ELSE 'ocr:scan' END AS source,
         CASE event_type WHEN 'click' THEN 0.9 WHEN 'view' THEN 0.95 WHEN 'purchase' THEN 0.8 WHEN 'signup' THEN 0.6 ELSE 0.5 END::DOUBLE AS source_confidence,
         CASE event_type WHEN 'purchase' THEN 'image' WHEN 'signup' THEN 'manual' WHEN 'error' THEN 'ocr' ELSE 'website' END AS observation_type,
         least(1.0, value / 100) AS m, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS observed_at
  FROM events
), scored AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 'Main' WHEN 1 THEN 'Patio ' || chr(160) END AS stage, CASE WHEN k % 4 <> 0 THEN 'https://example.org/' || (user_id % 20) || '/' || (k % 3) END AS url,
         (CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END) || ':00 ' || (CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END) AS time_start, CAST(NULL AS VARCHAR) AS time_end, h * 60 AS minutes,
         performer || ' at ' || venue AS name, lower(performer) || '|' || lower(venue) || '|' || date AS identity_key,
         {sql_rounded("(CASE WHEN m IS NULL THEN 1.0 ELSE 0.5 * 1.0 + 0.5 * greatest(0.0, least(1.0, m)) END) * (CASE user_id % 4 WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 ELSE 1.0 END)")} AS extraction_confidence
  FROM raw
), obs AS (
  SELECT *, {sql_rounded("source_confidence * extraction_confidence")} AS confidence, {STAGE} AS stage_key,
         substring(sha1(lower(performer) || '|' || lower(venue) || '|' || date || '|' || upper(time_start) || '||' || {STAGE} || '|' || lower(source)), 1, 16) AS checksum
  FROM scored
)"""

LEAD = "row_number() OVER (PARTITION BY identity_key ORDER BY confidence DESC, observed_at DESC, id)"


def sql_events(source: str = "obs", p: str = "") -> str:
    """CTEs that end in <p>ev, the canonical events of an observation CTE."""
    fill = lambda f: f"first({f} ORDER BY confidence DESC, id) FILTER (WHERE coalesce({f}, '') <> '')"
    return f"""
{p}lead AS (SELECT * FROM (SELECT *, {LEAD} AS lead_rank FROM {source}) WHERE lead_rank = 1),
{p}marked AS (
  SELECT o.*, o.minutes <> l.minutes OR (o.stage_key <> '' AND l.stage_key <> '' AND o.stage_key <> l.stage_key) AS conflicting
  FROM {source} o JOIN {p}lead l USING (identity_key)
), {p}best AS (
  SELECT identity_key, source, max(confidence) FILTER (WHERE NOT conflicting) AS c FROM {p}marked GROUP BY ALL
), {p}scores AS (
  SELECT identity_key, max(c) AS best, product(1 - 0.5 * c) AS product, CAST(count(*) AS INTEGER) AS source_count, CAST(count(c) AS INTEGER) AS verification_count FROM {p}best GROUP BY ALL
), {p}times AS (
  SELECT identity_key, string_agg(time_start, ' vs ' ORDER BY minutes, time_start) AS times, count(*) AS n FROM (SELECT DISTINCT identity_key, minutes, time_start FROM {source}) GROUP BY ALL
), {p}facts AS (
  SELECT identity_key, min(id) AS first_id, max(observed_at) AS last_observed, count(*) AS observation_count, bool_or(conflicting) AS conflict,
         {fill("time_start")} AS f_time_start, {fill("time_end")} AS f_time_end, {fill("stage")} AS f_stage, {fill("url")} AS f_url
  FROM {p}marked GROUP BY ALL
), {p}joined AS (
  SELECT f.*, l.name, l.performer, l.venue, l.date, l.source, s.source_count, s.verification_count, coalesce(nullif(l.time_start, ''), f_time_start) AS time_start, coalesce(nullif(l.time_end, ''), f_time_end) AS time_end,
         coalesce(nullif(l.stage, ''), f_stage) AS stage, coalesce(nullif(l.url, ''), f_url) AS url, l.minutes,
         1 - (1 - best) * (product / (1 - 0.5 * best)) AS raw_score, CASE WHEN conflict THEN CASE WHEN t.n > 1 THEN 'Time mismatch: ' || t.times ELSE 'Source conflict' END END AS conflict_reason
  FROM {p}facts f JOIN {p}lead l USING (identity_key) JOIN {p}scores s USING (identity_key) JOIN {p}times t USING (identity_key)
), {p}ev AS (
  SELECT identity_key, first_id AS id, name, performer, venue, date, time_start, time_end, stage, url, source,
         {sql_rounded("least(CASE WHEN conflict THEN raw_score * (1 - 0.15) ELSE raw_score END, 0.99) + 1e-9")} AS confidence,
         CASE WHEN conflict THEN source_count || ' sources, conflict: ' || conflict_reason WHEN verification_count > 1 THEN verification_count || ' sources agree' ELSE 'single source (' || source || ')' END AS confidence_reason,
         source_count, verification_count, CAST(conflict AS INTEGER) AS conflict_flag, conflict_reason, last_observed AS observed_at, observation_count, minutes
  FROM {p}joined
)"""


EVENTS = f"WITH {OBS}, {sql_events()}"
SEEN = f"WITH {OBS}"
