"""Observations to canonical events.

What a hot identity has is combined on the map side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions.scores import rounded
from concord.functions.text import or_empty, strip

FIELDS = ["time_start", "time_end", "stage", "url"]


def combined_confidence(best: str = "best", product: str = "product", conflict: Column | None = None, corroboration: float = fixed.CORROBORATION, penalty: float = fixed.CONFLICT_PENALTY, ceiling: float = fixed.CEILING) -> Column:
    """From the best per-source confidence and the product over sources of 1 - corroboration * confidence."""
    others = F.col(product) / (1 - corroboration * F.col(best))
    score = 1 - (1 - F.col(best)) * others
    if conflict is not None:
        score = F.when(conflict, score * (1 - penalty)).otherwise(score)
    # Products in another order differ in the last bits; the nudge keeps exact halves from rounding either way.
    return rounded(F.least(score, F.lit(ceiling)) + 1e-9)


def source_confidences(rows: DataFrame, by: list[str]) -> DataFrame:
    """The best confidence of each source, in two phases, as by..., best, product, sources."""
    best = rows.groupBy(*by, F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    return best.groupBy(*by).agg(F.max("c").alias("best"), F.product(1 - fixed.CORROBORATION * F.col("c")).alias("product"), F.count("*").alias("sources"))


def rank_of(prefix: str = "") -> Column:
    """The order of observations: confidence, then the latest, then the first in order of id."""
    c = lambda n: F.col(prefix + n)
    return F.struct(F.coalesce(c("confidence"), F.lit(0.0)).alias("c"), or_empty(c("observed_at")).alias("o"), (-c("id")).alias("i"))


def fill_rank() -> Column:
    return F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("id")).alias("i"))


def marked(obs: DataFrame, key: str = "identity_key") -> DataFrame:
    """obs with `conflicting`: start minutes or stage differ from those of its event's primary observation."""
    lead = obs.groupBy(key).agg(F.max_by(F.struct("start_minutes", "stage"), rank_of()).alias("p"))
    both = obs.join(lead, key)
    stage, lead_stage = F.lower(or_empty(strip("stage"))), F.lower(strip(or_empty("p.stage")))
    apart = F.coalesce(F.col("start_minutes") != F.col("p.start_minutes"), F.lit(False))
    return both.withColumn("conflicting", apart | ((stage != "") & (lead_stage != "") & (stage != lead_stage))).drop("p")


def canonical_events(obs: DataFrame, key: str = "identity_key", corroboration: float = fixed.CORROBORATION, penalty: float = fixed.CONFLICT_PENALTY, ceiling: float = fixed.CEILING) -> DataFrame:
    """One row per identity: the primary's fields, gaps filled, confidence, counts, conflict and reason.

    obs is read once and shuffled once, by identity. Its sightings are combined before: an identity then holds one entry
    for each combination of source, confidence, start and stage, and conflicts are judged on these entries.
    """
    rows = obs.withColumn("_source", F.coalesce("source", F.lit("unknown"))).withColumn("_stage", F.lower(or_empty(strip("stage"))))
    rows = rows.withColumn("_shown", F.when(F.col("start_minutes").isNotNull(), strip("time_start")))
    lead = F.struct(rank_of().alias("rank"), "name", "performer", "venue", "date", "source", "start_minutes", F.col("_stage").alias("g"), *FIELDS)
    fills = [F.max(F.when(or_empty(f) != "", F.struct(fill_rank().alias("rank"), F.col(f).alias("v")))).alias(f"_fill_{f}") for f in FIELDS]
    entry = F.struct(F.col("_source").alias("s"), F.coalesce("confidence", F.lit(0.0)).alias("c"), F.col("start_minutes").alias("m"), F.col("_stage").alias("g"), F.col("_shown").alias("t"))
    whole = rows.groupBy(key).agg(
        F.max(lead).alias("p"), *fills, F.min("id").alias("id"), F.max("observed_at").alias("observed_at"), F.count("*").alias("observation_count"), F.collect_set(entry).alias("seen")
    )

    def apart(e: Column) -> Column:
        return F.coalesce(e["m"] != F.col("p.start_minutes"), F.lit(False)) | ((e["g"] != "") & (F.col("p.g") != "") & (e["g"] != F.col("p.g")))

    agree = F.array_sort(F.transform(F.filter("seen", lambda e: ~apart(e)), lambda e: F.struct(e["s"].alias("s"), e["c"].alias("c"))))
    whole = whole.withColumn("conflict", F.exists("seen", apart)).withColumn("_agree", agree)
    # The last entry of each source in order of confidence is its best.
    bests = F.filter("_agree", lambda e, i: ~F.coalesce(F.get(F.col("_agree"), i + 1)["s"] == e["s"], F.lit(False)))
    whole = whole.withColumn("_bests", F.transform(bests, lambda e: e["c"]))
    times = F.filter(F.transform("seen", lambda e: F.struct(e["m"].alias("m"), e["t"].alias("t"))), lambda e: e["m"].isNotNull())
    whole = whole.withColumn("best", F.array_max("_bests")).withColumn("product", F.aggregate("_bests", F.lit(1.0), lambda all, c: all * (1 - corroboration * c)))
    whole = whole.withColumn("times", F.array_sort(F.array_distinct(times))).withColumn("verification_count", F.size("_bests"))
    whole = whole.withColumn("source_count", F.size(F.array_distinct(F.transform("seen", lambda e: e["s"]))))
    why = F.when(F.size("times") > 1, F.concat(F.lit("Time mismatch: "), F.array_join(F.transform("times", lambda t: t["t"]), " vs "))).otherwise("Source conflict")
    whole = whole.withColumn("conflict_reason", F.when(F.col("conflict"), why))
    reason = (
        F.when(F.col("conflict"), F.concat(F.col("source_count").cast("string"), F.lit(" sources, conflict: "), "conflict_reason"))
        .when(F.col("verification_count") > 1, F.concat(F.col("verification_count").cast("string"), F.lit(" sources agree")))
        .otherwise(F.concat(F.lit("single source ("), F.coalesce("p.source", F.lit("None")), F.lit(")")))
    )
    filled = [F.coalesce(F.nullif(F.col(f"p.{f}"), F.lit("")), F.col(f"_fill_{f}.v")).alias(f) for f in FIELDS]
    score = combined_confidence(conflict=F.col("conflict"), corroboration=corroboration, penalty=penalty, ceiling=ceiling)
    return whole.select(
        key, "id", "p.name", "p.performer", "p.venue", "p.date", *filled, "p.source", score.alias("confidence"), reason.alias("confidence_reason"),
        "source_count", "verification_count", F.col("conflict").cast("int").alias("conflict_flag"), "conflict_reason", "observed_at", "observation_count",
    )


def with_observations(events: DataFrame, obs: DataFrame, key: str = "identity_key") -> DataFrame:
    """Events with their observations nested, best first."""
    record = F.struct((-F.col("confidence")).alias("order"), "id", "source", "observation_type", "url", "source_confidence", "extraction_confidence", "confidence", "checksum", "time_start", "time_end", "stage", "observed_at")
    nested = obs.groupBy(key).agg(F.array_sort(F.collect_list(record)).alias("observations"))
    return events.join(nested, key, "left")


def health(events: DataFrame, obs: DataFrame, key: str = "identity_key") -> DataFrame:
    """One row: total, average confidence, verified, conflicts, distinct sources."""
    own = events.agg(F.count("*").alias("total"), F.coalesce(rounded(F.sum("confidence") / F.count("confidence"), 2), F.lit(0.0)).alias("avg_confidence"), F.count_if(F.col("verification_count") > 1).alias("verified"), F.count_if(F.col("conflict_flag") == 1).alias("conflicts"))
    sources = obs.join(events.select(key), key, "left_semi").agg(F.countDistinct("source").alias("sources"))
    return own.join(F.broadcast(sources))  # one row each


def best_url(events: DataFrame, obs: DataFrame, fallback: dict[str, str] | None = None, key: str = "identity_key") -> DataFrame:
    """Each event with the url of its most confident observation that has one, else the venue's own."""
    urls = obs.filter(F.col("url").isNotNull()).groupBy(key).agg(F.max_by("url", fill_rank()).alias("observed_url"))
    own = F.lit(None).cast("string")
    for venue, url in (fallback or {}).items():
        own = F.when(F.lower(or_empty(strip("venue"))) == venue, F.lit(url)).otherwise(own)
    return events.join(urls, key, "left").withColumn("best_url", F.coalesce("observed_url", own)).drop("observed_url")
