"""Clean-up rules over events and their observations. Each takes and returns DataFrames, and running one twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.names import canonicalize, identity_key
from concord.functions.text import or_empty, strip
from concord.functions.times import format_time_range, split_time_range, apply_venue_default_time
from concord.functions.titles import detect_non_music
from concord.session import checkpoint


def not_past(events: DataFrame, cutoff: str | Column) -> DataFrame:
    """Without events dated before the cutoff, compared as text: null dates stay, empty ones go."""
    return events.filter(F.coalesce(F.col("date") >= cutoff, F.lit(True)))


def dated(events: DataFrame) -> DataFrame:
    """Without events whose date is null or doesn't begin like an ISO date."""
    return events.filter(F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False)))


def is_music(performer: Column | str = "performer") -> Column:
    return detect_non_music(performer).isNull()


def only_music(events: DataFrame) -> DataFrame:
    return events.filter(is_music())


def with_sources(events: DataFrame, obs: DataFrame, key: str) -> DataFrame:
    """events with `sources`, the set of their observations' sources (null without any)."""
    found = obs.groupBy(key).agg(F.collect_set(F.coalesce("source", F.lit("unknown"))).alias("sources"))
    return events.join(found, key, "left")


def site_over_aggregator(events: DataFrame, obs: DataFrame, aggregator: str = "aggregator", key: str = "identity_key") -> DataFrame:
    """Marks events (`drop`) that only the aggregator lists in a slot where another source lists something.

    A slot is venue (lower case), date and start; events without observations or with a null in the slot take no part.
    Slots are judged by group sums that are joined back, so a busy slot isn't gathered in a window.
    """
    rows = with_sources(events, obs, key)
    only = F.coalesce(F.size("sources") == 1, F.lit(False)) & F.coalesce(F.array_contains("sources", aggregator), F.lit(False))
    other = F.coalesce(F.size(F.array_except("sources", F.array(F.lit(aggregator)))) > 0, F.lit(False))
    rows = rows.withColumn("_slot_venue", F.lower("venue")).withColumn("_only", only).withColumn("_other", other)
    slot = ["_slot_venue", "date", "time_start"]
    contested = rows.groupBy(*slot).agg(F.max("_other").alias("_site")).filter("_site")
    marked = rows.join(contested, slot, "left").withColumn("drop", F.col("_only") & F.coalesce("_site", F.lit(False)))
    return marked.drop("_slot_venue", "_only", "_other", "_site", "sources")


def latest_in(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with `rank` within by, 1 first."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_of(rows: DataFrame, by: list[str], pick, order: Column) -> DataFrame:
    """One row of each group, by an aggregate that combines a hot group before it is shuffled."""
    return rows.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]).agg(pick(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def latest_observed(events: DataFrame, obs: DataFrame, key: str) -> DataFrame:
    """Events that have observations, with the latest time of one."""
    return events.join(obs.groupBy(key).agg(F.max("observed_at").alias("latest_observed")), key)


def stale_url_relistings(events: DataFrame, obs: DataFrame, key: str = "identity_key") -> DataFrame:
    """Events that a later one with the same source, url and date replaces."""
    rows = latest_observed(events.filter((or_empty("url") != "") & F.col("source").isNotNull()), obs, key)
    return latest_in(rows, ["source", "url", "date"], [F.desc("latest_observed"), F.asc("id")]).filter("rank > 1").drop("rank")


def stale_image_relistings(events: DataFrame, obs: DataFrame, key: str = "identity_key") -> DataFrame:
    """The same for events read off images, by venue, date, start and stage."""
    rows = latest_observed(events.filter(F.col("source").ilike("image:%")), obs, key)
    rows = rows.withColumn("_v", F.lower(or_empty(strip("venue")))).withColumn("_s", F.lower(or_empty(strip("stage"))))
    return latest_in(rows, ["_v", "date", "time_start", "_s"], [F.desc("latest_observed"), F.asc("id")]).filter("rank > 1").drop("rank", "_v", "_s")


def latest_per_identity(events: DataFrame, key: str = "identity_key") -> DataFrame:
    return first_of(events, [key], F.max_by, F.struct("run_id", "id"))


def distinct_observations(obs: DataFrame, key: str = "identity_key") -> DataFrame:
    """The first of the observations with equal event, source and checksum; nulls are equal."""
    return first_of(obs, [key, "source", "checksum"], F.min_by, F.col("id"))


#: What follows from an event's observations alone; the rest of an event is kept as it is stored.
DERIVED = ["time_start", "time_end", "stage", "confidence", "confidence_reason", "source_count", "verification_count", "conflict_flag", "conflict_reason", "observation_count"]


def recomputed(events: DataFrame, obs: DataFrame, key: str = "identity_key", derived: list[str] = DERIVED) -> DataFrame:
    """events with their derived columns as their observations now give them; those without observations unchanged."""
    from concord.operators.aggregate import canonical_events

    derived = [c for c in derived if c in events.columns]
    new = canonical_events(obs, key).select(F.col(key).alias("_key"), F.struct(*derived).alias("_new"))
    both = events.join(new, F.col(key) == F.col("_key"), "left")
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in derived else F.col(c) for c in events.columns])


def orphaned_by(obs: DataFrame, source: str, key: str = "identity_key") -> DataFrame:
    """The identities that have observations of this source alone."""
    only = obs.groupBy(key).agg(F.max(F.col("source").eqNullSafe(source)).alias("has"), F.max(~F.col("source").eqNullSafe(source)).alias("others"))
    return only.filter("has AND NOT others").select(key)


def purge_source(events: DataFrame, obs: DataFrame, source: str, key: str = "identity_key") -> tuple[DataFrame, DataFrame]:
    """(events, observations) without a source's observations and without the events that had no others; what is derived
    from observations is computed again for the events that stay."""
    kept = obs.filter(~F.col("source").eqNullSafe(source))
    return recomputed(events.join(orphaned_by(obs, source, key), key, "left_anti"), kept, key), kept


def purge_counts(events: DataFrame, obs: DataFrame, source: str, key: str = "identity_key") -> DataFrame:
    """One row: observations_deleted, events_deleted and events_recomputed (none, if no observation goes) of `purge_source`."""
    by_event = obs.groupBy(key).agg(F.count_if(F.col("source").eqNullSafe(source)).alias("gone"), F.count_if(~F.col("source").eqNullSafe(source)).alias("kept"))
    both = by_event.join(events.select(key, F.lit(1).alias("event")), key, "left")
    count = both.agg(F.coalesce(F.sum("gone"), F.lit(0)).alias("observations_deleted"), F.expr("count_if(event = 1 AND gone > 0 AND kept = 0) AS events_deleted"), F.expr("count_if(event = 1 AND kept > 0) AS _stay"))
    return count.select("observations_deleted", "events_deleted", F.when(F.col("observations_deleted") > 0, F.col("_stay")).otherwise(0).alias("events_recomputed"))


def renamed(events: DataFrame, field: str) -> DataFrame:
    """Events with a field in canonical spelling and each row's surviving id: the least of its new identity.

    Columns `renamed` and `merged` tell which rows changed their spelling and which go into another.
    """
    new = F.coalesce(canonicalize(field), F.col(field))
    rows = events.withColumn("renamed", ~new.eqNullSafe(F.col(field))).withColumn(field, new)
    rows = rows.withColumn("identity_key", identity_key())
    first = rows.groupBy("identity_key").agg(F.min("id").alias("survivor"))
    return rows.join(first, "identity_key").withColumn("merged", F.col("id") != F.col("survivor"))


def normalize_stored_times(rows: DataFrame) -> DataFrame:
    """Rows with times in one form and `changed`."""
    parts = split_time_range("time_start")
    end = F.coalesce(F.when(or_empty("time_end") != "", format_time_range("time_end")), parts["end"], F.col("time_end"))
    out = rows.withColumn("_start", parts["start"]).withColumn("_end", end)
    out = out.withColumn("changed", ~(F.col("_start").eqNullSafe(F.col("time_start")) & F.col("_end").eqNullSafe(F.col("time_end"))))
    return out.withColumn("time_start", F.col("_start")).withColumn("time_end", F.col("_end")).drop("_start", "_end")


def backfill_default_times(rows: DataFrame) -> DataFrame:
    """Rows with their venue's usual slot where they have no time, and `changed`."""
    new = apply_venue_default_time("venue", "time_start")
    return rows.withColumn("changed", ~new.eqNullSafe(F.col("time_start"))).withColumn("time_start", new)


def same_night_collisions(events: DataFrame) -> DataFrame:
    """Per venue and date with two performers or more: those that share a slot (stage and start)."""
    rows = events.filter("date IS NOT NULL AND venue IS NOT NULL AND performer IS NOT NULL")
    rows = rows.select(F.lower(strip("venue")).alias("venue_key"), "date", F.nullif(F.lower(or_empty(strip("stage"))), F.lit("")).alias("stage"), F.nullif("time_start", F.lit("")).alias("time_start"), "performer", F.struct("id", "venue").alias("v"))
    slots = rows.groupBy("venue_key", "date", "stage", "time_start").agg(F.collect_set("performer").alias("performers"), F.min("v").alias("v"))
    both = slots.groupBy("venue_key", "date").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("performers") > 1, F.col("performers")))))).alias("performers"), F.min("v").alias("v")
    )
    return both.filter(F.size("performers") > 0).select("venue_key", "date", F.col("v.venue").alias("venue"), "performers")


def irregular_recurrences(events: DataFrame) -> DataFrame:
    """Venue and performer pairs whose dates have both a gap of about a week and one of one to three days."""
    rows = events.filter("date IS NOT NULL AND venue IS NOT NULL AND performer IS NOT NULL")
    rows = rows.withColumn("d", F.when(F.col("date").rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}$"), F.col("date").try_cast("date"))).filter("d IS NOT NULL")
    rows = rows.select(F.lower(strip("venue")).alias("venue_key"), F.lower(strip("performer")).alias("performer_key"), "d", "id", "venue", "performer")
    pair = ["venue_key", "performer_key"]
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy(*pair).orderBy("d", "id")))
    found = rows.withColumn("gap", gap).groupBy(*pair).agg(
        F.max(F.col("gap").between(6, 8)).alias("weekly"), F.max(F.col("gap").between(1, 3)).alias("short"),
        F.array_sort(F.collect_list(F.col("d").cast("string"))).alias("dates"), F.min_by(F.struct("venue", "performer"), F.struct("d", "id")).alias("f"),
    )
    return found.filter("weekly AND short").select("f.venue", "f.performer", "dates")


def schedule_conflicts(events: DataFrame) -> DataFrame:
    """kind, venue, date, performers, dates: shared slots of one night, and acts with an irregular rhythm."""
    nights = same_night_collisions(events).select(F.lit("same_night").alias("kind"), "venue", "date", "performers", F.lit(None).cast("array<string>").alias("dates"))
    rhythm = irregular_recurrences(events).select(F.lit("irregular_recurrence").alias("kind"), "venue", F.lit(None).cast("string").alias("date"), F.array("performer").alias("performers"), "dates")
    return nights.unionByName(rhythm)


def filtered(events: DataFrame, venues: list[str] | None = None, performers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events of the chosen venues, performers and dates (inclusive, as text); what isn't chosen doesn't filter."""
    for column, chosen in (("venue", venues), ("performer", performers)):
        if chosen:
            events = events.filter(F.col(column).isin(*chosen))
    if start is not None:
        events = events.filter(F.col("date") >= start)
    return events if end is None else events.filter(F.col("date") <= end)


def recanonicalized(events: DataFrame, obs: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(events, observations) with a field in canonical spelling. Events that now have one identity become the one with
    the least id, which keeps what it has stored; its name is made anew if it or its spelling changed. All derived
    columns are computed again from the observations that are left once repeated ones have gone."""
    moved = checkpoint(renamed(events.withColumn("_old", F.col("identity_key")), field))
    names = moved.select(F.col("_old"), F.col("identity_key").alias("_new"), F.col(field).alias("_value"))
    obs = obs.join(names, obs["identity_key"] == names["_old"]).withColumn("identity_key", F.col("_new")).withColumn(field, F.col("_value")).drop("_old", "_new", "_value")
    obs = checkpoint(distinct_observations(obs))
    grown = moved.groupBy("identity_key").agg(F.max(F.col("renamed") | F.col("merged")).alias("_grown"))
    kept = moved.filter(~F.col("merged")).join(grown, "identity_key")
    named = F.concat("performer", F.lit(" at "), "venue")
    kept = kept.withColumn("name", F.when(F.col("_grown") & (or_empty("performer") != ""), F.coalesce(named, "name")).otherwise(F.col("name")))
    return checkpoint(recomputed(kept.select(events.columns), obs)), obs


def finalize(events: DataFrame, obs: DataFrame, cutoff: str, aggregator: str = "aggregator") -> tuple[DataFrame, DataFrame]:
    """The whole chain in its order: conflicts, relistings, spellings, slots, times, non-music, dates.

    The events that a rule has left are written before the next reads them, so no rule's work is repeated in another's
    plan. Observations are not: rules read few of their columns, and what goes is left out by joins on one key.
    """

    def without(gone: DataFrame) -> tuple[DataFrame, DataFrame]:
        keys = checkpoint(gone.select("identity_key").distinct())
        return events.join(keys, "identity_key", "left_anti"), obs.join(keys, "identity_key", "left_anti")

    obs = checkpoint(obs)
    events, obs = without(site_over_aggregator(checkpoint(events), obs, aggregator).filter("drop"))
    events, obs = without(stale_url_relistings(checkpoint(events), obs))
    events, obs = without(stale_image_relistings(checkpoint(events), obs))
    for field in ("venue", "performer"):
        events, obs = recanonicalized(events, obs, field)
    events = normalize_stored_times(backfill_default_times(events).drop("changed")).drop("changed")
    events = checkpoint(not_past(dated(only_music(events)), cutoff))
    obs = normalize_stored_times(obs).drop("changed")
    return events, obs.join(events.select("identity_key"), "identity_key", "left_semi")
