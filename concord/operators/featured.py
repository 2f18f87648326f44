"""Picks among favourites, and listings for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.scores import band, rounded
from concord.functions.text import or_empty, strip
from concord.functions.times import short_date

UNLISTED = 1 << 30


def is_favorite(c: str = "favorite") -> Column:
    """Whether a roster's mark says yes, in either case."""
    return F.upper(or_empty(strip(c))) == "Y"


def featured(events: DataFrame, venues: DataFrame, performers: DataFrame, start: str, end: str, all_ties: bool = False, all_performers: bool = False) -> DataFrame:
    """The favourites between two dates, inclusive, best first, as `place` 1, 2, ...

    venues (venue): favourite ones. performers (performer, favorite, ord): a roster in order, of which some are
    favourites. Tiers: both 0, performer 1, venue 2; others never appear. One row, unless all_ties and the best tier
    is 0 (then all of it), or all_performers and there is a favourite performer (then all of those, by date first).
    The rosters are small and written by hand; Spark broadcasts them if it finds them so.
    """
    lowered = lambda c: F.lower(or_empty(strip(c)))
    own = events.filter(F.coalesce("date", F.lit("")).between(start, end)).withColumn("_p", lowered(F.coalesce(F.nullif("performer", F.lit("")), F.col("name")))).withColumn("_v", lowered("venue"))
    liked = venues.select(lowered("venue").alias("_v")).distinct().withColumn("venue_favorite", F.lit(True))
    roster = performers.groupBy(lowered("performer").alias("_p")).agg(F.max_by(is_favorite(), "ord").alias("performer_favorite"), F.max("ord").alias("_order"))
    rows = own.join(liked, "_v", "left").join(roster, "_p", "left").fillna(False, ["venue_favorite", "performer_favorite"]).fillna(UNLISTED, ["_order"])
    tier = F.when(F.col("performer_favorite") & F.col("venue_favorite"), 0).when(F.col("performer_favorite"), 1).when(F.col("venue_favorite"), 2).otherwise(3)
    rows = rows.withColumn("tier", tier).filter("tier < 3")
    best = rows.agg(F.min("tier").alias("_best"), F.max("performer_favorite").alias("_any"))
    rows = rows.join(F.broadcast(best))  # one row
    by_tier = ["tier", "date", "_order", F.desc_nulls_last("confidence"), "id"]
    by_date = ["date", "tier", "_order", F.desc_nulls_last("confidence"), "id"]
    use_date = F.lit(all_performers) & F.coalesce("_any", F.lit(False))
    many = use_date | (F.lit(all_ties) & (F.col("_best") == 0))
    # The rows that can win are few (one tier of favourites in a date range); one task ranks them.
    rows = rows.filter(F.when(use_date, F.col("performer_favorite")).otherwise(F.col("tier") == F.col("_best")))
    order = by_date if all_performers else by_tier
    place = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("place", place).withColumn("_many", many).filter("_many OR place = 1").drop("_p", "_v", "_order", "_best", "_any", "_many")


def roster_names(events: DataFrame, column: str) -> DataFrame:
    """Distinct names that are not blank, in order without regard to case."""
    return events.select(strip(column).alias("name")).filter("name != ''").distinct().orderBy(F.lower("name"), "name")


def by_venue(events: DataFrame) -> DataFrame:
    """Rows in order of venue and date with a flag on each venue's first; events without venue come last."""
    venue, place = F.coalesce("venue", F.lit("zzz")), F.struct(or_empty("date").alias("date"), "id")
    first = events.groupBy(venue.alias("_venue")).agg(F.min(place).alias("_first"))
    rows = events.join(first, venue == F.col("_venue")).withColumn("group_start", place == F.col("_first")).drop("_venue", "_first")
    return rows.withColumn("venue_title", F.coalesce("venue", F.lit("Unknown Venue"))).orderBy(venue, or_empty("date"), "id")


def sheet(events: DataFrame, today: str) -> DataFrame:
    """A report's columns: weekday, date, scores with their band, and whether it is past."""
    d = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date").try_cast("date"))
    return events.select(
        "id", F.date_format(d, "EEEE").alias("day"), F.coalesce(F.date_format(d, "MMM dd, yyyy"), "date").alias("date_shown"), short_date("date").alias("short_date"), "performer", "venue", "time_start",
        F.when(F.col("confidence").isNotNull(), F.format_string("%.2f (%s)", rounded(F.col("confidence"), 2), band("confidence"))).otherwise("").alias("confidence_shown"), F.coalesce(F.col("date") < today, F.lit(False)).alias("is_past"),
    )


def notification(changes: DataFrame, source: str, most: int = 20) -> DataFrame:
    """At most `most` lines about one source's new and changed events, and one that counts the rest."""
    from concord.operators.changes import event_line

    rows = changes.filter(F.col("status").isin("new", "changed") & (F.col("after.source") == source))
    lines = rows.select(F.concat(F.upper("status"), F.lit(": "), event_line("after.")).alias("line"), F.struct(F.col("status") != "new", event_line("after.")).alias("o"))
    top = lines.orderBy("o").limit(most)
    rest = lines.agg((F.count("*") - most).alias("n")).filter("n > 0").select(F.format_string("...and %d more", "n").alias("line"), F.lit(None).cast(lines.schema["o"].dataType).alias("o"))
    return top.unionByName(rest).orderBy(F.col("o").asc_nulls_last()).select("line")
