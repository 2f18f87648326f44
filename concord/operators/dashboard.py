"""What the dashboard, the workbook and the terminal show, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions.scores import band, rounded
from concord.functions.text import col, or_empty, strip
from concord.functions.times import short_date
from concord.operators.aggregate import best_url, with_observations
from concord.operators.featured import is_favorite
from concord.operators.changes import change_summary, event_line
from concord.operators.featured import by_venue, sheet


def looked_up(c: Column | str, values: dict[str, str], default: Column) -> Column:
    """The value of a name without regard to case and edge space, or the default."""
    if not values:
        return default
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(or_empty(strip(c)))), default)


def venue_class(c: Column | str, classes: dict[str, str] | None = None) -> Column:
    return looked_up(c, fixed.VENUE_CLASSES if classes is None else classes, F.lit(fixed.DEFAULT_VENUE_CLASS))


def venue_shown(c: Column | str, names: dict[str, str] | None = None) -> Column:
    return looked_up(c, fixed.VENUE_SHORT_NAMES if names is None else names, or_empty(strip(c)))


def band_class(c: Column | str) -> Column:
    return looked_up(band(c), fixed.BAND_CLASSES, F.lit(fixed.DEFAULT_BAND_CLASS))


def form_encoded(c: Column) -> Column:
    """As a query string's value: letters, digits and _.-~ stay, a space becomes +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def map_links(c: Column | str, searches: dict[str, str] | None = None) -> Column:
    """struct(embed, external): links to a map of the venue; nulls without a venue."""
    there = or_empty(strip(c)) != ""
    query = form_encoded(looked_up(c, fixed.VENUE_MAP_SEARCHES if searches is None else searches, or_empty(strip(c))))
    before, after = fixed.MAP_EMBED
    embed = F.concat(F.lit(before), query, F.lit(after))
    return F.struct(F.when(there, embed).alias("embed"), F.when(there, F.concat(F.lit(fixed.MAP_SEARCH), query)).alias("external"))


def time_shown(start: Column | str = "time_start", end: Column | str = "time_end") -> Column:
    return F.concat_ws(" - ", F.nullif(col(start), F.lit("")), F.nullif(col(end), F.lit("")))


def favorite_flags(events: DataFrame, venues: DataFrame, performers: DataFrame) -> DataFrame:
    """events with favorite and performer_favorite, Y or N; names match without case and edge space, later roster rows win."""
    name = lambda c: F.lower(or_empty(strip(c)))
    liked = venues.select(name("venue").alias("_v")).filter("_v != ''").distinct().withColumn("_vf", F.lit("Y"))
    roster = performers.groupBy(name("performer").alias("_p")).agg(F.max_by(F.when(is_favorite(), "Y").otherwise("N"), "ord").alias("_pf"))
    rows = events.withColumn("_v", name("venue")).withColumn("_p", name(F.coalesce(F.nullif("performer", F.lit("")), F.col("name"))))
    rows = rows.join(liked, "_v", "left").join(roster, "_p", "left")
    return rows.withColumn("favorite", F.coalesce("_vf", F.lit("N"))).withColumn("performer_favorite", F.coalesce("_pf", F.lit("N"))).drop("_v", "_p", "_vf", "_pf")


def dashboard_rows(events: DataFrame, obs: DataFrame, venues: DataFrame, performers: DataFrame, key: str = "identity_key", classes: dict[str, str] | None = None, names: dict[str, str] | None = None, searches: dict[str, str] | None = None, fallback: dict[str, str] | None = None) -> DataFrame:
    """One row per event as the dashboard shows it, by date and id: names, links, flags, scores, and what each source says."""
    rows = with_observations(best_url(events, obs, fixed.VENUE_FALLBACK_URLS if fallback is None else fallback, key), obs, key)
    rows = favorite_flags(rows, venues, performers).withColumn("links", map_links("venue", searches))
    said = F.transform(
        "observations",
        lambda o: F.struct(o["source"].alias("source"), o["observation_type"].alias("kind"), o["url"].alias("url"), o["time_start"].alias("time"), rounded(o["confidence"], 2).alias("confidence"), F.substring(o["observed_at"], 1, 10).alias("seen")),
    )
    shown = F.when(F.col("confidence").isNull(), F.lit("—")).otherwise(F.format_string("%.2f", rounded(F.col("confidence"), 2)))
    return rows.orderBy(or_empty("date"), "id").select(
        key, "id", "date", F.coalesce(F.nullif("performer", F.lit("")), F.col("name"), F.lit("")).alias("performer"), or_empty("venue").alias("venue"), venue_shown("venue", names).alias("venue_shown"), venue_class("venue", classes).alias("venue_class"),
        "favorite", "performer_favorite", "links.embed", "links.external", or_empty("best_url").alias("url"), short_date("date").alias("date_shown"), time_shown().alias("time_shown"), shown.alias("confidence_shown"),
        band_class("confidence").alias("band_class"), F.when(F.col("conflict_flag") == 1, F.col("conflict_reason")).alias("conflict"), said.alias("said"),
    )


def changes_sheet(changes: DataFrame) -> dict[str, DataFrame]:
    """The counts of a comparison, and its new events by name."""
    new = changes.filter("status = 'new'")
    cells = [F.coalesce(F.nullif("after.performer", F.lit("")), F.col("after.name"), F.lit("")).alias("performer"), *[or_empty(f"after.{c}").alias(c) for c in ("date", "time_start", "venue", "stage")]]
    return {"counts": change_summary(changes).select("new", "changed", "removed", "unchanged"), "new": new.select(*cells).orderBy("date", "performer")}


def report(events: DataFrame, changes: DataFrame, today: str) -> dict[str, DataFrame]:
    """The workbook's sheets by name."""
    upcoming = events.filter(or_empty("date") >= today)
    listed = changes_sheet(changes)
    return {"All Events": sheet(events, today), "Upcoming": sheet(upcoming, today), "Changes": listed["counts"], "Changes: new": listed["new"], "By Venue": by_venue(events)}


def first_new(changes: DataFrame, most: int = 5) -> DataFrame:
    """The first new events of a run in order of id, a line each, for its summary on the terminal."""
    return changes.filter("status = 'new'").orderBy("after.id").limit(most).select("identity_key", event_line("after.").alias("line"))


def run_summary(counters: dict[str, int], changes: DataFrame, most: int = 5) -> list[str]:
    """What a run prints: its counters, the counts of changes, and a few new events."""
    n = change_summary(changes).first()
    lines = [f"{name}: {value}" for name, value in counters.items()]
    if not n["total_delta"]:
        return [*lines, "No changes since last run."]
    return [*lines, f"{n['new']} new, {n['changed']} changed, {n['removed']} removed", *[r["line"] for r in first_new(changes, most).collect()]]


def venue_classes(rows: DataFrame, order: str = "ord") -> DataFrame:
    """venue, venue_class: the first class that a curated listing gives each venue."""
    there = (or_empty("venue") != "") & (or_empty("venue_class") != "")
    return rows.filter(there).groupBy("venue").agg(F.min_by("venue_class", order).alias("venue_class"))
