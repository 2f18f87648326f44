"""Raw rows to observations: one ordered chain of native projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.names import apply_venue_alias, canonicalize, checksum, fold_typography, identity_key, spelled, type_of
from concord.functions.scores import extraction_confidence, rounded, trust_of
from concord.functions.text import none_if_blank, or_empty, strip
from concord.functions.times import PLAIN, apply_venue_default_time, format_time_range, minutes_of, range_of, sides, to_twelve, zoneless

#: The wire contract: columns of raw rows; a source may leave any out.
RAW = {
    "id": "long", "name": "string", "performer": "string", "venue": "string", "date": "string", "time": "string", "time_start": "string", "time_end": "string",
    "stage": "string", "url": "string", "source": "string", "observation_type": "string", "model_confidence": "double", "extraction_method": "string", "observed_at": "string",
}
#: Columns of observations that aggregation needs.
OBSERVATION = ["id", "identity_key", "name", "performer", "venue", "date", "time_start", "time_end", "stage", "url", "source", "observation_type", "source_confidence", "extraction_confidence", "confidence", "checksum", "observed_at", "start_minutes"]


def complete(raw: DataFrame) -> DataFrame:
    """raw with every column of RAW, null where it has none."""
    return raw.select(*[F.col(c).cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in RAW.items()])


def without_suffix(performer: Column, venue: Column) -> Column:
    """The performer without a redundant ' at <venue>' at its end."""
    suffix = F.concat(F.lit(" at "), venue)
    cut = strip(F.substring(performer, F.lit(1), F.length(performer) - F.length(suffix)))
    ends = F.endswith(F.lower(performer), F.lower(suffix))
    return F.when(venue.isNotNull() & ends, F.coalesce(none_if_blank(canonicalize(cut)), performer)).otherwise(performer)


def observations(raw: DataFrame, trust: dict[str, float] | None = None) -> DataFrame:
    """Rows with a performer and an ISO date, normalised and scored.

    Each step's result is a column that the next ones use, so no expression is repeated inside another.
    """
    rows = complete(raw)
    # A filter goes below the columns that it reads, and would compute them again: this one reads a cheap one.
    rows = rows.withColumn("_plain", fold_typography(or_empty(strip("performer")))).filter("_plain != ''")
    rows = rows.withColumn("performer", spelled("_plain"))
    rows = rows.filter(or_empty(strip("date")).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    rows = rows.withColumn("_plain", fold_typography(or_empty(strip("venue"))))
    rows = rows.withColumn("venue", spelled("_plain"))
    rows = rows.withColumn("venue", none_if_blank("venue"))
    rows = rows.withColumn("performer", without_suffix(F.col("performer"), F.col("venue")))
    rows = rows.withColumn("performer", apply_venue_alias("performer", "venue"))
    rows = rows.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("crawler")))
    rows = rows.withColumn("_source", F.lower(or_empty(strip("source"))))
    rows = rows.withColumn("observation_type", F.coalesce(F.nullif("observation_type", F.lit("")), type_of(F.col("_source"))))
    rows = rows.withColumn("_time", F.coalesce(F.nullif("time_start", F.lit("")), F.col("time")))
    rows = rows.withColumn("_time", strip("_time"))
    rows = rows.withColumn("_time", to_twelve(F.col("_time")))
    rows = rows.withColumn("_time", apply_venue_default_time("venue", "_time"))
    rows = rows.withColumn("_plain", F.coalesce(F.col("_time").rlike(PLAIN), F.lit(False)))
    rows = rows.withColumn("_sides", F.when(~F.col("_plain"), sides(zoneless("_time"))))
    rows = rows.withColumn("_range", F.when(F.col("_plain"), F.struct(F.col("_time").alias("start"), F.lit(None).cast("string").alias("end"))).otherwise(range_of(F.col("_time"), F.col("_sides"))))
    end = F.nullif("time_end", F.lit(""))
    rows = rows.withColumn("time_start", F.col("_range.start")).withColumn("time_end", F.when(end.isNull(), F.coalesce("_range.end", "time_end")).otherwise(format_time_range("time_end")))
    rows = rows.withColumn("_time", strip("time_start"))
    rows = rows.withColumn("start_minutes", minutes_of(F.col("_time")))
    named = F.when(F.col("venue").isNotNull(), F.concat("performer", F.lit(" at "), "venue")).otherwise(F.col("performer"))
    rows = rows.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), named))
    rows = rows.withColumn("source_confidence", trust_of(F.col("_source"), trust)).withColumn("extraction_confidence", extraction_confidence())
    rows = rows.withColumn("confidence", rounded(F.col("source_confidence") * F.col("extraction_confidence")))
    return rows.withColumn("checksum", checksum()).withColumn("identity_key", identity_key()).select(OBSERVATION)
