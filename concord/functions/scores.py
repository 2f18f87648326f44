"""Trust, completeness and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions.text import blank, col, or_empty, strip
from concord.functions.times import valid_date


def rounded(c: Column, digits: int = 3) -> Column:
    """Half up on the binary value, the same operations as the SQL twin's, so both agree to the bit."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def sql_rounded(x: str, digits: int = 3) -> str:
    return f"(floor(({x}) * {10**digits}.0 + 0.5) / {10**digits}.0)"


def source_trust(source: Column | str, trust: dict[str, float] | None = None) -> Column:
    return trust_of(F.lower(or_empty(strip(source))), trust)


def trust_of(s: Column, trust: dict[str, float] | None = None) -> Column:
    """source_trust of a stripped source in lower case."""
    out = F.lit(fixed.DEFAULT_TRUST)
    for name, value in (fixed.SOURCE_TRUST if trust is None else trust).items():
        out = F.when(s == name, F.lit(value)).otherwise(out)
    for prefix, value in reversed(fixed.SOURCE_PREFIX_TRUST):
        out = F.when(s.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def completeness(date: str = "date", time_start: str = "time_start", venue: str = "venue", performer: str = "performer") -> Column:
    there = [valid_date(date), ~blank(time_start), ~blank(venue), ~blank(performer)]
    return sum((x.cast("int") for x in there), F.lit(0)) / 4.0


def method_factor(c: Column | str = "extraction_method") -> Column:
    out = F.lit(1.0)
    for method, value in fixed.METHOD_FACTOR.items():
        out = F.when(col(c) == method, F.lit(value)).otherwise(out)
    return out


def clamped(c: Column | str) -> Column:
    """A model's own confidence within 0 and 1, or null."""
    value = col(c).try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def extraction_confidence(model: Column | str = "model_confidence", method: Column | str = "extraction_method") -> Column:
    base = 0.5 + 0.5 * completeness()
    return rounded(F.when(col(model).isNotNull(), 0.5 * base + 0.5 * clamped(model)).otherwise(base) * method_factor(method))


def band(c: Column | str) -> Column:
    return F.when(col(c).isNull(), "unknown").when(col(c) >= fixed.HIGH_BAND, "high").when(col(c) >= fixed.MEDIUM_BAND, "medium").otherwise("low")


def score_reason(source: Column | str = "source", model: Column | str = "model_confidence", trust: dict[str, float] | None = None) -> Column:
    trust, extraction = source_trust(source, trust), extraction_confidence(model)
    text = F.format_string("source=%s (trust %.2f); extraction %.2f", F.coalesce(F.nullif(col(source), F.lit("")), F.lit("unknown")), rounded(trust, 2), rounded(extraction, 2))
    return F.concat(text, F.when(col(model).isNotNull(), F.format_string("; model %.2f", rounded(col(model).cast("double"), 2))).otherwise(F.lit("")))
