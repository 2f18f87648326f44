"""Canonical spellings, identities and content hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions.text import col, let, or_empty, strip


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def fold_typography(c: Column | str) -> Column:
    return F.translate(col(c), fixed.FANCY_CHARACTERS, fixed.PLAIN_CHARACTERS)


def title_case(word: Column) -> Column:
    """Every run of letters with a first capital; contractions stay small."""
    runs = F.split(word, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
    out = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), fixed.LOWER_ENDINGS.items(), out)


def fold_all_caps(c: Column | str) -> Column:
    value = col(c)
    capitals = (F.upper(value) == value) & (F.lower(value) != value)
    words = F.transform(F.split(value, " "), lambda w: F.when(w.isin(fixed.CAPITAL_TOKENS), w).otherwise(title_case(w)))
    return F.when(capitals, F.array_join(words, " ")).otherwise(value)


def canonicalize(c: Column | str, spellings: list[tuple[str, str]] | None = None) -> Column:
    """The known spelling of a variant, else typography and capitals folded; null and '' stay."""
    return F.when(or_empty(c) == "", col(c)).otherwise(let(fold_typography(strip(c)), lambda folded: spelled(folded, spellings)))


def spelled(folded: Column | str, spellings: list[tuple[str, str]] | None = None) -> Column:
    """canonicalize of a stripped value with folded typography; it is empty only where that is."""
    known = {variant.strip().lower(): canonical for canonical, variant in (fixed.SPELLINGS if spellings is None else spellings)}
    return F.coalesce(F.try_element_at(literal_map(known), F.lower(col(folded))), fold_all_caps(folded)) if known else fold_all_caps(folded)


def apply_venue_alias(performer: Column | str, venue: Column | str, aliases: dict[tuple[str, str], str] | None = None) -> Column:
    p, v, out = F.lower(strip(performer)), F.lower(or_empty(strip(venue))), col(performer)
    for (short, place), full in (fixed.VENUE_ALIASES if aliases is None else aliases).items():
        out = F.when((p == short) & (v == place), F.lit(full)).otherwise(out)
    return out


def identity_key(performer: Column | str = "performer", venue: Column | str = "venue", date: Column | str = "date") -> Column:
    return F.concat(F.lower(or_empty(strip(performer))), F.lit("|"), F.lower(or_empty(strip(venue))), F.lit("|"), or_empty(strip(date)))


def ascii_identity_key(performer: Column | str = "performer", venue: Column | str = "venue", date: Column | str = "date") -> Column:
    """identity_key as older stores made it in SQL: only A to Z go to lower case, and only spaces are stripped."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    part = lambda c: F.translate(F.trim(or_empty(c)), capitals, capitals.lower())
    return F.concat(part(performer), F.lit("|"), part(venue), F.lit("|"), F.trim(or_empty(date)))


def signature() -> Column:
    """What must differ for an event to count as changed."""
    fields = ["name", "date", "time_start", "time_end", "venue", "performer", "stage"]
    return F.concat_ws("|", *[F.lower(or_empty(strip(f))) for f in fields])


def checksum() -> Column:
    """Sixteen hexadecimal digits of what one source asserts."""
    parts = [F.lower(or_empty("performer")), F.lower(or_empty("venue")), or_empty(strip("date")), F.upper(or_empty(strip("time_start"))), F.upper(or_empty(strip("time_end"))), F.lower(or_empty(strip("stage"))), F.lower(or_empty(strip("source")))]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def observation_type(source: Column | str) -> Column:
    return type_of(F.lower(or_empty(strip(source))))


def type_of(s: Column) -> Column:
    """observation_type of a stripped source in lower case."""
    return F.when(s.startswith("image:"), "image").when(s.startswith("ocr"), "ocr").when(s.isin("instagram", "facebook"), "social").when(s == "seed", "manual").otherwise("website")


def match_venue(c: Column | str) -> Column:
    """The venue that a line of read text mentions, by the first rule that holds."""
    upper, out = F.upper(or_empty(c)), F.lit(None).cast("string")
    for venue, ways in reversed(fixed.VENUE_KEYWORDS):
        test = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [upper.startswith(k[1:]) if k[0] == "^" else upper.contains(k) for k in way]) for way in ways])
        out = F.when(test, F.lit(venue)).otherwise(out)
    return out


def unescape_ics(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("\\N", "\n"), ("\\n", "\n"), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_html(c: Column | str) -> Column:
    out = F.regexp_replace(or_empty(c), r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&rsquo;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return strip(F.regexp_replace(out, r"\s+", " "))


def escape_html(c: Column | str) -> Column:
    out = or_empty(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def absolutize(c: Column | str, host: str) -> Column:
    return F.when(col(c).startswith("/"), F.concat(F.lit(host), col(c))).otherwise(col(c))


def artist_of_file(c: Column | str) -> Column:
    """A file's stem with spaces for underscores, in title case."""
    return title_case(F.replace(F.regexp_extract(col(c), r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_"), F.lit(" ")))
