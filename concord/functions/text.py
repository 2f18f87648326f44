"""String expressions shared by the other functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of every kind, as Java's and RE2's patterns both write it.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ENDS = f"^{SPACE}+|{SPACE}+$"
#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, where value is computed once however often body uses it, and its expression is not repeated."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def strip(c: Column | str) -> Column:
    """Without white space at either end, of every kind. A column given by name is trimmed only where its first or last
    character is none of ASCII's visible ones, as looking for every kind costs more than most expressions."""
    value = col(c)
    trimmed = F.trim(value, F.lit(SPACES))
    if not isinstance(c, str):
        return trimmed
    value = value.cast("string")
    seen = lambda x: (x >= "!") & (x < "\x7f")
    return F.when(seen(value) & seen(F.substring(value, -1, 1)), value).otherwise(trimmed)


def blank(c: Column | str) -> Column:
    """True for null and for what is empty once stripped."""
    return F.coalesce(strip(c) == "", F.lit(True))


def none_if_blank(c: Column | str) -> Column:
    return F.when(~blank(c), col(c))


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def group(c: Column | str, pattern: str, n: int = 1) -> Column:
    """A group of the first match, or null where there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(col(c), pattern, n), F.lit(""))


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '{ENDS}', '', 'g')"
