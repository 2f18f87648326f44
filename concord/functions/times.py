"""Clock times and dates as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.fixed_values import MISSING_TIMES, VENUE_DEFAULT_TIMES
from concord.functions.text import col, group, let, or_empty, strip

# The grammar of clock times.
RANGE_24 = r"^(\d{1,2}):(\d{2})\s*[-–]\s*(\d{1,2}):(\d{2})$"
SINGLE_24 = r"^(\d{1,2}):(\d{2})$"
ZONE = r"(?i)\s+(?:CT|CST|CDT|ET|EST|EDT|MT|MST|MDT|PT|PST|PDT)\s*$"
BETWEEN = r"(?i)\s*-\s*|\s*–\s*|\s+to\s+"
TOKEN = r"(?i)^(\d{1,2})(?::(\d{2}))?\s*(?:([ap])\.?m\.?)?$"
START_RANGE = r"(?i)^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*[-–]\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$"
START_SINGLE = r"(?i)^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$"
TIME_RANGE = r"(?i)(\d{1,2}:\d{2}\s*[ap]m)\s*to\s*(\d{1,2}:\d{2}\s*[ap]m)"
BARE_TIME = r"(?i)(\d{1,2}:\d{2}\s*[ap]m)"
#: The form that other times are brought to.
PLAIN = r"^(?:[1-9]|1[0-2]):[0-5]\d [AP]M$"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def whole(c: Column) -> Column:
    return c.try_cast("int")


def twelve_hour(hour: Column, minute: Column) -> Column:
    h = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    return F.concat(h.cast("string"), F.lit(":"), minute, F.when(hour < 12, F.lit(" AM")).otherwise(F.lit(" PM")))


def to_twelve(t: Column) -> Column:
    """normalize_time of a stripped value."""
    part = lambda p, n: F.regexp_extract(t, p, n)
    hour = lambda p, n: whole(part(p, n))
    first, last = F.substring_index(t, ":", 1), F.substring_index(t, ":", -1)
    both = F.concat(twelve_hour(hour(RANGE_24, 1), part(RANGE_24, 2)), F.lit(" - "), twelve_hour(hour(RANGE_24, 3), part(RANGE_24, 4)))
    one = twelve_hour(whole(first), last)
    has = F.upper(t).contains("AM") | F.upper(t).contains("PM")
    return F.when(has, t).when(t.rlike(RANGE_24), both).when(t.rlike(SINGLE_24), one).otherwise(t)


def normalize_time(c: Column | str) -> Column:
    """24-hour times and ranges in 12-hour form; what has AM or PM anywhere, or is no time, is only stripped."""
    return let(strip(c), to_twelve)


def token(t: Column) -> Column:
    """hour, minute, meridiem (A, P or null) of one side of a range; null if it is none."""
    return F.when(t.rlike(TOKEN), F.struct(whole(F.regexp_extract(t, TOKEN, 1)).alias("h"), F.coalesce(whole(F.regexp_extract(t, TOKEN, 2)), F.lit(0)).alias("m"), F.upper(group(t, TOKEN, 3)).alias("mer")))


def shown(t: Column, meridiem: Column) -> Column:
    return F.format_string("%d:%02d %s", t["h"], t["m"], F.when(meridiem == "A", F.lit("AM")).otherwise(F.lit("PM")))


def zoneless(c: Column | str) -> Column:
    return strip(F.regexp_replace(strip(c), ZONE, ""))


def sides(s: Column) -> Column:
    """struct(a, b): the tokens of the one or two sides; two tells whether there are two."""
    return let(F.split(s, BETWEEN, 2), lambda p: F.struct(token(strip(p[0])).alias("a"), token(strip(F.try_element_at(p, F.lit(2)))).alias("b"), (F.size(p) == 2).alias("two")))


def range_of(original: Column, parsed: Column) -> Column:
    """struct(start, end) from a value and its sides; a side without meridiem takes the other's."""
    a, b, two = parsed["a"], parsed["b"], parsed["two"]
    mer1, mer2 = F.coalesce(a["mer"], b["mer"]), F.coalesce(b["mer"], a["mer"])
    good = F.coalesce(a.isNotNull() & F.when(two, b.isNotNull() & mer1.isNotNull()).otherwise(a["mer"].isNotNull()), F.lit(False))
    return F.struct(F.when(good, shown(a, mer1)).otherwise(original).alias("start"), F.when(good & two, shown(b, mer2)).alias("end"))


def split_time_range(c: Column | str) -> Column:
    """struct(start, end): a time or a range in H:MM AM/PM form; what can't be read comes back as the start, unchanged."""
    return let(F.struct(col(c).alias("v"), sides(zoneless(c)).alias("p")), lambda x: range_of(x["v"], x["p"]))


def format_time_range(c: Column | str) -> Column:
    return let(split_time_range(c), lambda t: F.when(t["end"].isNotNull(), F.concat(t["start"], F.lit(" - "), t["end"])).otherwise(t["start"]))


def minutes(h: Column, m: Column, meridiem: Column) -> Column:
    mer = F.lower(F.coalesce(meridiem, F.lit("")))
    hour = F.when((mer == "pm") & (h != 12), h + 12).when((mer == "am") & (h == 12), F.lit(0)).otherwise(h)
    m = F.coalesce(m, F.lit(0))
    return F.when((hour <= 23) & (m <= 59), hour * 60 + m)


def plain_minutes(s: Column) -> Column:
    """start_minutes of a time of the form PLAIN."""
    return whole(F.substring_index(s, ":", 1)) % 12 * 60 + whole(F.substring(s, -5, 2)) + F.when(F.endswith(s, F.lit("PM")), F.lit(720)).otherwise(F.lit(0))


def minutes_of(s: Column) -> Column:
    """start_minutes of a stripped value."""
    r = lambda n: F.regexp_extract(s, START_RANGE, n)
    end_mer = F.coalesce(group(s, START_RANGE, 6), group(s, START_RANGE, 3))
    flipped = F.when(F.lower(end_mer) == "pm", F.lit("am")).otherwise(F.lit("pm"))
    inferred = F.when(end_mer.isNotNull(), F.when(whole(r(1)) % 12 <= whole(r(4)) % 12, end_mer).otherwise(flipped))
    in_range = minutes(whole(r(1)), whole(r(2)), F.coalesce(group(s, START_RANGE, 3), inferred))
    single = minutes(whole(F.regexp_extract(s, START_SINGLE, 1)), whole(F.regexp_extract(s, START_SINGLE, 2)), group(s, START_SINGLE, 3))
    return F.when(s.rlike(PLAIN), plain_minutes(s)).when(F.lower(s) == "noon", F.lit(720)).when(F.lower(s) == "midnight", F.lit(0)).when(s.rlike(START_RANGE), in_range).when(s.rlike(START_SINGLE), single)


def start_minutes(c: Column | str) -> Column:
    """Minutes past midnight at which a time or range starts, or null."""
    return let(strip(c), minutes_of)


def times_conflict(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(start_minutes(a) != start_minutes(b), F.lit(False))


def apply_venue_default_time(venue: Column | str, time: Column | str, slots: dict[str, str] | None = None) -> Column:
    """The venue's usual slot where no usable time is given."""
    slots = VENUE_DEFAULT_TIMES if slots is None else slots
    default = F.lit(None).cast("string")
    for name, slot in slots.items():
        default = F.when(col(venue) == name, F.lit(slot)).otherwise(default)
    return F.when(F.upper(or_empty(strip(time))).isin(MISSING_TIMES), F.coalesce(default, col(time))).otherwise(col(time))


def current_week_date(day: Column | str, today: Column | str) -> Column:
    """The named weekday's date in the Sunday to Saturday week of today."""
    index = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.initcap(strip(day))).cast("int")
    return F.when(index > 0, F.date_add(F.date_sub(col(today), F.dayofweek(col(today)) - 1), index % 7))


def anchored_date(day: Column | str, anchor: Column | str) -> Column:
    """The named weekday's date in the Monday to Sunday week of the anchor."""
    index = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.initcap(strip(day))).cast("int")
    return F.when(index > 0, F.date_add(col(anchor), index - 1 - F.weekday(col(anchor))))


def iso_of(s: Column) -> Column:
    named = F.initcap(F.lower(s))
    long = F.when(s.rlike(r"^[A-Za-z]+ +\d{1,2}, *\d{4}$"), F.try_to_timestamp(F.regexp_replace(named, " *,? +", " "), F.lit("MMMM d yyyy")))
    numeric = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(s, F.lit("M/d/yyyy")))
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(s, F.lit("yyyy-M-d")))
    return F.date_format(F.coalesce(long, numeric, iso), "yyyy-MM-dd")


def parse_when(c: Column | str) -> Column:
    """An ISO date from the long, short and numeric forms that listings use, or null. A weekday before the date is ignored."""
    return let(F.regexp_replace(strip(c), r"(?i)^(?:mon|tues|wednes|thurs|fri|satur|sun)day,?\s+", ""), iso_of)


def parse_lineup_date(c: Column | str, year: Column | str) -> Column:
    """parse_when; else with the page's year where the cell has no year of its own."""
    own = parse_when(c)
    with_year = parse_when(F.concat(strip(c), F.lit(", "), col(year).cast("string")))
    return F.coalesce(own, F.when(~col(c).rlike(r"\b\d{4}\b"), with_year))


def cell_time(c: Column | str) -> Column:
    """struct(start, end): an 'X to Y' range, else a bare time."""
    start = F.coalesce(group(c, TIME_RANGE, 1), group(c, BARE_TIME, 1))
    return F.struct(strip(start).alias("start"), strip(group(c, TIME_RANGE, 2)).alias("end"))


def parse_time(c: Column | str) -> Column:
    """struct(start, end): an 'X to Y' range, else what follows 'Time:' to the end of the line."""
    label = strip(group(c, r"Time:\s*([^\n]+)", 1))
    return F.struct(F.coalesce(strip(group(c, TIME_RANGE, 1)), label).alias("start"), strip(group(c, TIME_RANGE, 2)).alias("end"))


def clock(c: Column | str) -> Column:
    """5:00 pm"""
    return F.lower(F.date_format(col(c), "h:mm a"))


def split_datetime(c: Column | str) -> Column:
    """struct(date, time) of 'YYYY-MM-DD HH:MM:SS' or with a T between; nulls if it is neither."""
    p = r"^(\d{4}-\d{2}-\d{2})[\sT]+(\d{2}):(\d{2}):\d{2}$"
    s = strip(c)
    h = whole(F.regexp_extract(s, p, 2))
    at = F.concat(F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12).cast("string"), F.lit(":"), F.regexp_extract(s, p, 3), F.when(h < 12, F.lit(" am")).otherwise(F.lit(" pm")))
    return F.struct(group(s, p, 1).alias("date"), F.when(s.rlike(p), at).alias("time"))


def parse_utc(c: Column | str, zone: str = "America/Chicago") -> Column:
    """A calendar feed's UTC stamp as local time without zone; null if it isn't one."""
    stamp = F.when(col(c).rlike(r"^\s*\d{8}T\d{6}Z$"), F.try_to_timestamp(strip(c), F.lit("yyyyMMdd'T'HHmmss'Z'")))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), stamp.cast("timestamp_ntz"))


def short_date(c: Column | str) -> Column:
    """Sat Aug 08; what is no date comes back unchanged, null as ''."""
    d = F.when(col(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), col(c).try_cast("date"))
    return F.coalesce(F.date_format(d, "EEE MMM dd"), or_empty(c))


def ordinal_date(c: Column | str) -> Column:
    """July 23rd, 2026"""
    day = F.dayofmonth(col(c))
    end = F.when((day % 100).between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return F.concat(F.date_format(col(c), "MMMM "), day.cast("string"), end, F.date_format(col(c), ", yyyy"))


def valid_date(c: Column | str) -> Column:
    s = strip(c)
    return F.coalesce(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & s.try_cast("date").isNotNull(), F.lit(False))
