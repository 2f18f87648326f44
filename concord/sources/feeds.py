"""Calendar, JSON and other structured feeds, rosters, and readers' output, as raw rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions.names import match_venue, unescape_ics
from concord.functions.scores import clamped
from concord.functions.text import blank, none_if_blank, or_empty, strip
from concord.functions.times import anchored_date, clock, current_week_date, parse_utc, split_datetime
from concord.functions.titles import json_feed_performer
from concord.session import checkpoint, ship


def ics_events(feeds: DataFrame, venue: str, source: str, zone: str = "America/Chicago", id_col: str = "feed_id", text_col: str = "text") -> DataFrame:
    """Events of iCalendar texts: folded lines joined, blocks cut, the last value of a key counts; no summary or UTC start, no event."""
    unfolded = F.regexp_replace(or_empty(text_col), r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(F.concat(F.lit("\n"), unfolded, F.lit("\n")), F.lit(r"(?s)\r?\nBEGIN:VEVENT\r?(?=\n)(.*?)\nEND:VEVENT\r?(?=\n)"), F.lit(1))
    rows = feeds.select(F.col(id_col), F.posexplode(blocks).alias("row", "block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.split(F.substring_index(x, ":", 1), ";", 2)[0].alias("k"), F.regexp_replace(x, r"(?s)^[^:]*:", "").alias("v")))
    rows = rows.withColumn("pairs", pairs)
    value = lambda k: F.try_element_at(F.filter("pairs", lambda p: p["k"] == k), F.lit(-1))["v"]
    start, end = parse_utc(value("DTSTART"), zone), parse_utc(value("DTEND"), zone)
    out = rows.select(id_col, "row", strip(unescape_ics(value("SUMMARY"))).alias("performer"), F.lit(venue).alias("venue"), F.date_format(start, "yyyy-MM-dd").alias("date"), clock(start).alias("time_start"), clock(end).alias("time_end"), F.nullif(value("URL"), F.lit("")).alias("url"), F.lit(source).alias("source"), F.lit("website").alias("observation_type"))
    return out.filter(~blank("performer") & F.col("date").isNotNull()).withColumn("name", F.concat("performer", F.lit(" at "), "venue"))


JSON_PAGE = "struct<events:array<struct<summary:string,timezoneStart:string,timezoneEnd:string,longDescription:string,url:string>>,pages:struct<nextPage:string>>"


def json_events(pages: DataFrame, venue: str, source: str, payload: str = "payload", id_col: str = "page_no") -> DataFrame:
    """Events of JSON pages; malformed pages have none."""
    rows = pages.select(id_col, F.posexplode(F.from_json(payload, JSON_PAGE)["events"]).alias("row", "e"))
    start, end = split_datetime("e.timezoneStart"), split_datetime("e.timezoneEnd")
    who = json_feed_performer("e.summary", "e.longDescription", start["date"])
    out = rows.select(id_col, "row", who.alias("performer"), F.lit(venue).alias("venue"), start["date"].alias("date"), start["time"].alias("time_start"), end["time"].alias("time_end"), F.col("e.url").alias("url"), F.lit(source).alias("source"), F.lit("website").alias("observation_type"))
    return out.filter("date IS NOT NULL AND performer IS NOT NULL").withColumn("name", F.concat("performer", F.lit(" at "), "venue"))


def follow_pages(fetch: Callable[[str], dict | None], url: str, most: int = 8) -> list[dict]:
    """A paginated feed's payloads: up to `most`, until one fails or names no next page."""
    out: list[dict] = []
    while url and len(out) < most:
        payload = fetch(url)
        if payload is None:
            break
        out.append(payload)
        url = (payload.get("pages") or {}).get("nextPage")
    return out


VISION_ROWS = "array<struct<artist:string,venue:string,date:string,day_of_week:string,time_start:string,stage:string,week_of:string,confidence:string>>"


def vision_events(responses: DataFrame, today: str, file_col: str = "file", text_col: str = "response") -> DataFrame:
    """Rows that a vision model read off images: fences off, weekdays resolved against the image's week or today's."""
    raw = or_empty(strip(text_col))
    body = F.when(raw.startswith("```"), F.regexp_extract(raw, r"(?s)^```(?:json)?(.*?)(?:```|$)", 1)).otherwise(raw)
    rows = responses.select(file_col, F.from_json(strip(body), VISION_ROWS).alias("all"))
    weeks = F.filter(F.transform("all", lambda e: F.try_to_date(F.concat(F.lit(today[:4] + "/"), F.regexp_extract(or_empty(e["week_of"]), r"^\s*(\d{1,2}/\d{1,2})", 1)), "yyyy/M/d")), lambda d: d.isNotNull())
    rows = rows.withColumn("anchor", F.try_element_at(weeks, F.lit(1))).select(file_col, "anchor", F.posexplode("all").alias("row", "e"))
    text = lambda c: none_if_blank(strip(F.col(f"e.{c}")))
    day = F.initcap(strip("e.day_of_week"))
    date = F.coalesce(text("date"), F.when(F.col("anchor").isNotNull(), anchored_date(day, "anchor")).cast("string"), current_week_date(day, F.to_date(F.lit(today))).cast("string"))
    out = rows.select(text("artist").alias("performer"), text("venue").alias("venue"), date.alias("date"), text("time_start").alias("time_start"), text("stage").alias("stage"), F.concat(F.lit("image:"), file_col).alias("source"), F.lit("image").alias("observation_type"), clamped("e.confidence").alias("model_confidence"), "row")
    return out.filter("performer IS NOT NULL")


def two_column_events(items: DataFrame, year: int, file_col: str = "file", artist_col: str = "artist") -> DataFrame:
    """Events in positioned text, each column read from top to bottom: a date holds until the next, a venue until a time or date.

    items: file, artist, x, y, text and ord for ties. A file's rows are one page's.
    """
    text = or_empty(strip("text"))
    upper = F.upper(text)
    rows = items.select(file_col, artist_col, (F.col("x") >= 0.45).cast("int").alias("side"), "y", "ord", upper.alias("u"), text.alias("t"))
    rows = rows.filter((F.length("t") >= 3) & ~F.col("t").rlike(f"[{fixed.READER_GARBAGE}]"))
    day = r"(?:MON|TUE|WED|THU|FRI|SAT|SUN)\w*\s+(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\w*\s+(\d{1,2})"
    clock_time = r"\b(\d{1,2}(?::\d{2})?\s*(?:AM|PM))\b"
    kind = F.when(F.col("u").rlike(day), "date").when(F.col("u").rlike(clock_time), "time").when(match_venue("u").isNotNull(), "venue")
    date = F.try_to_date(F.concat(F.initcap(F.regexp_extract("u", day, 1)), F.lit(" "), F.regexp_extract("u", day, 2), F.lit(f" {year}")), "MMM d yyyy")
    rows = rows.withColumn("kind", kind).withColumn("date", F.when(F.col("kind") == "date", date)).withColumn("venue", F.when(F.col("kind") == "venue", match_venue("u"))).withColumn("time_start", F.when(F.col("kind") == "time", strip(F.regexp_extract("u", clock_time, 1))))
    column = Window.partitionBy(file_col, "side").orderBy(F.desc("y"), "ord")
    before = column.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.coalesce(F.sum(F.when(F.col("kind").isin("date", "time"), 1).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumn("segment", breaks).withColumn("held_date", F.last("date", True).over(column))
    within = Window.partitionBy(file_col, "side", "segment").orderBy(F.desc("y"), "ord")
    rows = rows.withColumn("held_venue", F.last("venue", True).over(within))
    out = rows.filter("kind = 'time' AND held_date IS NOT NULL AND held_venue IS NOT NULL")
    return out.select(file_col, F.col(artist_col).alias("performer"), F.col("held_venue").alias("venue"), F.col("held_date").cast("string").alias("date"), "time_start", "side", "y", F.concat(F.lit("ocr:"), file_col).alias("source"))


def research_events(findings: DataFrame, favorite_col: str = "favorite", text_col: str = "response") -> DataFrame:
    """Findings of a web search with a date and a real link; the favourite's name where no performer is given."""
    raw = or_empty(strip(text_col))
    body = F.when(raw.startswith("```"), F.regexp_extract(raw, r"(?s)^```(?:json)?(.*?)(?:```|$)", 1)).otherwise(raw)
    rows = findings.select(favorite_col, F.from_json(strip(body), "found boolean, performer string, venue string, date string, time string, source_url string").alias("r"))
    rows = rows.filter(F.coalesce("r.found", F.lit(False)) & ~blank("r.date") & F.coalesce(F.col("r.source_url").rlike("^https?://"), F.lit(False)))
    return rows.select(F.coalesce(none_if_blank("r.performer"), F.col(favorite_col)).alias("performer"), "r.venue", "r.date", F.col("r.time").alias("time_start"), F.col("r.source_url").alias("url"), F.lit("favorites_watch").alias("source"), F.lit("ai_web_search").alias("observation_type"))


def roster(spark: SparkSession, path: str, column: str = "performer") -> DataFrame:
    """A hand-written CSV roster with `ord`, the place of each row, blanks counted and then left out.

    The file is small and has one writer; it is read as one text so that places don't depend on splits.
    """
    names = spark.read.option("header", "true").csv(path).columns
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    parsed = F.from_csv("line", ", ".join(f"`{n}` string" for n in names))
    favorite = F.col("r.favorite") if column == "performer" and "favorite" in names else F.lit("N" if column == "performer" else "Y")
    rows = lines.filter("ord > 0").withColumn("r", parsed)
    return rows.select("ord", F.col(f"r.`{column}`").alias(column), favorite.alias("favorite")).filter(~blank(column))


def seed_rows(spark: SparkSession, today: str) -> DataFrame:
    """The seed events, dated today."""
    rows = [(e["name"], e["performer"], e["venue"], today, e["time_start"], e["url"], "seed") for e in fixed.SEED_EVENTS]
    return spark.createDataFrame(rows, "name string, performer string, venue string, date string, time_start string, url string, source string")


def images(files: DataFrame) -> DataFrame:
    """file, content: those of the files (path, content) that are images, by their endings in any case."""
    rows = files.withColumn("file", F.regexp_extract("path", "[^/]+$", 0))
    ending = F.lower(F.regexp_extract("file", r"\.[^.]*$", 0))
    return rows.filter(ending.isin(fixed.IMAGE_ENDINGS)).select("file", "content")


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """The images right below a folder."""
    return images(spark.read.format("binaryFile").load(path))


def read_images(images: DataFrame, read: Callable[[str, bytes], str]) -> DataFrame:
    """file, response, error: what a reader (a model or recogniser that the caller brings) makes of each image.

    One that fails has an error and no response, and doesn't end the run.
    """
    ship(images.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                try:
                    response, error = read(file, content.as_py()), None
                except Exception as failure:  # the reader's own, reported as a row
                    response, error = None, f"{type(failure).__name__}: {failure}"
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (file, response, error)], ["file", "response", "error"])

    return images.select("file", "content").mapInArrow(each, "file string, response string, error string")


def settle(results: DataFrame, path: str, processed: str, failed: str) -> None:
    """Moves the files of read images out of the inbox, to where read and failed ones go; results must be written already."""
    spark = results.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for target in (processed, failed):
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(target))
    for row in results.select("file", F.col("error").isNull().alias("good")).toLocalIterator():
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(folder, row["file"]), spark._jvm.org.apache.hadoop.fs.Path(processed if row["good"] else failed, row["file"]))


def importer(prefer: str | None, has_key: bool, has_reader: bool) -> str | None:
    """Who reads the inbox: 'vision', 'ocr' or nobody. A model is preferred where there is a key for it."""
    mode = (prefer or "auto").lower()
    if mode == "vision" or (mode == "auto" and has_key):
        return "vision"
    return "ocr" if mode == "ocr" or (mode == "auto" and has_reader) else None


class Registry:
    """Named sources of raw rows. One that fails is reported and left out; the others' rows are joined by column name.

    Sources are lazy, so each one's rows are read and written here: a source that fails while it is read fails alone.
    """

    def __init__(self):
        self.sources: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, fetch: Callable[[SparkSession], DataFrame]) -> None:
        self.sources[name] = fetch

    def fetch_all(self, spark: SparkSession, report: Callable[[str, Exception], None] = lambda name, error: print(f"source {name} failed: {error}")) -> DataFrame | None:
        found = []
        for name, fetch in self.sources.items():
            try:
                found.append(checkpoint(fetch(spark)))
            except Exception as error:  # a source's failure must not end the run
                report(name, error)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def limited(rows: DataFrame, most: int | None, order: str = "ord") -> DataFrame:
    """The crawl policy's cap: the first `most` rows in order, or all."""
    return rows if most is None else rows.orderBy(order).limit(most)


def admitted(rows: DataFrame) -> DataFrame:
    """Rows without a classification and those whose performer is named."""
    return rows.filter(F.col("performer_status").isNull() | ((F.col("performer_status") == "named") & F.coalesce("resolved", F.lit(False))))
