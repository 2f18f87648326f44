"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

Writing: each page gives a request, a response (or a revisit, when an equal payload of at least `revisit_bytes` bytes is
stored with a larger id) and a metadata record, joined by WARC-Concurrent-To. Archives are gzip files of whole records
in the shared folder, of `file_records` records at most. Spark's text writer makes them,
with the two line ends that close a WARC record as its separator, so a lost task's file is written again whole.

Reading: a file's records are parsed by their Content-Length; a payload's digest and size are computed from its bytes.
Assembly: requests, metadata and other records go to the response, revisit or resource that they name (or that names
them) as concurrent; a record that names none, or one that is not there, forms a row without a response.

A null html is an empty payload; a null url is left out of the headers; repeated rows are captures of their own; a null
id refers to nothing and counts as the smallest; an empty table writes nothing and gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import checkpoint, if_small, shared_dir, table

END = "\r\n"
REVISIT_BYTES = 1000
FILE_RECORDS = 3000
RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
MAIN = ("response", "revisit", "resource")


def urn(*parts: Column) -> Column:
    """A record id made from its contents, so reruns write the same."""
    h = F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def record(kind: Column, headers: list[tuple[str, Column]], content_type: Column, block: Column) -> Column:
    named = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(END))).otherwise(F.lit("")) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END))
    return F.concat(F.lit(f"WARC/1.1{END}WARC-Type: "), kind, F.lit(END), *named, F.lit("Content-Type: "), content_type, F.lit(END), length, block)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, file_records: int = FILE_RECORDS, date: str = "2024-01-01T00:00:00Z") -> None:
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]+", "%20").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    keys = checkpoint(rows.select("id", "url", "digest", "bytes"))
    largest = keys.filter(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max(F.struct("id", "url")).alias("first"))
    own = keys.select("id", "digest").distinct().join(largest, "digest")
    own = checkpoint(own.filter(~F.col("id").eqNullSafe(F.col("first.id"))).select(F.col("id").alias("k"), F.col("digest").alias("d"), "first"))
    if keys.groupBy("id", "url", "digest").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("copy", F.lit(1))
    else:
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "url", "digest").orderBy(F.lit(0))))
    rows = rows.join(if_small(own, 250), F.col("id").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    uri = F.col("url")
    name = lambda kind: urn(F.lit(kind), F.col("id"), uri, F.col("digest"), F.col("copy"))
    main, digest, when = name("response"), F.concat(F.lit("sha1:"), F.col("digest")), F.lit(date)
    head = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: ")
    http = F.concat(head, F.col("bytes").cast("string"), F.lit(END + END))
    common = [("WARC-Target-URI", uri), ("WARC-Date", when)]
    request = record(F.lit("request"), [("WARC-Record-ID", name("request")), *common, ("WARC-Concurrent-To", main)], F.lit("application/http;msgtype=request"), F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}")))
    response = record(F.lit("response"), [("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest)], F.lit("application/http;msgtype=response"), F.concat(http, F.col("payload")))
    refers = urn(F.lit("response"), F.col("first.id"), F.col("first.url"), F.col("digest"), F.lit(1))
    revisit = record(F.lit("revisit"), [("WARC-Record-ID", main), *common, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", refers), ("WARC-Payload-Digest", digest)], F.lit("application/http;msgtype=response"), http)
    note = F.concat(F.coalesce(F.concat(F.lit("page_id: "), F.col("id").cast("string"), F.lit(END)), F.lit("")), F.lit("payload_bytes: "), F.col("bytes").cast("string"), F.lit(END))
    metadata = record(F.lit("metadata"), [("WARC-Record-ID", name("metadata")), *common, ("WARC-Concurrent-To", main)], F.lit("application/warc-fields"), note)
    lines = rows.select(F.explode(F.array(request, F.when(F.col("first").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    lines.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """(headers by lower-case name, block) of each record of one file's bytes, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        headers: dict[str, list[str]] = {}
        for line in data[at:end].decode("utf-8", "replace").split(END)[1:]:
            k, _, v = line.partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        start = end + 4
        stop = start + int(headers.get("content-length", ["0"])[0])
        yield headers, view[start:stop]
        at = stop
        while data[at : at + 2] == b"\r\n":
            at += 2


def row(headers: dict[str, list[str]], block: memoryview, payloads: bool) -> dict:
    one = lambda k: headers.get(k, [None])[0]
    kind, media = one("warc-type"), one("content-type") or ""
    fields, payload = {}, bytes(block)
    if media.startswith("application/http"):
        head, found, body = payload.partition(b"\r\n\r\n")
        payload = body if found else b""
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(END)[1:])}
    elif media.startswith("application/warc-fields"):
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in payload.decode("utf-8", "replace").split(END)) if k.strip()}
    stored = kind in ("response", "resource")
    digest = hashlib.sha1(payload).hexdigest() if stored else (one("warc-payload-digest") or "").removeprefix("sha1:") or None
    return {"record_id": one("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to", []), "target_uri": one("warc-target-uri"), "date": one("warc-date"), "refers_to": one("warc-refers-to"), "payload_digest": digest, "payload_bytes": len(payload) if stored else None, "payload": payload if payloads and stored else None, "fields": list(fields.items())}


def read(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """The archives' records, in the columns of RECORD; payloads False leaves the bytes of payloads out."""
    types = {"record_id": pa.string(), "type": pa.string(), "concurrent_to": pa.list_(pa.string()), "target_uri": pa.string(), "date": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string())}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                held, size = [], 0
                for headers, block in records(data.as_py()):
                    held.append(row(headers, block, payloads))
                    size += len(block) if payloads else 500
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in held], t) for k, t in types.items()})
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in held], t) for k, t in types.items()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def assemble(found: DataFrame, named_by_main: bool = True) -> DataFrame:
    """One row per capture: capture_id, request, response (both structs or null), metadata and others (arrays of structs).

    named_by_main: whether responses may name the others as concurrent; where all others name their response, False
    saves reading the records for that once more.
    """
    named = F.col("concurrent_to")
    if not named_by_main:
        return grouped_records(found.withColumn("owner", F.lit(None).cast("string")))
    links = found.filter(F.col("type").isin(*MAIN)).select(F.explode(named).alias("member"), F.col("record_id").alias("owner")).groupBy("member").agg(F.min("owner").alias("owner"))
    return grouped_records(found.join(links, found["record_id"] == links["member"], "left").drop("member"))


def grouped_records(linked: DataFrame) -> DataFrame:
    named = F.col("concurrent_to")
    own = F.when(F.col("type").isin(*MAIN), F.col("record_id")).otherwise(F.coalesce("owner", F.try_element_at(named, F.lit(1)), F.col("record_id")))
    body = F.struct("record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload", F.map_entries("fields").alias("fields"))
    rows = linked.select(own.alias("capture_id"), "type", body.alias("r"))
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("r"))))
    kind = F.col("type")
    grouped = rows.groupBy("capture_id").agg(of(kind == "request").alias("requests"), of(kind.isin(*MAIN)).alias("responses"), of(kind == "metadata").alias("metadata"), of(~kind.isin("request", "metadata", *MAIN)).alias("others"))
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return grouped.select("capture_id", first("requests").alias("request"), first("responses").alias("response"), "metadata", "others", F.slice("requests", 2, 1 << 20).alias("more_requests"))


def field(records: str, name: str) -> Column:
    """A field's value in the first of the records that has it."""
    values = F.flatten(F.transform(records, lambda r: F.filter(r["fields"], lambda e: e["key"] == name)))
    return F.try_element_at(values, F.lit(1))["value"]


def captures(pages: DataFrame, path: str, **columns: str) -> DataFrame:
    """Writes the pages as archives below path, reads these back and assembles them, without the payloads' bytes."""
    write(pages, path, **columns)
    return assemble(read(pages.sparkSession, path, payloads=False), named_by_main=False)


OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    found = captures(pages, path)
    rows = checkpoint(
        found.select(
            "capture_id", field("metadata", "page_id").cast(kind).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers"),
        )
    )
    # A revisit's payload is that of the record it refers to.
    stored = rows.filter("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"))
    resolved = rows.filter("record_type = 'revisit'").join(stored, "refers", "left")
    columns = ["page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    others = rows.filter("record_type != 'revisit'").select("*", F.lit(None).cast(kind).alias("refers_to"), F.lit(None).cast("long").alias("first_bytes"))
    return others.select(*columns).unionByName(resolved.select(*columns))
