"""Accumulated events: versioned tables in parts, a merge by identity, and schema migrations.

A table with an identity_key is cut into parts: the month of the identity's date, and a hash bucket within it. A version
is a manifest that names the folder of each part. A merge reads and writes the parts of its own identities, and names the
other folders again, so its cost follows the batch and not what is stored. Expired months leave the manifest unread.

A manifest is written aside and renamed to its number last, which fails if that number exists. So readers see a whole
version or the one before, and of two writers one begins again from the other's version. A lease keeps such work rare.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concord.functions.names import ascii_identity_key, signature
from concord.functions.fixed_values import BACKFILL_REASON, BACKFILL_TRUST, BACKFILL_TRUST_OTHER
from concord.functions.text import group, or_empty
from concord.functions.times import start_minutes
from concord.operators.aggregate import canonical_events
from concord.operators.observe import OBSERVATION
from concord.operators.rules import distinct_observations, first_of, not_past, recomputed
from concord.session import checkpoint


def merge_observations(stored: DataFrame, incoming: DataFrame, key: str = "identity_key", by_id: bool = False) -> DataFrame:
    """stored and incoming observations (columns OBSERVATION) as one set.

    Identities that are not stored keep all their rows. Of stored ones, a row with a stored source and checksum only
    refreshes that row's observed_at; others are added, the first of equal ones. Nulls are equal.

    by_id: rows are told apart by id instead, so equal contents of different confidence all stay, and the result is the
    same however the rows are cut into batches. A row whose id is stored is the same row again and is left out.
    """
    if by_id:
        return stored.select(OBSERVATION).unionByName(incoming.join(stored.select(key, "id"), [key, "id"], "left_anti").select(OBSERVATION))
    known = incoming.join(stored.select(key).distinct(), key, "left_semi")
    fresh = incoming.join(stored.select(key).distinct(), key, "left_anti")
    again = known.groupBy(F.col(key).alias("_k"), F.col("source").alias("_s"), F.col("checksum").alias("_c")).agg(F.max("observed_at").alias("_seen"))
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")) & F.col("checksum").eqNullSafe(F.col("_c"))
    refreshed = stored.join(again, same, "left").withColumn("observed_at", F.coalesce("_seen", "observed_at")).drop("_k", "_s", "_c", "_seen")
    seen = stored.select(F.col(key).alias("_k"), F.col("source").alias("_s"), F.col("checksum").alias("_c")).distinct()
    added = known.join(seen, same, "left_anti")
    added = distinct_observations(added, key)
    return refreshed.select(OBSERVATION).unionByName(added.select(OBSERVATION)).unionByName(fresh.select(OBSERVATION))


def merge_events(previous: DataFrame, observations: DataFrame, touched: DataFrame, key: str = "identity_key") -> DataFrame:
    """Canonical events over all observations, with ids and names as first stored, and a status.

    previous: stored events. touched: the identities (key) of the incoming rows; others are carried over, unchanged and
    with status 'kept'. A url that no observation has any more stays.
    """
    now = canonical_events(observations.join(touched.select(key).distinct(), key, "left_semi"))
    old = previous.select(key, F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("url").alias("_url"), signature().alias("_was"), F.lit(True).alias("_known"))
    both = now.join(old, key, "left")
    both = both.withColumn("id", F.coalesce("_id", "id")).withColumn("name", F.coalesce("_name", "name")).withColumn("url", F.coalesce(F.nullif("url", F.lit("")), "_url"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_was") == signature(), "unchanged").otherwise("changed")
    merged = both.withColumn("status", status).drop("_id", "_name", "_url", "_was", "_known")
    kept = previous.join(touched.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("kept"))
    return merged.unionByName(kept, allowMissingColumns=True)


class Conflict(Exception):
    """Another writer has committed a version since this one's was read."""


class Busy(Exception):
    """Another owner holds the lease."""


NO_MONTH = "none"
PART = ["part_month", "part_bucket"]


def month_of(key: Column | str = "identity_key") -> Column:
    """The month at the end of an identity, or `none`."""
    return F.coalesce(group(key, r"\|(\d{4}-\d{2})-\d{2}$"), F.lit(NO_MONTH))


class Store:
    """Events, observations and other tables below a path, in versions of which the `keep` newest stay.

    buckets: parts that a month is cut into; a store keeps the number that it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, buckets: int = 8):
        self.spark, self.path, self.keep = spark, path, keep
        self.jvm = spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(path)
        conf = spark._jsc.hadoopConfiguration()
        self.files = self.folder.getFileSystem(conf)
        self.renamer = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), conf)
        self.buckets = self.manifest(self.version()).get("buckets", buckets)

    def hadoop(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self, folder: str) -> list[int]:
        return [int(x.getPath().getName()) for x in self.files.listStatus(self.hadoop(folder))] if self.files.exists(self.hadoop(folder)) else []

    def text(self, name: str) -> str:
        stream = self.files.open(self.hadoop(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Makes a file appear whole; False if there is one already."""
        aside = self.hadoop(f"_aside/{uuid.uuid4().hex}")
        out = self.files.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.files.mkdirs(self.hadoop(name).getParent())
        gateway = self.spark.sparkContext._gateway
        try:
            self.renamer.rename(self.files.makeQualified(aside), self.files.makeQualified(self.hadoop(name)), gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as error:
            self.files.delete(aside, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise

    @contextmanager
    def lease(self, owner: str, seconds: float = 3600) -> Iterator[None]:
        """Holds the store for one owner, until the block ends or the time is over. Busy, if another one holds it.

        It saves work that would be thrown away; what keeps versions right is that each number can be made once.
        """
        mine = json.dumps({"owner": owner, "until": time.time() + seconds})
        if not self.publish("_lease", mine):
            held = json.loads(self.text("_lease"))
            if held["until"] > time.time() and held["owner"] != owner:
                raise Busy(held["owner"])
            self.files.delete(self.hadoop("_lease"), False)
            if not self.publish("_lease", mine):
                raise Busy("a new owner")
        try:
            yield
        finally:
            if self.files.exists(self.hadoop("_lease")) and self.text("_lease") == mine:
                self.files.delete(self.hadoop("_lease"), False)

    def version(self) -> int:
        """The current version, 0 before the first: the greatest number that has been committed."""
        return max(self.numbers("_versions"), default=0)

    def manifest(self, n: int) -> dict:
        """buckets, and of each table its schema and the folders of its parts."""
        return json.loads(self.text(f"_versions/{n}")) if n and self.files.exists(self.hadoop(f"_versions/{n}")) else {"tables": {}}

    def names(self, n: int) -> list[str]:
        """The tables of a version."""
        return list(self.manifest(n)["tables"])

    def read(self, table: str, parts: set[str] | None = None, version: int | None = None) -> DataFrame | None:
        """A table of the current or given version, whole or of some parts; None if there is no such table."""
        known = self.manifest(self.version() if version is None else version)["tables"].get(table)
        if known is None:
            return None
        schema = StructType.fromJson(known["schema"])
        paths = [f"{self.path}/{table}/{folder}/{part}" for part, folder in sorted(known["parts"].items()) if parts is None or part in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def load_events(self, run_id: str | None = None) -> DataFrame | None:
        """Events in order of date and start, all or those that a run wrote last."""
        events = self.read("events")
        return events if events is None else (events if run_id is None else events.filter(F.col("run_id") == run_id)).orderBy("date", "time_start")

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with the columns PART."""
        return rows.withColumns({"part_month": month_of(), "part_bucket": F.pmod(F.xxhash64("identity_key"), F.lit(self.buckets)).cast("int")})

    def parts_of(self, rows: DataFrame) -> set[str]:
        """The parts of the rows' identities: at most `buckets` a month."""
        return {f"part_month={m}/part_bucket={b}" for m, b in self.placed(rows).select(*PART).distinct().collect()}

    def write(self, table: str, folder: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows below a new folder; its parts."""
        path = f"{table}/{folder}"
        if "identity_key" not in rows.columns:
            rows.write.parquet(f"{self.path}/{path}/all")
            return {"all": folder}
        self.placed(rows).repartition(*PART).write.partitionBy(*PART).parquet(f"{self.path}/{path}")
        below = lambda name: [x.getPath().getName() for x in self.files.listStatus(self.hadoop(name)) if x.isDirectory()]
        return {f"{month}/{bucket}": folder for month in below(path) for bucket in below(f"{path}/{month}")}

    def commit(self, replaced: set[str] | None = None, base: int | None = None, **tables: DataFrame) -> int:
        """Writes the tables as the next version of `base` (the current one).

        replaced: parts that the rows given stand for; the others stay as they are, and so do tables that aren't given.
        Without it the new version has the given tables alone. Versions before the `keep` newest are deleted then.
        """
        n = (self.version() if base is None else base) + 1
        before = self.manifest(n - 1)
        folder = f"v{n:06d}-{uuid.uuid4().hex[:8]}"
        now = dict(before["tables"]) if replaced is not None else {}
        for name, rows in tables.items():
            stay = {} if replaced is None or name not in before["tables"] else {p: f for p, f in before["tables"][name]["parts"].items() if p not in replaced}
            now[name] = {"schema": json.loads(rows.schema.json()), "parts": stay | self.write(name, folder, rows)}
        if not self.publish(f"_versions/{n}", json.dumps({"buckets": self.buckets, "tables": now})):
            for name in tables:
                self.files.delete(self.hadoop(f"{name}/{folder}"), True)
            raise Conflict(f"version {n} is there already")
        self.forget(n)
        return n

    def forget(self, n: int) -> None:
        """Deletes versions that are not kept, and the parts that only they name."""
        named = lambda v: {(t, p, f) for t, x in self.manifest(v)["tables"].items() for p, f in x["parts"].items()}
        old = [v for v in self.numbers("_versions") if v <= n - self.keep]
        if not old:
            return
        kept = set().union(*(named(v) for v in self.numbers("_versions") if v not in old))
        for v in old:
            for table, part, folder in named(v) - kept:
                self.files.delete(self.hadoop(f"{table}/{folder}/{part}"), True)
            self.files.delete(self.hadoop(f"_versions/{v}"), False)

    def schema(self) -> int:
        """The schema version of the stored tables."""
        return max(self.numbers("_schema"), default=0)

    def migrate(self) -> int:
        """Brings the stored tables to the newest schema, keeps its number, and returns it."""
        done = self.schema()
        if done < len(MIGRATIONS):
            n = self.version()
            tables, done = migrate(self.spark, {t: self.read(t) for t in self.names(n)}, done)
            self.commit(base=n, **tables)
            self.files.create(self.hadoop(f"_schema/{done}"), True).close()
        return done

    def upsert(self, incoming: DataFrame, run_id: str, before: str | None = None, tries: int = 5, by_id: bool = False) -> dict[str, int]:
        """Merges observations of one run and returns the counts by status; events dated before `before` go, with theirs.
        by_id is that of merge_observations.

        `status` and `run_id` of an event are those of the last run that had its identity. If another writer commits
        first, the merge begins again from its version.
        """
        incoming = checkpoint(incoming if before is None else not_past(incoming, before))
        touched = self.parts_of(incoming)
        for left in reversed(range(tries)):
            try:
                return self.merge(self.version(), incoming, touched, run_id, before, by_id)
            except Conflict:
                if not left:
                    raise

    def record(self, run_id: str, started_at: str, saved: int, tries: int = 5) -> int:
        """Notes a run in the table of runs; the new version. A run_id that is there already is noted anew."""
        for left in reversed(range(tries)):
            n = self.version()
            runs = self.read("runs", version=n)
            runs = empty(self.spark, {c: RUN[c] for c in ("id", "run_id", "started_at", "events_saved")}) if runs is None else runs
            try:
                return self.commit({"all"}, n, runs=record_run(runs, run_id, started_at, saved).coalesce(1))
            except Conflict:
                if not left:
                    raise

    def merge(self, n: int, incoming: DataFrame, touched: set[str], run_id: str, before: str | None, by_id: bool = False) -> dict[str, int]:
        known = {p for t in ("events", "observations") for p in self.manifest(n)["tables"].get(t, {"parts": ()})["parts"]}
        expired = set()
        if before is not None:
            month = lambda part: part.split("/")[0].partition("=")[2]
            expired = {p for p in known - touched if month(p) != NO_MONTH and month(p) < before[:7]}
            touched = touched | {p for p in known if month(p) == before[:7]}
        stored, previous = self.read("observations", touched, n), self.read("events", touched, n)
        if stored is None:
            stored = incoming.limit(0)
            previous = canonical_events(stored).withColumn("run_id", F.lit(""))
            if not self.schema():
                self.files.create(self.hadoop(f"_schema/{len(MIGRATIONS)}"), True).close()
        observations = checkpoint(merge_observations(stored, incoming, by_id=by_id))
        events = merge_events(previous, observations, incoming.select("identity_key"))
        run = F.when(F.col("status") == "kept", F.col("run_id")).otherwise(F.lit(run_id))
        events = events.withColumn("run_id", run)
        if before is not None:
            events = checkpoint(not_past(events, before))
            observations = observations.join(events.select("identity_key"), "identity_key", "left_semi").select(OBSERVATION)
        n = self.commit(touched | expired, n, observations=observations, events=events)
        counts = {r["status"]: r["count"] for r in self.read("events", touched, n).groupBy("status").count().collect()}
        return {s: counts.get(s, 0) for s in ("new", "changed", "unchanged")}


def record_run(runs: DataFrame, run_id: str, started_at: str, saved: int) -> DataFrame:
    """runs (id, run_id, started_at, events_saved) with this one, which replaces a row of its run_id under a new id."""
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    row = last.select((F.col("last") + 1).alias("id"), F.lit(run_id).alias("run_id"), F.lit(started_at).alias("started_at"), F.lit(saved).cast("int").alias("events_saved"))
    return runs.filter(F.col("run_id") != run_id).unionByName(row)


def previous_run(runs: DataFrame) -> DataFrame:
    """The second newest run."""
    return runs.orderBy(F.desc("id")).offset(1).limit(1)


def add_missing(rows: DataFrame, **columns: str) -> DataFrame:
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


Tables = dict[str, DataFrame]
RUN = {"id": "long", "run_id": "string", "started_at": "string", "events_saved": "int"}
EVENT = {"id": "long", "name": "string", "date": "string", "time_start": "string", "time_end": "string", "venue": "string", "performer": "string", "url": "string", "stage": "string", "source": "string", "run_id": "string"}
OBSERVED = {"id": "long", "event_id": "long", "source": "string", "url": "string", "confidence": "double", "checksum": "string", "observed_at": "string"}


def empty(spark: SparkSession, columns: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def migrate_base(spark: SparkSession, tables: Tables) -> Tables:
    """The tables of events and runs, with every column that the first version has."""
    events, runs = (tables[t] if t in tables else empty(spark, kinds) for t, kinds in (("events", EVENT), ("runs", RUN)))
    return tables | {"events": add_missing(events, **EVENT), "runs": add_missing(runs, **RUN)}


def migrate_confidence(spark: SparkSession, tables: Tables) -> Tables:
    """Events get a confidence where they have none: a fixed one by their source, whatever trust is set now."""
    rows = add_missing(tables["events"], confidence="double", confidence_reason="string")
    trust = F.lit(BACKFILL_TRUST_OTHER)
    for pattern, value in reversed(BACKFILL_TRUST.items()):
        trust = F.when(or_empty("source").ilike(pattern) if "%" in pattern else F.col("source") == pattern, F.lit(value)).otherwise(trust)
    reason = F.when(F.col("confidence").isNull(), F.lit(BACKFILL_REASON)).otherwise(F.col("confidence_reason"))
    rows = rows.withColumn("confidence_reason", reason).withColumn("confidence", F.coalesce("confidence", trust))
    return tables | {"events": rows.withColumn("run_id", F.when(or_empty("run_id") == "", F.lit("legacy")).otherwise(F.col("run_id")))}


def migrate_provenance(spark: SparkSession, tables: Tables) -> Tables:
    """Events get what is counted over their sources, and sources a table of their own."""
    tables = tables | {"events": add_missing(tables["events"], source_count="int", verification_count="int", conflict_flag="int", conflict_reason="string")}
    return tables if {"event_sources", "observations"} & set(tables) else tables | {"event_sources": empty(spark, OBSERVED)}


def migrate_rename(spark: SparkSession, tables: Tables) -> Tables:
    """event_sources becomes observations, unless there is such a table already."""
    if "event_sources" not in tables or "observations" in tables:
        return tables
    return {t: rows for t, rows in tables.items() if t != "event_sources"} | {"observations": tables["event_sources"]}


def migrate_types(spark: SparkSession, tables: Tables) -> Tables:
    """Observations get the way in which they were made, by their source where they have none."""
    rows = add_missing(tables["observations"], observation_type="string")
    s = F.col("source")
    kind = F.when(s.ilike("image:%"), "image").when(s.ilike("ocr%"), "ocr").when(s.isin("instagram", "facebook"), "social").when(s == "seed", "manual").otherwise("website")
    return tables | {"observations": rows.withColumn("observation_type", F.coalesce("observation_type", kind))}


def migrate_identity(spark: SparkSession, tables: Tables) -> Tables:
    """One event per identity: that with the least id. Observations go over to it, repeated ones leave, and what follows
    from them is computed again. Observations get the times and stage of their event where they have none."""
    events = add_missing(tables["events"], identity_key="string")
    events = events.withColumn("identity_key", F.coalesce("identity_key", ascii_identity_key()))
    first = events.groupBy("identity_key").agg(F.min("id").alias("_first"))
    events = checkpoint(events.join(first, "identity_key"))
    said = ["time_start", "time_end", "stage"]
    home = events.select(F.col("id").alias("event_id"), F.col("_first"), F.col("identity_key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in said])
    obs = add_missing(tables["observations"], event_id="long", identity_key="string", **dict.fromkeys(said, "string"))
    silent = F.coalesce(*said).isNull()
    obs = obs.join(home, "event_id", "left").withColumn("_silent", silent).withColumn("event_id", F.coalesce("_first", "event_id")).withColumn("identity_key", F.coalesce("_key", "identity_key"))
    for c in said:
        obs = obs.withColumn(c, F.when(F.col("_silent"), F.col(f"_{c}")).otherwise(F.col(c)))
    obs = checkpoint(first_of(obs.drop("_first", "_key", "_silent", *[f"_{c}" for c in said]), ["event_id", "source", "checksum"], F.min_by, F.col("id")))
    obs = add_missing(obs, **OBSERVED, name="string", performer="string", venue="string", date="string", start_minutes="int", source_confidence="double", extraction_confidence="double")
    obs = obs.withColumn("start_minutes", F.coalesce("start_minutes", start_minutes("time_start")))
    kept = events.filter("id = _first").drop("_first")
    derived = ["confidence", "confidence_reason", "source_count", "verification_count", "conflict_flag", "conflict_reason"]
    return tables | {"events": recomputed(kept, obs, derived=derived), "observations": obs}


#: In order; a version's number is its place. New ones are only ever added at the end.
MIGRATIONS: list[tuple[str, Callable[[SparkSession, Tables], Tables]]] = [
    ("base", migrate_base), ("confidence", migrate_confidence), ("provenance", migrate_provenance), ("rename", migrate_rename), ("types", migrate_types), ("identity", migrate_identity),
]


def migrate(spark: SparkSession, tables: Tables, version: int = 0) -> tuple[Tables, int]:
    """tables brought from a schema version to the newest, and its number; running it again changes nothing."""
    for _, step in MIGRATIONS[version:]:
        tables = step(spark, tables)
    return tables, len(MIGRATIONS)
