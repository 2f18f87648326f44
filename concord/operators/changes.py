"""Differences between runs, and changelogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions.names import signature
from concord.functions.text import or_empty
from concord.session import checkpoint

#: Fields whose differences a changelog lists.
DIFF_FIELDS = ["name", "venue", "performer", "date", "time_start", "time_end", "stage", "url"]


def compare_runs(current: DataFrame, previous: DataFrame, key: str = "identity_key", order: str = "id") -> DataFrame:
    """key, status (new, changed, removed, unchanged), before, after (structs). Of rows with one key the last counts."""

    def last(rows: DataFrame, name: str) -> DataFrame:
        signed = rows.withColumn("_signature", signature())
        return signed.groupBy(key).agg(F.max_by(F.struct(*rows.columns, "_signature"), order).alias(name))

    both = last(current, "after").join(last(previous, "before"), key, "full_outer")
    same = F.col("after._signature") == F.col("before._signature")
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.withColumn("status", status)


def change_summary(changes: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return changes.agg(n("new").alias("new"), n("changed").alias("changed"), n("removed").alias("removed"), n("unchanged").alias("unchanged"), (n("new") + n("changed")).alias("total_delta"))


def field_diff(fields: list[str] | None = None) -> Column:
    """array<struct(field, before, after)> of the fields that differ; nulls are equal to each other."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"before.{f}").cast("string").alias("before"), F.col(f"after.{f}").cast("string").alias("after")) for f in fields or DIFF_FIELDS]
    return F.filter(F.array(*pairs), lambda d: ~d["before"].eqNullSafe(d["after"]))


def event_line(prefix: str = "") -> Column:
    c = lambda f, default: F.coalesce(F.nullif(F.col(prefix + f), F.lit("")), F.lit(default))
    performer = F.coalesce(F.nullif(F.col(prefix + "performer"), F.lit("")), F.nullif(F.col(prefix + "name"), F.lit("")), F.lit("Unknown"))
    return F.trim(F.concat(performer, F.lit(" @ "), c("venue", "?"), F.lit("  "), c("date", "?"), F.lit(" "), or_empty(prefix + "time_start")))


def changelog(changes: DataFrame, key: str = "identity_key") -> DataFrame:
    """key, status, line, diff: what a run's log lists."""
    rows = changes.filter("status != 'unchanged'")
    line = F.when(F.col("status") == "removed", event_line("before.")).otherwise(event_line("after."))
    none = F.array().cast("array<struct<field:string,before:string,after:string>>")
    return rows.select(key, "status", line.alias("line"), F.when(F.col("status") == "changed", field_diff()).otherwise(none).alias("diff"))


def quoted(c: Column) -> Column:
    """A value as logs show it: None, or in quotes that it doesn't hold itself."""
    slashed = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        slashed = F.replace(slashed, F.lit(raw), F.lit(shown))
    double = c.contains("'") & ~c.contains('"')
    own = F.when(double, F.concat(F.lit('"'), slashed, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(slashed, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.coalesce(own, F.lit("None"))


def log_text(rows: DataFrame, summary: DataFrame, run_id: str, recorded_at: str, key: str = "identity_key") -> DataFrame:
    """The lines of one run's log, place and line, from its `changelog` and one row of counts; place orders them.

    A place is section, status, event and number within it, so lines of any number of events are sorted by Spark.
    """
    place = lambda section, at=0: F.struct(F.lit(section).alias("section"), F.lit("").alias("line"), F.lit("").alias("event"), F.lit(at).alias("at"))
    counts = [F.col(c) for c in ("new", "changed", "removed", "unchanged")]
    run, recorded, totals = fixed.CHANGELOG_HEAD
    lines = [(place(-1, at=0), F.format_string(run, F.lit(run_id))), (place(-1, at=1), F.format_string(recorded, F.lit(recorded_at))), (place(-1, at=2), F.format_string(totals, *counts))]
    for section, (status, title) in enumerate(fixed.CHANGELOG_TITLES.items()):
        some = F.col(status) > 0
        lines += [(place(2 * section), F.when(some, F.lit(""))), (place(2 * section, at=1), F.when(some, F.format_string(title, F.col(status))))]
    head = summary.select(F.explode(F.array(*[F.struct(p.alias("place"), line.alias("line")) for p, line in lines])).alias("l")).select("l.*").filter("line IS NOT NULL")
    section = sum((F.when(F.col("status") == s, 2 * i + 1).otherwise(0) for i, s in enumerate(fixed.CHANGELOG_TITLES)), F.lit(0))
    fields = F.transform("diff", lambda d: F.format_string(fixed.CHANGELOG_FIELD, d["field"], quoted(d["before"]), quoted(d["after"])))
    body = rows.select("status", key, F.col("line").alias("_line"), F.posexplode(F.concat(F.array(F.format_string(fixed.CHANGELOG_EVENT, "line")), fields)).alias("at", "line"))
    body = body.select(F.struct(section.alias("section"), F.col("_line").alias("line"), F.col(key).alias("event"), "at").alias("place"), "line")
    return head.unionByName(body)


COUNTS = ["new", "changed", "removed", "unchanged"]
LOG = f"identity_key string, status string, line string, diff array<struct<field:string,before:string,after:string>>, {', '.join(f'`{c}` long' for c in COUNTS)}, run_id string, recorded_at string"


def write_changelog(changes: DataFrame, path: str, run_id: str, recorded_at: str) -> bool:
    """Writes <path>/<run_id>.json (JSON rows, one of them with the counts), <run_id>.txt and latest.txt, unless nothing
    was new, changed or removed. Returns whether it did."""
    summary = checkpoint(change_summary(changes))
    counts = summary.first()
    if not counts["total_delta"] and not counts["removed"]:
        return False
    rows = checkpoint(changelog(changes))
    whole = rows.unionByName(summary.select(F.lit("summary").alias("status"), *COUNTS), allowMissingColumns=True)
    whole.withColumn("run_id", F.lit(run_id)).withColumn("recorded_at", F.lit(recorded_at)).write.mode("overwrite").json(f"{path}/{run_id}.json")
    lines = checkpoint(log_text(rows, summary, run_id, recorded_at).orderBy("place").select("line"))
    for name in (run_id, "latest"):
        lines.write.mode("overwrite").text(f"{path}/{name}.txt")
    return True


def logged_runs(spark, path: str) -> list[str]:
    """Ids of the runs that have a log, in order: names of folders, none of which is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(hadoop.Path(path))] if files.exists(hadoop.Path(path)) else []
    return sorted(n.removesuffix(".json") for n in found if n.endswith(".json"))


def logged(spark, path: str, runs: list[str]) -> DataFrame:
    """The rows of some runs' logs; only their folders are read."""
    names = [f"{path}/{run}.json" for run in runs]
    return spark.read.schema(LOG).json(names) if names else spark.createDataFrame([], LOG)


def changelogs(spark, path: str) -> DataFrame:
    """run_id, new, changed, removed of every log, in order of run_id."""
    return logged(spark, path, logged_runs(spark, path)).filter("status = 'summary'").select("run_id", "new", "changed", "removed").orderBy("run_id")


def changelog_of(spark, path: str, run_id: str) -> DataFrame:
    """The rows of one run's log; none, if it has no log."""
    return logged(spark, path, [r for r in logged_runs(spark, path) if r == run_id]).filter("status != 'summary'").drop(*COUNTS)


def latest_changelog(spark, path: str) -> DataFrame:
    """The rows of the run with the greatest id."""
    return logged(spark, path, logged_runs(spark, path)[-1:]).filter("status != 'summary'").drop(*COUNTS)


def shown_changelog(spark, path: str, run_id: str) -> DataFrame:
    """The text of a stored log, line by line, its counts as they were recorded."""
    rows = logged(spark, path, [r for r in logged_runs(spark, path) if r == run_id])
    head = rows.filter("status = 'summary'")
    recorded = head.select("recorded_at").first()
    text = log_text(rows.filter("status != 'summary'"), head, run_id, recorded[0] if recorded else "")
    return text.orderBy("place").select("line")


BRIEF = "performer: string, venue: string, date: string, time_start: string, time_end: string, stage: string"
DOCUMENT = f"run_id string, recorded_at string, summary struct<{', '.join(f'{c}: long' for c in COUNTS)}>, new array<struct<{BRIEF}>>, changed array<struct<{BRIEF}, diff: map<string, struct<before: string, after: string>>>>, removed array<struct<{BRIEF}>>"


def changelog_documents(spark, path: str, names: str = "*.json") -> DataFrame:
    """Logs of the exchange layout, one JSON text a run over any number of lines, as rows: run_id, recorded_at, status, at
    (place in its list), the event's fields, and diff. A text that is no such log has no rows."""
    logs = spark.read.schema(DOCUMENT).option("multiLine", "true").option("pathGlobFilter", names).option("recursiveFileLookup", "true").json(path)
    fields = ["performer", "venue", "date", "time_start", "time_end", "stage"]
    none = F.lit(None).cast("map<string, struct<before: string, after: string>>")
    row = lambda status, diff: lambda e, i: F.struct(F.lit(status).alias("status"), i.alias("at"), *[e[f].alias(f) for f in fields], (e["diff"] if diff else none).alias("diff"))
    lists = [F.transform(F.coalesce(F.col(s), F.array()), row(s, s == "changed")) for s in ("new", "changed", "removed")]
    return logs.filter("run_id IS NOT NULL").select("run_id", "recorded_at", F.inline(F.concat(*lists)))
