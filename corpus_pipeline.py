"""The corpus pipeline: quality, toxicity, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
returns the packed pieces. The stages' models learn from the labels of the documents that reach them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import mixing, packing, quality, simhash, toxicity
from concord.llm.common import checkpoint, if_small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of an Arrow batch while a stage runs: several copies of a batch of texts lie in an executor for each of its tasks.
BATCH_ROWS = 2000
#: Distinct words whose ids a packing worker keeps, about 80 MB: its executor still holds what earlier stages made it take.
PACKED_WORDS = 300_000


def bounded(stage):
    """The stage, in a session whose Arrow batches hold BATCH_ROWS rows at most."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(name, "10000"))
        spark.conf.set(name, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier expects to be above the lowest grade."""
    model, grades = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, grades, keep=COLUMNS).filter("selected").select(COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below 0.7. A null id is judged by its text like any other."""
    found = toxicity.score(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(), keep=COLUMNS)
    return found.filter("predicted = 0").select(COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least id (null ids last), then digest of its text. Rows
    with one id and different texts are documents of their own; of rows with equal id and text, one stays."""
    key = ["doc_id", "digest", "tag"]
    classes = simhash.near_duplicates(docs).groupBy(*key).agg(F.min("component").alias("component"), F.count("*").alias("_rows"))
    classes = checkpoint(classes.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), *key)))
    best = classes.groupBy(F.col("component").alias("_c")).agg(F.min("_key").alias("_best"))
    classes = classes.join(best, F.col("component") == F.col("_c"))
    # What goes, and of what stays the rows that are repeated: usually few.
    gone = checkpoint(classes.filter(~F.col("_key").eqNullSafe(F.col("_best")) | (F.col("_rows") > 1)).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_key").eqNullSafe(F.col("_best")).alias("_kept")))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*COLUMNS, F.xxhash64(text).alias("digest"), F.hash(text).alias("tag"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("digest") == F.col("_digest")) & (F.col("tag") == F.col("_tag"))
    out = keyed.join(if_small(gone, 40), same, "left_anti").select(COLUMNS)
    again = gone.filter("_kept")
    if again.isEmpty():
        return out
    one = keyed.join(if_small(again, 40), same, "left_semi").groupBy(*key).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return out.unionByName(one.select("doc_id", "r.*").select(COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix(docs).select(COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.digests(packing.pack(docs, room=PACKED_WORDS))


STAGES = [(name, bounded(stage)) for name, stage in [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", distinct_documents), ("mixing", mixed_sources), ("packing", packed_sequences)]]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
