"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key from its id and text. The keys' high bits deal a source's rows to buckets, so a
hot source is spread; bucket totals and then rows within a bucket give prefix sums over the source in key order. A
source's target is a whole number of epochs and a rest: all documents are taken once per epoch, and the rest takes
those up to a cutoff key, the last that stays within the budget, and one further document, the one that comes nearest
to what is then missing (if it helps). Documents are never cut. The decision for a document depends on its key and its
source's row in a small plan alone, so texts are not shuffled.

Rows of a source that repeat an id and text share a key, and have places of their own beside each other: a cutoff that
falls among a key's copies takes the number of them that fits. Only the copies of such a key (at most two a source) are
numbered, in blocks of the order they are read in, so a key that a third of all rows share meets in no single task.

Null texts and empty texts have size 0 and are taken as often as their source's epochs say; a null source is a source,
after all others. Sources are ranked in one window; their rows are few beside the documents. An empty table gives an
empty result. Extra columns are kept by `mix` and don't matter; among copies that differ in them, those read first are
taken. Two different documents of a source with one 64-bit key count as copies of their mean size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import WORD, checkpoint, if_small, row_key, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
ROWS_A_BUCKET = 500
#: Prefix sums go over groups of so many buckets, then over the buckets of a group.
BUCKETS_A_GROUP = 1024
#: Copies of a key are numbered in blocks of two to this power rows of a partition.
COPY_BLOCK_BITS = 12
PLAN = ("epochs", "cut_bucket", "cut_key", "some", "buckets")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), row_key(id_col, text_col, source_col).alias("key"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (source, source_size) with target, by weight, where no target passes `most` times its source's size.

    Resharing what is above the bound until nothing is ends at min(most * size, level * weight) for one level: with
    sources in ascending order of bound / weight, the first k are at their bounds for the least k whose level doesn't
    pass the next one's ratio. Levels rise up to that k and fall after it, so it has the largest level that fits.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * float(most)
    ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    own = (
        sources.withColumn("weight", weight)
        .withColumn("bound", bound)
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    return (
        own.withColumn("level", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
        .withColumn("level", F.max("level").over(Window.partitionBy()))
        .select("source", "source_size", F.least("bound", F.coalesce(F.col("level") * F.col("weight"), F.col("bound"))).alias("target"))
    )


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """A row per source: source_size, target, epochs, the cutoff key (null: none), up to which all copies are taken once
    more, and `some`: the keys after it of which n copies are, as (key, n)."""
    keys = rows.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("copies"))
    buckets = max(1, rows.count() // ROWS_A_BUCKET)
    bucket = F.pmod(F.shiftrightunsigned("key", 24), F.lit(buckets))
    keys = checkpoint(keys.select("source", "key", "size", "copies", bucket.alias("bucket")))
    sums = keys.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long"))
    goal = checkpoint(goal.withColumn("rest", F.when(F.col("epochs") < most, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0.0))))
    sums = sums.withColumn("part", F.floor(F.col("bucket") / BUCKETS_A_GROUP))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("source", "part").agg(F.sum("size").alias("size"))
    parts = parts.select(F.col("source").alias("ps"), F.col("part").alias("pp"), before(Window.partitionBy("source").orderBy("part")).alias("ahead"))
    offsets = sums.withColumn("offset", before(Window.partitionBy("source", "part").orderBy("bucket")))
    offsets = offsets.join(parts, F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp")))
    offsets = offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("offset") + F.col("ahead")).alias("offset"))
    # The sources' rows are few beside their buckets, which are few beside the keys: each join leaves the larger side in place if Spark finds the other small.
    within = offsets.join(if_small(goal, 100).select(F.col("source").alias("g"), "rest"), F.col("s").eqNullSafe(F.col("g"))).drop("g")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key")
    placed = keys.withColumn("within", F.sum("size").over(in_bucket)).join(within, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("end", F.col("offset") + F.col("within")).withColumn("first", F.col("end") <= F.col("rest")).withColumn("one", F.col("size") / F.col("copies"))
    order = F.struct("bucket", "key")
    cut = placed.groupBy(F.col("source").alias("c")).agg(
        F.max(F.when(F.col("first"), order)).alias("cut"),
        F.max(F.when(F.col("first"), F.col("end"))).alias("cut_end"),
        F.min(F.when(~F.col("first"), F.struct("bucket", "key", "one"))).alias("next"),
    )
    cut = goal.join(cut, F.col("source").eqNullSafe(F.col("c")), "left").drop("c")
    cut = cut.withColumn("gap", F.col("rest") - F.coalesce("cut_end", F.lit(0)))
    # Of the key that the cutoff falls into, as many copies as fit; they are fewer than all.
    cut = cut.withColumn("fit", F.coalesce(F.floor(F.col("gap") / F.col("next.one")), F.lit(0)).cast("long"))
    cut = checkpoint(cut.withColumn("gap", F.col("gap") - F.coalesce(F.col("fit") * F.col("next.one"), F.lit(0.0))))
    gap = checkpoint(cut.select(F.col("source").alias("g"), "gap").filter("gap >= 1"))
    off = F.abs(F.col("one") - F.col("gap"))
    more = placed.filter(~F.col("first")).select("source", "key", "one").join(if_small(gap, 100), F.col("source").eqNullSafe(F.col("g"))).filter(off < F.col("gap"))
    more = more.groupBy(F.col("source").alias("m")).agg(F.min_by("key", F.struct(off, "key")).alias("extra_key"))
    out = cut.join(more, F.col("source").eqNullSafe(F.col("m")), "left")
    same = F.coalesce(F.col("extra_key") == F.col("next.key"), F.lit(False))
    pair = lambda key, n: F.struct(key.alias("key"), n.cast("long").alias("n"))
    some = F.array(pair(F.col("next.key"), F.col("fit") + same.cast("long")), pair(F.col("extra_key"), F.when(~same, 1).otherwise(0)))
    some = F.filter(some, lambda x: x["key"].isNotNull() & (x["n"] > 0))
    return checkpoint(out.select("source", "source_size", "target", "epochs", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.key").alias("cut_key"), some.alias("some"), F.lit(buckets).alias("buckets")))


def with_times(both: DataFrame) -> DataFrame:
    """The rows (key, source and their source's plan columns) with `times`: how often each is taken."""
    bucket = F.pmod(F.shiftrightunsigned("key", 24), F.col("buckets"))
    before = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & (F.col("key") <= F.col("cut_key")))
    often = F.col("epochs") + F.coalesce(before, F.lit(False)).cast("long")
    copies = F.aggregate("some", F.lit(0).cast("long"), lambda total, x: total + F.when(x["key"] == F.col("key"), x["n"]).otherwise(0))
    marked = both.withColumn("_copies", copies)
    plain = marked.filter("_copies = 0").withColumn("times", often)
    # Written once, so that a row's number in its partition stays.
    cut = checkpoint(marked.filter("_copies > 0").withColumn("_at", F.monotonically_increasing_id()))
    cut = cut.withColumn("_block", F.shiftrightunsigned("_at", COPY_BLOCK_BITS))
    blocks = cut.groupBy("key", "_block").agg(F.count("*").alias("rows"))
    ahead = F.sum("rows").over(Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("key", "_block", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    number = F.row_number().over(Window.partitionBy("key", "_block").orderBy("_at")) + F.col("_ahead")
    cut = cut.join(blocks, ["key", "_block"]).withColumn("times", F.col("epochs") + (number <= F.col("_copies")).cast("long"))
    return plain.unionByName(cut.select(plain.columns))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words)."""
    rows = checkpoint(sized(docs, id_col, text_col, source_col))
    chosen = plan(rows, weights, most).withColumnRenamed("source", "p")
    both = with_times(rows.join(if_small(chosen, 200), F.col("source").eqNullSafe(F.col("p"))))
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents' own rows, each as often as the mix takes it."""
    rows = checkpoint(sized(docs, id_col, text_col, source_col))
    chosen = if_small(plan(rows, weights, most), 200).select(F.col("source").alias("_p"), F.struct(*PLAN).alias("_plan"))
    both = docs.withColumn("_key", row_key(id_col, text_col, source_col)).join(chosen, F.col(source_col).eqNullSafe(F.col("_p")))
    inner = both.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("_key").alias("key"), *[F.col(f"_plan.{c}").alias(c) for c in PLAN])
    taken = with_times(inner).withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return taken.select("_doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
