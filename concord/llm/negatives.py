"""Hard negatives by product quantisation with stored residual norms.

Vectors become integers floor(scale * x). Rows are dealt by hash to groups of about CELLS components. A group's index is
one written row: for each of PARTS subspaces CENTROIDS centroids (k-means on at most TRAINED of the group's rows), and of
every row its codes, the norm of its residual in each subspace, and its integers. Anchors come in blocks; a group and a
block are one task's work, named by key.

A row's score lies within the sum of table entries plus or minus the sum over subspaces of the anchor's norm times the
residual's (Cauchy-Schwarz). So rows whose upper bound is below the k-th best lower bound can't be among the k best, and
rows whose bounds miss a window can't be in it. What is left is scored with exact integers. Positives come first, from
all groups; then the windows that they set are completed in a second pass over the same index.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different dimensions
are not compared. A row is not its own positive or negative, but another row with its id may be. Repeated anchor rows
are anchors each. Ties go to the smaller id, null ids last, then to the row that comes first. A positive of negative score
has an empty window. An empty table, or no anchors, gives an empty result. Extra columns are ignored. Products
beyond 64 bits are held at the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import checkpoint, release, table

#: Components of a group's vectors, of a block's; components of approximate scores held at once.
CELLS, BLOCK_CELLS, CHUNK = 1 << 19, 1 << 17, 64
PARTS, CENTROIDS, TRAINED, ROUNDS = 8, 32, 2048, 6
NO_ID = np.iinfo(np.int64).max


def quantiser(x: np.ndarray) -> list[np.ndarray]:
    """A codebook (centroids, width) for each subspace, from the first TRAINED rows."""
    books = []
    for part in np.array_split(x[:TRAINED].astype(np.float64), min(PARTS, x.shape[1]) or 1, axis=1):
        book = part[np.unique(np.linspace(0, len(part) - 1, CENTROIDS).astype(np.int64))]
        for _ in range(ROUNDS):
            near = nearest(part, book)
            size = np.bincount(near, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, near, part)
            book = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], book)
        books.append(book)
    return books


def nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * (part @ book.T), axis=1)


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """codes (rows, subspaces) and residual norms, rounded up."""
    codes, norms = [], []
    for part, book in zip(np.array_split(x.astype(np.float64), len(books), axis=1), books):
        codes.append(nearest(part, book))
        norms.append(np.sqrt(((part - book[codes[-1]]) ** 2).sum(1)) * (1 + 1e-9))
    return np.stack(codes, 1).astype(np.uint8), np.stack(norms, 1)


def bounds(q: np.ndarray, books: list[np.ndarray], codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of every query's score with every row: table entries, less and plus the residual's share."""
    parts = np.array_split(q.astype(np.float64), len(books), axis=1)
    middle = sum((part @ book.T)[:, codes[:, m]] for m, (part, book) in enumerate(zip(parts, books)))
    reach = np.stack([np.sqrt((part * part).sum(1)) for part in parts], 1) @ norms.T
    reach += 1e-6 + 1e-9 * (np.abs(middle) + reach)  # what doubles may round away
    return middle - reach, middle + reach


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with rows."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, len(q))
    if most < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return x @ q
    held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    return np.array([held(sum(int(a) * int(b) for a, b in zip(row, q))) for row in x], np.int64)


def first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    # ~score falls as score rises, without overflow at the least number.
    return np.lexsort((rows, ids, ~score))[:k]


def kth_best(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def positives(index: dict, block: dict, k: int) -> Iterator[tuple]:
    """(anchor position, row position, score): each anchor's k best rows of its label."""
    for at in range(0, len(block["rows"]), CHUNK):
        lower, upper = bounds(block["v"][at : at + CHUNK], index["books"], index["codes"], index["norms"])
        for j in range(len(lower)):
            a = at + j
            same = np.flatnonzero((index["labels"] == block["labels"][a]) & (index["rows"] != block["rows"][a]))
            may = same[upper[j, same] >= kth_best(lower[j, same], k)]
            score = exact(block["v"][a], index["v"][may])
            for i in first(score, index["ids"][may], index["rows"][may], k):
                yield a, int(may[i]), int(score[i])


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """The integers n with least * score <= 100 * n <= most * score."""
    return -((-least * score) // 100), (most * score) // 100


def negatives(index: dict, block: dict, k: int, least: int, most: int) -> Iterator[tuple]:
    """(anchor position, positive's place, row position, score): each window's k best rows of other labels."""
    for at in range(0, len(block["rows"]), CHUNK):
        lower, upper = bounds(block["v"][at : at + CHUNK], index["books"], index["codes"], index["norms"])
        for j in range(len(lower)):
            a = at + j
            other = np.flatnonzero(index["labels"] != block["labels"][a])
            low, high = lower[j, other], upper[j, other]
            for place, positive in enumerate(block["scores"][a]):
                start, end = window(positive, least, most)
                may = (high >= start) & (low <= end)
                surely = (low >= start) & (high <= end)
                rows = other[may & (high >= kth_best(low[surely], k))]
                if start > end or not len(rows):
                    continue
                score = exact(block["v"][a], index["v"][rows])
                inside = (score >= start) & (score <= end)
                rows, score = rows[inside], score[inside]
                for i in first(score, index["ids"][rows], index["rows"][rows], k):
                    yield a, place, int(rows[i]), int(score[i])


def unpacked(row: dict) -> dict:
    """Arrays of a group's or block's row."""
    many, dim = row["many"], row["dim"]
    whole = lambda c: np.frombuffer(row[c], np.int64)
    out = {"rows": whole("rows"), "ids": whole("ids"), "labels": whole("labels"), "v": whole("v").reshape(many, dim)}
    if row["codes"] is not None:
        widths = [len(x) for x in np.array_split(np.zeros(dim), min(PARTS, dim) or 1)]
        flat, size = np.frombuffer(row["books"], np.float64), row["centroids"]
        ends = np.cumsum([0, *[size * w for w in widths]])
        out["books"] = [flat[a:b].reshape(size, w) for a, b, w in zip(ends, ends[1:], widths)]
        out["codes"] = np.frombuffer(row["codes"], np.uint8).reshape(many, len(widths))
        out["norms"] = np.frombuffer(row["norms"], np.float64).reshape(many, len(widths))
    return out


PACKED = "dim int, place int, many int, rows binary, ids binary, labels binary, v binary, centroids int, books binary, codes binary, norms binary, scores array<array<long>>"


def packed(t: pa.Table, place: str, indexed: bool) -> pa.Table:
    """One row that holds a group or block; of a group also its quantiser and codes."""
    order = np.argsort(t.column("row").to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    dim = t.column("dim")[0].as_py()
    ids = np.array([NO_ID if v is None else v for v in t.column("id").to_pylist()], np.int64)
    x = np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]]).reshape(t.num_rows, dim)
    raw = lambda a, kind=np.int64: pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())
    out = {"dim": pa.array([dim], pa.int32()), "place": pa.array([t.column(place)[0].as_py()], pa.int32()), "many": pa.array([t.num_rows], pa.int32()), "rows": raw(t.column("row").to_numpy()), "ids": raw(ids), "labels": raw(t.column("label").to_numpy()), "v": raw(x)}
    books = quantiser(x) if indexed else []
    codes, norms = encode(x, books) if indexed else (None, None)
    none = pa.nulls(1, pa.binary())
    out |= {"centroids": pa.array([len(books[0]) if books else None], pa.int32()), "books": raw(np.concatenate([b.ravel() for b in books]), np.float64) if books else none, "codes": raw(codes, np.uint8) if indexed else none, "norms": raw(norms, np.float64) if indexed else none}
    scores = t.column("scores").combine_chunks() if "scores" in t.column_names else pa.nulls(t.num_rows, pa.list_(pa.int64()))
    return pa.table(out | {"scores": pa.array([scores.to_pylist()], pa.list_(pa.list_(pa.int64())))})


def paired(index: DataFrame, blocks: DataFrame, groups: int, many: int, search, ddl: str) -> DataFrame:
    """search(index, block) of every group and block of one dimension; each pair is dealt by its key."""
    spread = lambda df, name, of, parts: df.withColumnRenamed("place", name).withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = spread(index, "part", "block", many).unionByName(spread(blocks, "block", "part", groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        waiting: dict[tuple, dict] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                key = (row["dim"], row["part"], row["block"])
                if key not in waiting:
                    waiting[key] = row
                    continue
                one = waiting.pop(key)
                left, right = (one, row) if one["codes"] is not None else (row, one)
                found = search(unpacked(left), unpacked(right) | {"scores": right["scores"]})
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ddl.replace(" long", "").split(", ")])
    return both.repartition(groups * many, "dim", "part", "block").mapInArrow(run, ddl)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, k: int = 5, least: int = 80, most: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = CELLS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Each anchor's positives are its k best other rows of the same label. Of each, the negatives are the k best rows of
    other labels whose score is from `least` to `most` percent of the positive's.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vec_col).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.select("id", "label", "anchor", F.transform("x", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"))
    # Numbers by place in a written table stay the same when a lost part is computed again.
    rows = checkpoint(rows.withColumn("dim", F.size("v")))
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    size = F.sum(F.greatest("dim", F.lit(1)).cast("long"))
    total, anchored = rows.agg(size, F.sum(F.when(F.col("anchor"), F.greatest("dim", F.lit(1)).cast("long")))).first()
    groups, many = max(1, -(-(total or 0) // cells)), max(1, -(-(anchored or 0) // block_cells))
    place = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    index = checkpoint(rows.drop("anchor").withColumn("part", place(groups)).groupBy("dim", "part").applyInArrow(lambda t: packed(t, "part", True), PACKED))
    anchors = rows.filter("anchor").drop("anchor").withColumn("block", place(many))
    blocks = anchors.groupBy("dim", "block").applyInArrow(lambda t: packed(t, "block", False), PACKED)

    def near(index: dict, block: dict) -> list[dict]:
        return [{"anchor": block["rows"][a], "row": index["rows"][i], "id": index["ids"][i], "score": s} for a, i, s in positives(index, block, k)]

    best = lambda df, *key: df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id", "row"))).filter(F.col("rank") <= k)
    chosen = checkpoint(best(paired(index, blocks, groups, many, near, "anchor long, row long, id long, score long"), "anchor"))
    # At most k a row; in the order of their ranks.
    lists = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    asking = anchors.join(lists, anchors["row"] == lists["anchor"]).select("id", "label", "v", "dim", "row", "block", F.col("p.score").alias("scores"))
    blocks = asking.groupBy("dim", "block").applyInArrow(lambda t: packed(t, "block", False), PACKED)

    def hard(index: dict, block: dict) -> list[dict]:
        found = negatives(index, block, k, least, most)
        return [{"anchor": block["rows"][a], "anchor_id": block["ids"][a], "place": p + 1, "row": index["rows"][i], "id": index["ids"][i], "score": s} for a, p, i, s in found]

    mined = best(paired(index, blocks, groups, many, hard, "anchor long, anchor_id long, place long, row long, id long, score long"), "anchor", "place")
    of = chosen.select(F.col("anchor").alias("_anchor"), F.col("rank").alias("_place"), F.col("id").alias("_id"), F.col("score").alias("positive_score"))
    known = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c))
    out = mined.join(of, (F.col("anchor") == F.col("_anchor")) & (F.col("place") == F.col("_place")))
    return out.select(known("anchor_id").alias("anchor_id"), known("_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same
  ) WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
) WHERE rank <= 5
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabelled)
