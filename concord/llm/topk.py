"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are integers floor(scale * x). Candidates are dealt by hash to groups of about GROUP rows and queries to
blocks; each pair of a group and a block is one task's work, joined by key. A group's index holds postings (vector,
dimension) in segments by quantised magnitude. Segments are processed by descending impact, for all queries of the
block at once; each adds quantised impact times query weight to accumulators. What is still missing is at most the
largest remaining magnitude times the sum of the query's absolute weights, so after each segment the vectors that may
be among the k best are known. Processing stops when so few are left that scoring them costs less than the next
segment, or after the last segment; they are then scored exactly. Each group's best k meet in a window by query.

Vectors that are null, or hold null or non-finite components, take no part; so do empty ones. Vectors of different
dimensions are not compared. A query's own row, and any other row with its id, is not its candidate. Repeated
candidates are ranked each; identical query rows are one query. Ties go to the smaller id, null ids first. An empty
table, or no queries, gives an empty result. Extra columns are ignored. Components beyond 2**31 are scored with exact
integers; a score beyond 64 bits is held at the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import checkpoint, table

GROUP, BLOCK, CHUNK = 8192, 2048, 512
SEGMENTS = 6


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def segments(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bound, impacts): quantised signed impacts of one segment's postings, and what a posting may lack after it."""
    size = np.abs(x)
    top = int(size.max(initial=0))
    step = max(1, top // 64)
    level = size // step
    cuts = np.unique(np.quantile(level, np.linspace(0, 1, SEGMENTS + 1)[1:-1]).astype(np.int64))[::-1]
    out, high = [], int(level.max(initial=0)) + 1
    for cut in [*[int(c) for c in cuts if c > 0], 0]:
        if cut < high:
            chosen = (level >= cut) & (level < high)
            out.append((max(step - 1, cut * step - 1), np.where(chosen, np.sign(x) * level * step, 0)))
            high = cut
    return out


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of each query's k best; ids, own: identifiers, equal for own rows."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    exact = most < 1 << 53
    kind = np.float32 if most < 1 << 23 else np.float64
    parts = segments(x) if exact else []
    index = [(bound, impacts.astype(kind)) for bound, impacts in parts]
    order = np.argsort(ids, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), CHUNK):
        w, names = q[at : at + CHUNK], own[at : at + CHUNK]
        first, last = np.searchsorted(ids[order], names, "left"), np.searchsorted(ids[order], names, "right")
        acc, norm, members = np.zeros((len(w), len(x)), kind), np.abs(w).sum(1).astype(np.float64), None
        for j in range(len(w)):
            acc[j, order[first[j] : last[j]]] = -np.inf
        for i, (bound, impacts) in enumerate(index):
            acc += w.astype(kind) @ impacts.T
            lack = (bound * norm)[:, None]
            if i + 1 < len(index) and i < len(index) // 2:
                continue
            if len(x) > k:
                floor = np.partition(acc, len(x) - k, axis=1)[:, len(x) - k, None].astype(np.float64) - lack
                members = acc + lack >= floor
            else:
                members = np.ones(acc.shape, bool)
            members &= acc != -np.inf
            if np.count_nonzero(members) * 4 < members.size:
                break
        if members is None:
            members = acc != -np.inf
        for j in range(len(w)):
            rows = np.flatnonzero(members[j])
            if exact:
                score = (x[rows].astype(np.float64) @ w[j].astype(np.float64)).astype(np.int64)
            else:
                score = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x[r], w[j])))) for r in rows], np.int64)
            keep = np.lexsort((ids[rows], -score))[:k] if exact else np.array(sorted(range(len(rows)), key=lambda r: (-int(score[r]), ids[rows[r]]))[:k], np.int64)
            found.append((np.full(len(keep), at + j), rows[keep], score[keep]))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*found) if found else ([], [], [])))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores."""
    finite = F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vec_col).isNotNull() & finite & (F.size(vec_col) > 0))
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.transform(vec_col, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"))
    rows = checkpoint(rows.withColumn("dim", F.size("v")).withColumn("hash", F.xxhash64("id", "v")))
    n, many = rows.agg(F.count("*"), F.count_if("is_query")).first()
    groups, blocks = max(1, -(-n // GROUP)), max(1, -(-many // BLOCK))
    place = lambda name, parts: F.pmod("hash", F.lit(parts)).cast("int").alias(name)
    every = lambda name, parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    key = ["dim", "part", "block"]
    candidates = rows.select("id", "v", "dim", place("part", groups), every("block", blocks)).groupBy(*key)
    queries = rows.filter("is_query").dropDuplicates(["id", "v"]).select("id", "v", "hash", "dim", place("block", blocks), every("part", groups)).groupBy(*key)
    schema = "query_id long, query_hash long, vec_id long, score long"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "query_hash", "vec_id", "score")})
        dim = left.column("dim")[0].as_py()
        least = np.iinfo(np.int64).min
        names = lambda t: np.array([least if v is None else v for v in t.column("id").to_pylist()], np.int64)
        ids, own = names(left), names(right)
        a, b, score = best(matrix(left.column("v"), dim), ids, matrix(right.column("v"), dim), own, k)
        back = lambda v: pa.array(v, mask=v == least)
        return pa.table({"query_id": back(own[a]), "query_hash": right.column("hash").to_numpy()[a], "vec_id": back(ids[b]), "score": score})

    near = candidates.cogroup(queries).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_first()))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
