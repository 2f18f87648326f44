import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q is None or q % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(set(out))


@pytest.mark.parametrize("group,block", [(8192, 2048), (40, 7)])
def test_against_brute_force(spark, monkeypatch, group, block):
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "BLOCK", block)
    r = random.Random(0)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    rows += [(400, rows[10][1]), (401, rows[10][1]), (402, [0.0] * 16), (405, [-1.5] * 16), (406, None), (407, []), (410, [float("nan")] * 16), (411, [None] * 16), (412, [float("inf")] * 16), (415, [1.0, 2.0]), (416, [0.5, -1.0]), (15, rows[15][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 5 == 0).collect())
    assert got == brute(dict(rows).items(), 5) or got == brute(rows, 5)


def test_huge_components_are_exact(spark):
    rows = [(0, [1e9, -3e8]), (1, [2e9, 1.0]), (2, [1e9, 7e8]), (3, [-1e9, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") == 0, k=2, scale=1).orderBy("rank").collect()]
    want = sorted([(-(int(a) * 10**9 + math.floor(b) * -300_000_000), i) for i, (a, b) in rows if i])[:2]
    assert got == [(i, -s) for s, i in want]


def test_no_queries_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.1])], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") == 99).collect() == [] == topk.top_k(df.limit(0), F.lit(True)).collect()


def test_stops_only_on_proof():
    r = np.random.default_rng(1)
    x = (r.standard_normal((3000, 32)) * 40).astype(np.int64)
    x[:5] = 3 * x[5:10]
    q = x[:20]
    a, b, s = topk.best(x, np.arange(3000), q, np.full(20, -1), 5)
    full = q @ x.T
    for j in range(20):
        want = sorted((-full[j, i], i) for i in range(3000))[:5]
        assert [(-v, i) for v, i in zip(s[a == j], b[a == j])] == want
