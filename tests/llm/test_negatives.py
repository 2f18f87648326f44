"""Hard negatives against brute force."""

import numpy as np
from pyspark.sql import functions as F

from concord.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, anchors, k=5, least=80, most=100):
    rows = [(i, r) for i, r in enumerate(rows) if r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows = [(i, v, np.floor(np.array(x, np.float32).astype(np.float64) * 256), y) for i, (v, x, y, *_) in rows]
    rows = [(i, v, [int(c) for c in x], y) for i, v, x, y in rows]
    out = []
    for i, v, x, y in rows:
        if not anchors(v):
            continue
        scored = [(-sum(a * b for a, b in zip(x, z)), 1 << 62 if w is None else w, label) for j, w, z, label in rows if j != i and len(z) == len(x)]
        for s, w, _ in sorted(s for s in scored if s[2] == y)[:k]:
            inside = sorted(t for t in scored if t[2] != y and least * -s <= 100 * -t[0] <= most * -s)[:k]
            out += [(v, w, rank, u, -s, -t) for rank, (t, u, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, anchor, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, N.hard_negatives(df, anchor, F.col("label"), **options).collect()))


def vectors(seed, many, dim=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, dim))
    return [(i, [float(x) for x in (middle[i % 4] + rng.normal(size=dim)).astype(np.float32)], int(rng.integers(0, 3)), "clash") for i in range(many)]


def test_against_brute_force_over_many_groups_and_blocks(spark):
    rows = vectors(0, 400)
    assert mined(spark, rows, F.col("vec_id") % 10 == 0, cells=600, block_cells=100) == brute(rows, lambda v: v % 10 == 0)


def test_wide_windows_and_few_partners(spark):
    rows = vectors(1, 60, 3)
    assert mined(spark, rows, F.lit(True), k=2, least=10, most=150, cells=90) == brute(rows, lambda v: True, 2, 10, 150)


def test_nulls_other_dimensions_and_ties(spark):
    odd = [(900, None, 1, ""), (901, [1.0, None], 1, ""), (902, [1.0, float("nan")], 1, ""), (903, [1.0, float("inf")], 1, ""), (904, [1.0, 2.0], None, ""), (905, [0.5], 0, ""), (906, [0.5], 0, ""), (907, [0.5], 1, ""), (908, [], 1, "")]
    ties = [(i, [1.0, 1.0], i % 3, "") for i in range(30)]
    rows = odd + ties
    assert mined(spark, rows, F.col("vec_id") % 5 == 0) == brute(rows, lambda v: v % 5 == 0)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = vectors(2, 20, 4) * 2 + [(0, [9.0, 9.0, 9.0, 9.0], 1, "")]
    found = mined(spark, rows, F.col("vec_id") == 0)
    assert found == brute(rows, lambda v: v == 0)


def test_a_null_id_comes_last(spark):
    rows = [(1, [1.0], 0, ""), (2, [1.0], 0, ""), (None, [1.0], 1, ""), (3, [1.0], 1, "")]
    found = N.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 1, F.col("label")).orderBy("rank").collect()
    assert [r["negative_id"] for r in found] == [3, None]


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-500, 500, (300, 20)), rng.integers(-500, 500, (40, 20))
    books = N.quantiser(x)
    low, high = N.bounds(q, books, *N.encode(x, books))
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all()


def test_large_components_are_scored_exactly(spark):
    rows = [(i, [float(2**45 + i * 2**22), 3.0], i % 2, "") for i in range(8)]
    assert all(r[4] == (1 << 63) - 1 for r in mined(spark, rows, F.col("vec_id") == 0))


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, [], F.lit(True)) == [] and mined(spark, vectors(4, 5), F.lit(False)) == []
