import random

import pytest

from concord.llm import mixing


def filled(sizes, weights, most):
    """Water-filling step by step, as the rule is told."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def documents(spark, seed, sources):
    r = random.Random(seed)
    rows = []
    for s, n in sources.items():
        for _ in range(n):
            rows.append((len(rows), " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 400]))), s, "x", 1.0))
    rows += [(10_000, None, next(iter(sources)), "x", 1.0), (3, rows[3][1], rows[3][2], "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, target double")


@pytest.mark.parametrize("sources", [{"a": 300, "b": 40, "c": 30, "d": 5, None: 20}, {"Z": 5, "a": 500, "é": 60}, {"only": 50}])
def test_targets_and_taken(spark, sources):
    docs = documents(spark, 2, sources)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: (r.source, len((r.text or "").split())) for r in docs.collect()}
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = filled(sizes, mixing.WEIGHTS, mixing.MOST_EPOCHS)
    taken = {}
    for r in rows:
        source, size = text[r.doc_id]
        assert r["size"] == size and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source], rel=1e-9)
        assert r.taken in {size * k for k in range(4)}
        taken[source] = taken.get(source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 200.5, s  # half the largest document
    again = sorted((r.doc_id, r.taken) for r in mixing.mixture(docs.repartition(7)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in rows)


def test_mix_returns_rows_as_often(spark):
    docs = documents(spark, 4, {"a": 200, "b": 30, "c": 8})
    want = {}
    for r in mixing.mixture(docs).collect():
        if r["size"]:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken // r["size"]
    got = {}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        if len((r.text or "").split()):
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_rows_have_places_of_their_own(spark, monkeypatch, parts):
    monkeypatch.setattr(mixing, "COPY_BLOCK_BITS", 3)  # many blocks of copies
    ten = " ".join(["w"] * 10)
    rows = [(1, ten, "a", "x", 1.0)] * 100 + [(2, ten, "b", "x", 1.0)] * 150 + [(3, None, None, None, None)] * 30 + [(4, ten, None, "x", 1.0)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, times double").repartition(parts)
    got = mixing.mixture(docs).collect()
    sizes = {"a": 1000, "b": 1500, None: 90}
    want = filled(sizes, mixing.WEIGHTS, mixing.MOST_EPOCHS)
    name = {1: "a", 2: "b", 3: None, 4: None}
    assert len(got) == len(rows)
    for s, target in want.items():
        mine = [r.taken for r in got if name[r.doc_id] == s]
        assert abs(sum(mine) - target) <= 5, s  # half a document
        assert max(mine) <= 30
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = {k: sum(1 for r in out.collect() if r.doc_id == k) for k in (1, 2, 4)}
    assert times == {k: sum(r.taken for r in got if r.doc_id == k) // 10 for k in (1, 2, 4)}


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 2_000_000, "a"), *[(k, "x y z", "b") for k in range(2, 40)]], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mixture(docs).collect()}
    assert got[1]["size"] == 2_000_000 and got[1].taken in (0, 2_000_000, 4_000_000, 6_000_000)
    assert sum(got[k].taken for k in range(2, 40)) == 3 * 3 * 38


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixture(empty).collect() == [] and mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, " \n", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mixture(blank).collect()] == [(0, 0.0, 0)] * 3
