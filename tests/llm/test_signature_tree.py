"""Jaccard join over signature trees against all pairs."""

import random

import numpy as np

from concord.llm import signature_tree as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min([v for v in (least.get(r), i) if v is not None], default=None)
    return sorted(((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, root)), key=str)


def joined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, n int, unit int").repartition(4)
    return sorted(map(tuple, S.jaccard_classes(df, **options).collect()), key=str)


def family(rng, base, many, changes):
    out = []
    for _ in range(many):
        words = list(base)
        for at in rng.integers(0, len(words), int(rng.integers(0, changes + 1))):
            words[at] = f"new{rng.integers(10**9)}"
        out.append(" ".join(words))
    return out


def test_families_at_the_threshold_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(12):
        length = int(rng.choice([8, 30, 63, 64, 66, 129, 140, 300]))
        texts += family(rng, [f"w{x}" for x in rng.integers(0, 400, length)], 14, max(1, length // 30))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, rows, percent=60) == brute(rows, 60)


def test_blocks_and_tiles_of_a_few_documents(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in range(90)]
    rows = list(enumerate(family(rng, base, 150, 5)))
    units = spark.createDataFrame([(i, i, len(s), S.signature(s)) for i, s in enumerate(S.shingle_set(t, 3) for _, t in rows)], "unit long, class long, n int, sig binary")
    monkeypatch.setattr(S, "TILE_LEAST", 1000)
    monkeypatch.setattr(S, "TILE_MOST", 1000)
    whole = S.traversed(units, 90, S.apart_of(90, 300), "tile long, other long, i long, j long, side int, unit long, class long")
    sets = spark.createDataFrame([(i, S.shingle_set(t, 3).tobytes()) for i, t in rows], "unit long, whole binary")
    links = [tuple(r) for r in S.verified_blocks(whole, sets, 90).collect()]
    root = list(range(len(rows)))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == [c for _, _, c in sorted(brute(rows), key=lambda r: r[0])]


def test_nulls_empty_repeats_and_short_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "one"), (5, "ONE two"), (6, "one  two"), (None, "one"), (None, "alone in the world"), (7, "É a b"), (8, "é a b"), (9, "a b c d"), (9, "a b c d")]
    assert joined(spark, rows) == brute(rows)


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(40_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1000])), (3, " ".join(words[:20_000])), (4, "short one here")]
    assert joined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert joined(spark, []) == []


def test_traversal_leaves_every_link():
    rng = np.random.default_rng(2)
    sets = [S.shingle_set(" ".join(f"w{x}" for x in rng.integers(0, 60, n)), 1) for n in rng.integers(1, 200, 700)]
    sets.sort(key=len)
    tile = {"n": np.array([len(s) for s in sets]), "sigs": b"".join(map(S.signature, sets))}
    found = {(min(a, b), max(a, b)) for x, y in S.passing(tile, tile, True, 80) for a, b in zip(x.tolist(), y.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found


def test_only_documents_of_unsettled_groups_are_traversed_again(spark, monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") + r.choice("klmnopqr") + r.choice("stuvwxyz") for _ in range(120)) for _ in range(60)]
    texts += [t + " one more end" for t in texts[:10]]
    seen, traversed = [], S.traversed
    monkeypatch.setattr(S, "traversed", lambda units, *a: seen.append(units.count()) or traversed(units, *a))
    out = {x.doc_id: x.component_id for x in S.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {i: i - 60 if i >= 60 else i for i in range(70)}
    assert seen[0] == 70 and sum(seen[1:]) <= 20


def test_leaf_pairs_are_those_of_the_whole_bound():
    r = np.random.default_rng(5)
    sets = []
    for i in range(300):
        own = np.unique(r.integers(0, 1 << 63, r.integers(300, 500)).astype(np.uint64))
        sets.append(np.unique(np.concatenate([sets[-1][: len(sets[-1]) * 95 // 100], own[:12]])) if i % 3 == 2 else own)
    sets.sort(key=len)
    bits = np.array([np.frombuffer(S.signature(s), np.uint64) for s in sets])
    tree = S.Tree(np.arange(300), np.array([len(s) for s in sets]), bits)
    for first in range(0, 300, S.LEAF):
        found = set(zip(*[x.tolist() for x in S.leaf_pairs(tree, tree, first, np.arange(300), 90)]))
        want = set()
        for a in range(first, min(300, first + S.LEAF)):
            shared = np.bitwise_count(bits[a] & bits).sum(1, dtype=np.int64) + np.minimum(tree.slack[a], tree.slack)
            ok = (190 * shared >= 90 * (tree.n[a] + tree.n)) & (100 * np.minimum(tree.n[a], tree.n) >= 90 * np.maximum(tree.n[a], tree.n))
            want |= {(a - first, b) for b in np.flatnonzero(ok).tolist()}
        assert found == want
