import itertools
import random

import numpy as np
import pytest
import xxhash

from concord.llm import simhash


def slow_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprint():
    for text in ["", " \n", "One", "one two", "A b c d E f", "é É x\xa0y z", "w " * 50000, "a b a b a b a b"]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(30):
        base = [r.choice(vocabulary) for _ in range(120)]
        for c in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(c):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [None, "", "  ", "one", "ONE", rows[0], rows[0], rows[5].upper(), "tiny text", "tiny text"]
    made = [(i * 3, t, "clash", 7) for i, t in enumerate(rows)] + [(None, "no id here", "x", 1), (0, rows[0], "clash", 7)]
    return spark.createDataFrame(made, "doc_id long, text string, fp string, tile long")


def test_classes_against_all_pairs(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    prints = {i: simhash.fingerprint(t) for i, (_, t) in enumerate(rows)}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = roots(prints, linked)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    want = sorted(((d, f"{prints[i] - (1 << 64) * (prints[i] >> 63):d}", least.get(root[i])) for i, (d, _) in enumerate(rows)), key=repr)
    got = sorted(((r.id, str(r.fp), r.component_id) for r in simhash.classes(simhash.fingerprints(docs), 2).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("radius", [2, 8])
def test_links_keep_components(spark, radius):
    r = random.Random(1)
    values = set()
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(6):
            values.add(base)
            for _ in range(r.randint(1, 3)):
                base ^= 1 << r.randrange(64)
    values |= {0, (1 << 64) - 1, 1, 3}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    found = simhash.links(fps, radius) if radius == 2 else simhash.wide_links(fps, radius, tile=16, across=8)
    got = roots([v for v, in signed], [(x.a, x.b) for x in found.collect()])
    linked = [(a, b) for (a,), (b,) in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    assert got == roots([v for v, in signed], linked)


def test_split_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 5)
    fps = spark.createDataFrame([(1 << i | 1 << j,) for i in range(16) for j in range(i)], "fp long")
    values = [r.fp for r in fps.collect()]
    linked = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2]
    assert roots(values, [(x.a, x.b) for x in simhash.links(fps, 2).collect()]) == roots(values, linked)


@pytest.mark.parametrize("a_task", [20, 1000])
def test_components_of_a_chain_and_a_star(spark, a_task):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), a_task=a_task).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}


def test_near_duplicates_against_all_pairs(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if simhash.similarity(rows[a][1], rows[b][1]) >= 0.8]
    root, least = roots(range(len(rows)), linked), {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    want = sorted(((d, least.get(root[i])) for i, (d, _) in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr) == want


def test_one_id_with_several_texts(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (None, a), (None, "alone in here")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 5 and len({r.component for r in got}) == 3


def test_empty_table(docs):
    assert simhash.classes(simhash.fingerprints(docs.limit(0)), 2).collect() == []
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_near_pairs_in_steps():
    flat = lambda found: sorted((int(a), int(b)) for x, y in found for a, b in zip(x, y))
    x = np.array([0, 1, 3, 7, 255], np.uint64)
    assert flat(simhash.near_pairs(x, x, 1, True, step=5)) == [(0, 1), (1, 2), (2, 3)]
    assert flat(simhash.near_pairs(x[:2], x[2:], 1, False, step=2)) == [(1, 0)]


def test_forest_spans():
    r = random.Random(9)
    edges = [(a, b) for a, b in itertools.combinations(range(40), 2) if r.random() < 0.06]
    f = simhash.Forest(40)
    for a, b in edges:
        f.add(np.array([a]), np.array([b]))
    assert roots(range(40), f.edges) == roots(range(40), edges) and len(f.edges) == 40 - len(set(roots(range(40), edges).values()))


def words_of(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def near_rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_every_copy_in_a_dense_family_is_joined(spark):
    r = random.Random(5)
    shared, texts = words_of(r, 225), []
    for _ in range(150):
        own = shared + words_of(r, 75)
        copy = list(own)
        for i in r.sample(range(300), 3):
            copy[i] = words_of(r, 1)[0]
        texts += [" ".join(own), " ".join(copy)]
    linked = [(a, b) for a, b in itertools.combinations(range(300), 2) if simhash.similarity(texts[a], texts[b]) >= 0.8]
    assert len(linked) >= 140
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(near_rows(spark, texts)).collect()}
    assert got == roots(range(300), linked)


def test_edited_passages_beyond_the_radius(spark):
    r = random.Random(8)
    texts, far = [], 0
    for k in range(200):
        own = words_of(r, r.randint(100, 400))
        n = len(own)
        if k % 3 == 0:
            copy = own + words_of(r, int(n * 0.2))
        elif k % 3 == 1:
            copy = own[: n // 3] + words_of(r, int(n * 0.08)) + own[n // 3 + int(n * 0.08) :]
        else:
            copy = own + own[:6] * n  # one line repeated
        pair = " ".join(own), " ".join(copy)
        texts += pair
        far += simhash.similarity(*pair) >= 0.8 and (simhash.fingerprint(pair[0]) ^ simhash.fingerprint(pair[1])).bit_count() > 11
    assert far >= 20
    linked = [(2 * k, 2 * k + 1) for k in range(200) if simhash.similarity(texts[2 * k], texts[2 * k + 1]) >= 0.8]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(near_rows(spark, texts)).collect()}
    assert got == roots(range(400), linked)


@pytest.mark.parametrize("few, members, block_bytes", [(1, 3, 1 << 20), (1, 1000, 200), (1, 1000, 1 << 20), (2, 4, 1 << 20), (32, 1000, 1 << 20)])
def test_exact_links_alone(docs, few, members, block_bytes):
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    texts = docs.filter("doc_id IS NOT NULL").selectExpr("doc_id AS id", "coalesce(text, '') AS text").selectExpr("id", "xxhash64(text) AS digest", "hash(text) AS tag", "text")
    known = texts.selectExpr("id AS unit", "id AS first", "digest", "tag", "id AS class").distinct()
    found = [(x.u, x.v) for x in simhash.exact_links(texts, known, 0.8, 5, few=few, members=members, block_bytes=block_bytes).collect()]
    assert all(simhash.similarity(rows[a], rows[b]) >= 0.8 for a, b in found)
    linked = [(a, b) for a, b in itertools.combinations(rows, 2) if simhash.similarity(rows[a], rows[b]) >= 0.8]
    assert roots(rows, found) == roots(rows, linked)


def test_common_shingles_are_the_commonest(spark):
    rows = spark.createDataFrame([((x << 32) + i,) for x, n in ((5, 1), (9, 2), (-3, 2), (7, 4), (1, 3)) for i in range(n)], "shingle long")
    of = lambda most: {int(x): int(c) for x, c in zip(*simhash.common_shingles(rows, most))}
    assert of(10) == {9: 2, (1 << 32) - 3: 2, 7: 4, 1: 3} and of(3) == of(2) == {7: 4, 1: 3} and of(0) == {}
    values, _ = simhash.common_shingles(rows)
    assert list(values) == sorted(values)


def test_bands_of_population_counts():
    assert simhash.bands({30: 5, 31: 4, 32: 25, 33: 1, 40: 9}, 10) == [(30, 31, 1), (32, 32, 3), (33, 40, 1)]
    assert simhash.bands({}, 10) == []


def test_components_of_edges_that_one_task_holds_make_no_stars(spark, monkeypatch):
    written = []
    monkeypatch.setattr(simhash, "checkpoint", lambda df, keep=simhash.checkpoint: written.append(keep(df)) or written[-1])
    edges = spark.createDataFrame([(3, 2), (2, 1), (9, 8), (8, 8)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {2: 1, 3: 1, 9: 8}
    assert len(written) == 2


def test_texts_lie_by_their_keys_once_joined(spark):
    rows = spark.createDataFrame([(1, 5, 6, "a"), (1, 5, 6, "a"), (None, 7, 8, "b"), (2, 7, 8, "b")], "id long, digest long, tag int, text string")
    units = spark.createDataFrame([(10, 1, 5, 6), (11, None, 7, 8)], "unit long, first long, digest long, tag int")
    found = simhash.texts_of(rows.hint("shuffle_merge"), units)
    assert sorted((r.unit, r.id) for r in found.collect()) == [(10, 1), (10, 1), (11, None)]
    again = found.groupBy("digest", "tag", "_id").agg({"text": "min"})
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert again.count() == 2


@pytest.mark.parametrize("loose, most", [(4, 4 << 20), (4, 0), (0, 0)])
def test_marks_and_shuffled_sets_lose_no_link(docs, loose, most, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", most)
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    texts = docs.filter("doc_id IS NOT NULL").selectExpr("doc_id AS id", "coalesce(text, '') AS text").selectExpr("id", "xxhash64(text) AS digest", "hash(text) AS tag", "text")
    known = texts.selectExpr("id AS unit", "id AS first", "digest", "tag", "id AS class").distinct()
    found = [(x.u, x.v) for x in simhash.exact_links(texts, known, 0.8, 5, few=3, members=20, loose=loose).collect()]
    assert all(simhash.similarity(rows[a], rows[b]) >= 0.8 for a, b in found)
    linked = [(a, b) for a, b in itertools.combinations(rows, 2) if simhash.similarity(rows[a], rows[b]) >= 0.8]
    assert roots(rows, found) == roots(rows, linked)


def test_sets_of_many_units_are_made_where_the_texts_lie(spark, monkeypatch):
    texts = ["a b c d e f", "a b c d e f", "", "x y", "g h i j k l m"]
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "id long, text string").selectExpr("id", "xxhash64(text) AS digest", "hash(text) AS tag", "text")
    rows = rows.unionByName(rows)
    units = rows.groupBy("digest", "tag").agg({"id": "min"}).withColumnRenamed("min(id)", "first").selectExpr("monotonically_increasing_id() AS unit", "first", "digest", "tag", "true AS several")
    units = simhash.checkpoint(units)
    sets = lambda: sorted((r.unit, r.n, bytes(r.whole)) for r in simhash.unit_sets(rows, units, 5).collect())
    want = sets()
    assert len(want) == 4
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    assert sets() == want
    some = units.limit(1)
    assert [r.unit for r in simhash.unit_sets(rows, some, 5).collect()] == [r.unit for r in some.collect()]


def test_marks_bound_the_intersection():
    r = np.random.default_rng(3)
    sets = []
    for n in (0, 0, 1, 2, 31, 33, 40, 200, 256, 257, 300, 2000):
        own = r.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(own), np.unique(np.concatenate([own[: int(n * 0.92)], r.integers(0, 1 << 63, n // 12, dtype=np.uint64)]))]
    n, zero = np.array([len(x) for x in sets]), np.zeros(len(sets), np.int64)
    same = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    linked = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if same(a, b)}
    for side in (zero, zero + (np.arange(len(sets)) % 2)):
        found = {tuple(sorted(p)) for a, b in simhash.marked_pairs([simhash.marks_of(x) for x in sets], n, np.arange(len(sets)), side, 0.8, step=64) for p in zip(a.tolist(), b.tolist())}
        want = {(a, b) for a, b in linked if not side.any() or side[a] != side[b]}
        assert want <= found and len(found) <= len(want) + 12
