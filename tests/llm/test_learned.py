import math
import random
import zlib

import numpy as np
import pytest

from concord.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_ordinal_grades(spark):
    r = random.Random(2)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    rows = []
    for i in range(900):
        g = r.randrange(4)
        rows.append((i, " ".join(r.choice(good if r.random() < g / 3 else bad) for _ in range(60)), g))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, grade string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i % 3] + [(5, None), (None, 2), (77777, 1)], "doc_id long, quality int")
    model, grades = quality.fit(docs, ratings)
    assert grades == [0, 1, 2, 3] and list(model.thresholds) == sorted(model.thresholds)
    got = {x.doc_id: x for x in quality.score(docs, model, grades, cut=2).collect()}
    held = [(got[i].expected_grade, g) for i, _, g in rows if i % 3 == 0]
    means = [np.mean([e for e, g in held if g == k]) for k in range(4)]
    assert means == sorted(means) and np.corrcoef(*zip(*held))[0, 1] > 0.85
    assert np.mean([(got[i].tail_probability >= 0.5) == (g >= 2) for i, _, g in rows if i % 3 == 0]) > 0.85


def test_quality_without_ratings(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model, grades = quality.fit(docs, none)
    assert [(r.expected_grade, r.tail_probability, r.selected) for r in quality.score(docs, model, grades).collect()] == [(None, 1.0, True)] * 3
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model, grades = quality.fit(docs, one)
    assert {r.expected_grade for r in quality.score(docs, model, grades).collect()} == {1.0}
    assert quality.score(docs.limit(0), model, grades).collect() == []


def test_gradient_is_right():
    r = np.random.default_rng(0)
    rows = [(np.array([i % 5, 5 + i % 3]), np.array([1.0, 0.5])) for i in range(60)]
    grades = np.array([min(2, (i % 5) // 2) for i in range(60)])
    model = quality.Ordinal.fit(rows, grades, 3, 4, steps=400)
    score = np.array([model.weights[i] @ v for i, v in rows])
    predicted = (model.tails(score) > 0.5).sum(1)
    assert (predicted == grades).mean() == 1.0 and r is not None


def brute_nearest(index, groups, query, k):
    def vector(terms, counts):
        w = {t: (1 + math.log(c)) * index.idf[t] for t, c in zip(terms, counts)}
        n = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / n for t, x in w.items()}

    q = vector(*query)
    scored = []
    for g, (terms, counts) in enumerate(groups):
        v = vector(terms, counts)
        cosine = sum(q[t] * v[t] for t in q if t in v)
        if cosine > 0:
            scored.append((-round(cosine, 12), g))
    return sorted(scored)[:k]


@pytest.mark.parametrize("dense", [0.01, 0.125, 2.0])
def test_nearest_is_exact(dense):
    r = random.Random(4)
    examples = []
    for n in range(900):
        terms = sorted(r.sample(range(40), r.randint(0, 5)))
        examples.append((n, terms, [r.randint(1, 4) for _ in terms], r.randint(0, 1)))
    index = toxicity.Index(np.linspace(0.2, 3, 40), examples, k=7, dense=dense)
    groups = sorted(index.groups)
    for _ in range(150):
        terms = sorted(r.sample(range(40), r.randint(1, 6)))
        query = (terms, [r.randint(1, 5) for _ in terms])
        ids, cosines = index.nearest(*query)
        want = brute_nearest(index, groups, query, 7)
        assert [round(c, 9) for c in cosines] == [round(-c, 9) for c, _ in want]
        assert list(ids) == [g for _, g in want]
        less, _ = index.nearest(*query, without=int(ids[0]))
        assert list(less) == [g for _, g in brute_nearest(index, groups, query, 8) if g != ids[0]][:7]


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert list(x) == sorted(x) and list(y) == sorted(y) and 0 < y[0] < y[-1] < 1


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.op9_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for t, p, _ in held if not t) <= 1
    assert sum(p for t, p, _ in held if t) >= 0.7 * sum(t for t, _, _ in held)
    assert np.mean([s for t, _, s in held if t]) > 0.5 > np.mean([s for t, _, s in held if not t])


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b"), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, none, ~toxicity.held_out()).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.0}
    assert toxicity.score(docs.limit(0), none, ~toxicity.held_out()).collect() == []


def test_toxicity_of_a_query_against_brute_force(spark):
    r = random.Random(12)
    pool = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 30))) + (" rotten filth" if i % 4 == 0 else "") for i in range(200)]
    texts[3], texts[5], texts[7] = None, "", "WORD " * 100_000
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "rotten filth", 2, "y"), (8, texts[8], 1, "x")], "doc_id long, text string, score int, evidence string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)] + [(1000, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, ~toxicity.held_out()).collect()
    assert len(got) == 202
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    every = [t or "" for t in [*texts, "rotten filth", texts[8]]]
    counts = [toxicity.word_counts(t) for t in every]
    words = sorted({w for i in learned for w in counts[i]})
    number = {w: i for i, w in enumerate(words)}
    examples = [(i, *toxicity.vector(every[i], number), int(i % 4 == 0)) for i in learned]
    idf = np.array([math.log((1 + 202) / (1 + sum(w in c for c in counts))) + 0.1 for w in words])
    index = toxicity.Index(idf * (1 + toxicity.association(examples, len(words))), examples)
    groups, by_id = sorted(index.groups), {x.doc_id: x for x in got}
    for i in [0, 1, 5, 7, 8, 40, 41]:
        query = toxicity.vector(every[i], number)
        near = brute_nearest(index, groups, query, 16) if len(query[0]) else []
        if near:
            w = [1 / (0.05 + max(0, 1 + c)) for c, _ in near]
            value = (sum(x * index.positive[g] for x, (_, g) in zip(w, near)) + index.base) / (sum(x * index.total[g] for x, (_, g) in zip(w, near)) + 1)
            value = float(np.interp(value, *index.curve))
        else:
            value = index.silent
        assert abs(by_id[i].score - value) < 1e-9, i
    assert by_id[None].score > 0.7 and by_id[3].score == by_id[5].score


def test_very_long_text_has_bounded_features():
    index, value = quality.Features(12).summed(" ".join(f"w{i}" for i in range(60_000)))
    assert len(index) <= 1 << 12 and len(set(index.tolist())) == len(index) == len(value)


def test_quality_query_against_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, grades = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = quality.op1_quality(spark, SF).collect()
    assert len(got) == docs.count()
    for r in got[::7]:
        x = {}
        for i, v in zip(*quality.Features(quality.BITS).of(texts[r.doc_id])):
            x[int(i)] = x.get(int(i), 0.0) + float(v)
        score = sum(v * float(model.weights[i]) for i, v in x.items())
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(r.tail_probability - tails[0]) < 1e-4
        assert abs(r.expected_grade - (grades[0] + sum(p * (b - a) for p, a, b in zip(tails, grades, grades[1:])))) < 1e-4
        assert r.selected == (r.tail_probability >= 0.5)
