"""Phrase collocations against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from concord.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, covered=50, top=2000):
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    many = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, part) for (lang, p), a in many.items() if len(p) == 3 for part in (p[:2], p[1:]) if 100 * a >= covered * count[lang, part]}
    out = []
    for lang in n:
        found = []
        for (other, p), a in many.items():
            if other == lang and (lang, p) not in gone:
                score, _, left, right = min((10**6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, rows, partitions=5, **options):
    df = spark.createDataFrame([(t, x, "clash") for t, x in rows], "text string, lang string, phrase string").repartition(partitions)
    return sorted(map(tuple, C.collocations(df, **options).collect()))


def sentences(seed=0, many=60):
    rng, words = np.random.default_rng(seed), ["Alpha", "beta", "gamma", "dé", "été", "x\x1cy", " ", "q"]
    texts = ["".join(words[i] + [" ", "  ", "\t", ". ", "\n", ","][j] for i, j in zip(rng.choice(len(words), 60, p=[0.3, 0.25, 0.2, 0.1, 0.05, 0.04, 0.03, 0.03]), rng.choice(6, 60, p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05]))) for _ in range(many)]
    return [(t, [None, "en", "fr", "und"][i % 4]) for i, t in enumerate(texts)]


def test_against_brute_force_with_repeats_and_ties(spark):
    rows = sentences() + sentences(many=9) + [(None, "en"), ("", "en"), ("...", None), ("one", "de")]
    assert mined(spark, rows) == brute(rows)


def test_limits_and_runs_of_few_slots(spark):
    rows = sentences(1)
    assert mined(spark, rows, least=3, covered=80, top=7, slots=50, shard=16) == brute(rows, 3, 80, 7)


def test_phrases_that_a_shared_bucket_hides_are_named_by_all_tasks(spark):
    # Few buckets: two phrases share one, and the task that names its phrases need not have both.
    rng = np.random.default_rng(2)
    rows = [(" ".join(f"w{x}" for x in rng.zipf(1.2, 400) % 3000), "en") for _ in range(40)]
    assert mined(spark, rows, partitions=12, least=4, bits=20) == brute(rows, 4)
    assert mined(spark, rows, partitions=12, least=4, bits=12) == brute(rows, 4)


def test_windows_of_a_long_text_lose_no_phrase(spark, monkeypatch):
    words = [w.encode() for w in " ".join(t for t, _ in sentences(3)).split()]
    text = b" ".join(words)
    monkeypatch.setattr(C, "WINDOW", 7)
    found = Counter()
    for part, own in C.windows(text):
        phrases = C.Phrases(part, own, "en")
        for k in (1, 2, 3):
            found.update(phrases.text(i, k) for i in phrases.at[k].tolist())
    monkeypatch.setattr(C, "WINDOW", 1 << 20)
    (part, own), = C.windows(text)
    whole = C.Phrases(part, own, "en")
    assert found == Counter(whole.text(i, k) for k in (1, 2, 3) for i in whole.at[k].tolist())


def test_perfect_hash_is_minimal_and_verifies_keys():
    rng = np.random.default_rng(4)
    key1, key2 = rng.integers(0, 2**64, (2, 5000), np.uint64)
    key1[:2] = 7  # two keys that differ in their second half only
    words, sizes, order = C.perfect_hash(key1, key2)
    index = C.Index(0, 0, [(0, words.tobytes(), sizes, key1[order].tobytes(), key2[order].tobytes())]).ready()
    places, slots = index.slots(key1, lambda at: key2[at])
    assert sorted(places) == sorted(slots) == list(range(5000))
    assert (index.key1[slots] == key1[places]).all()
    assert not len(index.slots(key1, lambda at: key2[at] + np.uint64(1))[0])
    with pytest.raises(RuntimeError):
        C.perfect_hash(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def test_empty_and_without_frequent_phrases(spark):
    assert mined(spark, [], 1) == [] and mined(spark, [("a b c", "en")]) == []


def test_texts_are_read_twice_for_more_candidates_than_a_shard(spark, monkeypatch):
    # Counting had a pass over the texts for each run of candidates, and naming another.
    made = []
    monkeypatch.setattr(C, "candidate_rows", lambda *a, keep=C.candidate_rows, **k: made.append(k["words"]) or keep(*a, **k))
    rows = sentences(1)
    assert mined(spark, rows, least=3, shard=4) == brute(rows, 3)
    assert made == [True]


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(6)
    keys = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 500, 0, 9000)]
    found = C.Filters([(3, C.filter_of(keys[0]).tobytes()), (4, C.filter_of(keys[1]).tobytes()), (6, C.filter_of(keys[3]).tobytes())])
    for block, own in zip((3, 4, 5, 6), keys):
        assert len(found.places(np.full(len(own), block), own)) == len(own)
        assert len(found.places(np.full(10000, block), rng.integers(0, 2**63, 10000, dtype=np.uint64))) < 300
    assert not len(found.places(np.array([2, 5, 7]), np.array([1, 2, 3], np.uint64)))


def test_equal_first_keys_are_summed_apart():
    one, two, n = C.summed(np.array([5, 5, 1, 5], np.uint64), np.array([2, 1, 9, 2], np.uint64))
    assert (one.tolist(), two.tolist(), n.tolist()) == ([1, 5, 5], [9, 1, 2], [1, 1, 2])
    assert C.summed(one, two, np.array([4, 5, 6]))[2].tolist() == [4, 5, 6]
