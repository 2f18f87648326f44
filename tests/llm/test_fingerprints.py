import hashlib
import random

from concord.llm import fingerprints as fp


def pieces(text):
    """By steps: the first sentence end at which a piece is long enough, or as much of the line as a piece can hold."""
    found = set()
    for line in (text or "").split("\n"):
        while line:
            ends = [i for i in range(fp.LEAST + 1, fp.MOST + 1) if line[i - 1 : i] in (".", "!", "?") and line[i : i + 1] == " "]
            end = ends[0] if ends else fp.MOST
            found.add(line[:end])
            line = line[end:]
    return found


TEXTS = {1: "first line\nsecond line that goes on\nthird", 2: None, 5: "short", 7: "first line\nsecond line that goes on\nthird", 9: "é\n" * 300 + "x" * 5000, 12: "\n".join(f"line number {i}" for i in range(40)), 13: "\n".join(f"line number {i}" for i in range(41))}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, k1 string, bucket long, which string")


def test_against_brute_force(spark):
    docs = frame(spark, [(k, v, "x", 1, "y") for k, v in TEXTS.items()])
    got = {r.doc_id: r for r in fp.compare(docs).collect()}
    order = sorted(TEXTS)
    assert set(got) == set(order)
    for i, k in enumerate(order):
        text, nxt = TEXTS[k] or "", TEXTS[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert got[k].n_chars == len(text)
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = pieces(text), pieces(other)
            assert 0 <= got[k][name] <= 1
            assert abs(got[k][name] - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9, (k, name)
    assert got[1].fingerprint == got[7].fingerprint != got[5].fingerprint
    assert got[12].near_next > 0.5


def test_ties_one_row_and_none(spark):
    assert fp.compare(frame(spark, [])).collect() == []
    alone = fp.compare(frame(spark, [(3, "a\nb", "x", 1, "y")])).collect()
    assert alone[0].near_next == 1 and alone[0].edited_sha256 == hashlib.sha256(b"a\na").hexdigest()
    rows = fp.compare(frame(spark, [(1, "one text", "x", 1, "y")] * 3 + [(1, "another", "x", 1, "y"), (None, None, "x", 1, "y"), (None, "z", "x", 1, "y")])).collect()
    assert len(rows) == 6 and sum(r.near_next == 1 for r in rows if r.doc_id == 1 and r.n_chars == 8) >= 2


def test_diff_recovers_every_digest(spark):
    a = "\n".join(f"paragraph {i}" for i in range(400))
    b = "\n".join(f"paragraph {i}" for i in range(400) if i % 7) + "\nnew one\nnew two"
    rows = [(1, a, b), (2, a, a), (3, "x", "x\ny"), (4, "", "q")]
    versions = spark.createDataFrame(rows, "id long, old string, new string")
    got = {r.id: r for r in fp.diff(versions, "id", "old", "new").collect()}
    assert set(got) == {1, 3, 4}  # equal versions differ in nothing
    digest = lambda texts: sorted(r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) AS d").collect())
    assert sorted(got[1].only_right) == digest(["new one", "new two"])
    assert sorted(got[1].only_left) == digest([f"paragraph {i}" for i in range(0, 400, 7)])
    assert sorted(got[3].only_right) == digest(["y"]) and got[3].only_left == []


def test_larger_tables_are_tried(spark):
    text = "\n".join(f"line {i}" for i in range(200))
    versions = spark.createDataFrame([(1, text, "")], "id long, old string, new string")
    got = fp.diff(versions, "id", "old", "new", start=0.2).first()
    assert len(got.only_left) == 200


def test_likeness_of_long_texts_is_exact(spark):
    base = [f"paragraph {i}" for i in range(1500)]
    texts = ["\n".join(base), "\n".join([*base[:700], "changed", *base[701:]]), "\n".join(f"other {i}" for i in range(900)), "\n".join(base[:400])]
    got = {r.doc_id: r for r in fp.compare(frame(spark, [(i, t, "x", 1, "y") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        for name, other in (("near_edited", text[: len(text) - half] + nxt[:half]), ("near_next", nxt)):
            a, b = pieces(text), pieces(other)
            assert abs(got[i][name] - len(a & b) / len(a | b)) < 1e-9, (i, name)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(1, 30))) + rng.choice(".!?,")
    pool = [sentence() for _ in range(60)]
    texts = [rng.choice(["\n", " "]).join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    got = {r.doc_id: r for r in fp.compare(frame(spark, [(i, t, "x", 1, "y") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        for name, other in (("near_edited", text[: len(text) - half] + nxt[:half]), ("near_next", nxt)):
            a, b = pieces(text), pieces(other)
            assert abs(got[i][name] - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9, (i, name)


def test_fingerprints_themselves_subtract_and_peel(spark):
    lines = [f"paragraph {i}" for i in range(900)]
    rows = [("\n".join(lines), "\n".join([*lines[:450], "x", *lines[451:]])), ("a", "a"), ("\n".join(lines), "")]
    both = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b")
    from pyspark.sql import functions as F

    cells = both.select(fp.elements(F.col("a")).alias("a"), fp.elements(F.col("b")).alias("b")).selectExpr(f"{fp.sketched('a')} AS a", f"{fp.sketched('b')} AS b")
    assert [r.n for r in cells.selectExpr(f"{fp.peeled(fp.subtracted('a', 'b'))} AS n").collect()] == [2, 0, None]


def test_equal_ids_are_spread_and_long_texts_are_whole(spark):
    rows = [(1, f"text {i}", "x", 1, "y") for i in range(40)] + [(2, ("word " * 30 + ". ") * 3000 + str(i), "x", 1, "y") for i in range(2)]
    got = fp.compare(frame(spark, rows)).collect()
    assert len(got) == 42 and len({r.fingerprint for r in got}) == 42
    assert sum(r.n_chars > 400_000 for r in got) == 2
