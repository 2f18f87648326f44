import random

import corpus_pipeline as cp
from concord.llm import registry


def test_stages_on_planted_documents(spark, tmp_path):
    r = random.Random(6)
    words = [f"wo{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"]
    clean = [" ".join(r.choice(words) for _ in range(80)) for _ in range(60)]
    near = clean[0].split()
    near[40] = "changed"
    texts = clean + [clean[1], " ".join(near)] + ["such an idiot and moron " + " ".join(r.choice(words) for _ in range(40)) for _ in range(30)] + [" ".join("###" + r.choice(words).upper() + "!!" for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 92), int(62 <= i < 92)) for i in range(0, 122)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, now = {}, docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = [x.doc_id for x in now.select("doc_id").collect()]
    assert not set(kept["quality"]) & set(range(92, 122)) and set(range(62)) <= set(kept["quality"])
    assert not set(kept["toxicity"]) & set(range(62, 92)) and set(range(62)) <= set(kept["toxicity"])
    assert set(range(60)) <= set(kept["near_duplicates"]) and not {60, 61} & set(kept["near_duplicates"])
    assert len(kept["near_duplicates"]) == len(set(kept["near_duplicates"]))
    pieces = cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(kept["mixing"])


def test_repeated_rows_ids_and_null_ids(spark):
    same, other = "a b c d e f", "g h i j k l"
    rows = [(1, same, "x", None, None), (1, same, "a", None, None), (1, other, None, None, None), (None, same, None, None, None), (None, "m n o p q r", None, None, None), (2, other, None, None, None), (None, None, None, None, None), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((x.doc_id, x.text, x.lang) for x in cp.distinct_documents(spark, docs, "").collect()), key=repr)
    assert out == sorted([(1, same, "a"), (1, other, None), (None, "m n o p q r", None), (3, "", None)], key=repr)
    assert cp.distinct_documents(spark, docs.limit(0), "").collect() == []


def test_empty_tables_long_texts_and_other_columns(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, component long, digest string, _key int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
    long = " ".join(f"word{i % 7919}" for i in range(150_000))
    rows = [(i, t, None, None, None, 1, "x", 2) for i, t in enumerate([long, long + " end", None, "", "a b"])]
    other = tmp_path / "other"
    spark.createDataFrame(rows, docs.schema).write.parquet(str(other / "documents.parquet"))
    spark.createDataFrame([(None, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(other / "labels.parquet"))
    pieces = cp.run(spark, str(other)).collect()
    assert {p.doc_id for p in pieces} == {0, 2, 4} and sum(p.length for p in pieces if p.doc_id == 0) % [p.doc_tokens for p in pieces if p.doc_id == 0][0] == 0


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 14))


def test_stages_bound_what_workers_hold(spark, monkeypatch):
    name, asked = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    monkeypatch.setattr(cp.packing, "pack", lambda docs, **given: asked.update(given, rows=int(spark.conf.get(name))) or docs)
    monkeypatch.setattr(cp.packing, "digests", lambda packed: packed)
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        cp.STAGES[-1][1](spark, spark.range(1), "")
    finally:
        spark.conf.set(name, before)
    assert asked["room"] <= 300_000 and asked["rows"] <= 2000
