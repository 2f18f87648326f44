import hashlib

from concord.llm import warc


def test_round_trip(spark, tmp_path):
    big = "x" * 1500 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/ b", big, 0), (2, None, big, 0), (3, "http://c", "small", 0), (4, "http://d", "small", 0), (5, "http://e", None, 0), (5, "http://e", None, 0), (None, "http://n", big, 0), (7, "http://a", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type int")
    path = str(tmp_path / "w")
    warc.write(pages, path)
    found = warc.read(spark, path).collect()
    assert len(found) == 24 and len({r.record_id for r in found}) == 24
    assert sorted(r.payload_bytes for r in found if r.type == "response") == sorted([0, 0, 5, 5, len(big.encode())])
    assert {bytes(r.payload).decode() for r in found if r.type == "response"} == {"", "small", big}
    captured = warc.assemble(warc.read(spark, path)).collect()
    assert len(captured) == 8 and all(c.request and len(c.metadata) == 1 and not c.others for c in captured)


def test_query_against_rule(spark, tmp_path):
    big = "y" * 1000
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"page {i % 4}" if i % 3 == 1 else big + str(i // 6)) for i in range(60)] + [(99, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(last.get(t or "", i), i)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        old = len(data) >= 1000 and last[t or ""] != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if old else "response", last[t or ""] if old else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op8_warc(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_concurrent_either_way_and_orphans(spark, tmp_path):
    def record(kind, name, *to):
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"WARC-Concurrent-To: <{t}>" for t in to], "Content-Type: text/plain", "Content-Length: 2"]
        return "\r\n".join(lines) + "\r\n\r\nhi\r\n\r\n"

    data = record("warcinfo", "info") + record("response", "r1", "q1") + record("request", "q1") + record("metadata", "m1", "r1") + record("metadata", "lost", "nowhere") + record("request", "q2")
    (tmp_path / "a.warc.gz").write_bytes(__import__("gzip").compress(data.encode()))
    got = {c.capture_id: c for c in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r1>", "<info>", "<nowhere>", "<q2>"}
    assert got["<r1>"].request.record_id == "<q1>" and [m.record_id for m in got["<r1>"].metadata] == ["<m1>"]
    assert got["<nowhere>"].response is None and got["<q2>"].request.record_id == "<q2>" and got["<info>"].others[0].type == "warcinfo"


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op8_warc(spark, str(tmp_path)).collect() == []
