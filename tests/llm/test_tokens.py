import random
import zlib

import numpy as np
import pytest

from concord.llm import packing, token_counts
from concord.llm.common import tokenizer_file

ODD = [None, "", " ", "a", "  lead and trail  ", "x\n\ny", "tab\there", "nbsp\xa0here", "\x1cunit\x1fsep", "it's we'LL", "<|endoftext|> mid <|endoftext|>\n\n<|endoftext|>", "日本語 テスト", "é Å", "　wide", "!!!???", "Word,word. word", "\U0001f600" * 5]


def texts():
    r = random.Random(5)
    made = ["".join(r.choice(["a", "B", " ", "\n", "é", "'s", "7", "<|endoftext|>", " ", "!", "the "]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    return ODD + made + ["word " * 300_000]


def tokens(name):
    return token_counts.load_tokenizer(tokenizer_file(name))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(0, "again", "x", 2), (None, "no id", "x", 3), (0, "again", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids long")


def test_counts_are_the_librarys(docs):
    tok = tokens("byte_bpe_50k.json")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)


def test_counts_with_other_tokenizers(docs):
    few = docs.filter("doc_id < 20")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        own = token_counts.Counter(tokenizer_file(name))
        got = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.count_tokens(few, name).collect()}
        assert got == {(r.doc_id, len((r.text or "").encode())): own.whole([r.text or ""])[0] for r in few.collect()}


def test_segments_cut_at_safe_places():
    text = "ab  cd e\nfg " * 5000
    parts = list(token_counts.segments(text, 1000))
    assert "".join(parts) == text and len(parts) > 10
    tok = tokens("byte_bpe_50k.json")
    assert sum(len(tok.encode(p).ids) for p in parts) == len(tok.encode(text).ids)


def test_empty_table(docs):
    assert token_counts.count_tokens(docs.limit(0)).collect() == []
    assert packing.pack(docs.limit(0)).collect() == []


def test_packing_keeps_every_id_once(docs):
    tok = tokens("word_bpe_49k.json")
    rows = packing.digests(packing.pack(docs, capacity=256, block_rows=100)).collect()
    whole = sorted([len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 256
    assert sum(r.length for r in rows) == sum(whole)
    assert len(by_sequence) * 256 - sum(whole) < 256 * 4  # less than one sequence a block
    pieces = {}
    for r in docs.filter("doc_id > 0").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces[r.doc_id] = ids
    found = {}
    for r in rows:
        if r.doc_id:
            assert r.ids_crc32 == zlib.crc32(pieces[r.doc_id][r.start : r.start + r.length].tobytes())
            assert r.doc_tokens == len(pieces[r.doc_id])
            found.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, spans in found.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(pieces[d])


def test_packing_balances_cost():
    lengths = np.array(sorted([900, 700, 600, 500, 400, 300, 200, 100] * 20, reverse=True))
    pieces = packing.pack_block(lengths, 1024, 1.0, 1 / 1024)
    cost, used = {}, {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n + n * n / 1024
        used[s] = used.get(s, 0) + n
    assert len(used) == -(-lengths.sum() // 1024) and max(used.values()) <= 1024
    assert packing.pack_block(lengths, 1024, 1.0, 1 / 1024) == pieces
    assert packing.pack_block(np.array([1]), 8, 1.0, 0.0) == [(0, 0, 1, 0, 0)]


def test_repeated_and_long_rows_are_spread(spark):
    rows = [(1, "same words in each row")] * 300 + [(2, "long " * 40_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64, block_rows=50).collect()
    blocks = {}
    for r in got:
        blocks[r.sequence_id >> 31] = blocks.get(r.sequence_id >> 31, 0) + 1
    assert len(blocks) > 5 and max(blocks.values()) < len(got) / 4
    assert sum(r.length for r in got if r.doc_id == 2) == next(r.doc_tokens for r in got if r.doc_id == 2)
    assert sum(r.start == 0 for r in got) == 301


def test_an_emptied_cache_makes_only_new_pieces():
    made = []
    cache = token_counts.PieceCache(lambda pieces: [made.append(p) or len(p) for p in pieces], room=3)
    assert cache.all(["a", "bb", "a"]) == [1, 2, 1]
    assert cache.all(["bb", "ccc", "a", "dddd", "ccc"]) == [2, 3, 1, 4, 3] and sorted(made) == ["a", "bb", "ccc", "dddd"]
    assert cache.all(["e" * 60, "ccc"]) == [60, 3] and cache.all(["e" * 60]) == [60] and made.count("e" * 60) == 2


def test_known_letters_before_new_punctuation_are_not_encoded_again():
    path = tokenizer_file("word_bpe_49k.json")
    own, plain = packing.Encoder(path), tokens("word_bpe_49k.json")
    seen, joined = [], own.joined
    own.joined = lambda cores: seen.append(sorted(cores)) or joined(cores)
    texts = ["Straße quorl", "quorl, Straße!? zanfet,", "x² ' don't, 中文, a_b quorl...", "", "zanfet quorl,"]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.type).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert seen[0] == ["Straße", "quorl"] and seen[1] == ["zanfet"] and not any("quorl" in cores for cores in seen[1:])
