"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

Attention over a piece of n tokens costs about linear * n + quadratic * n * n, and pieces in one sequence do not attend
to each other. A document longer than a sequence is first cut into whole sequences and a rest. These pieces are dealt by
hash to blocks of about `block_rows`, repeated rows each by their own hash, so a block's size has a bound. In a block,
whole sequences are done; the rests and the shorter documents go, longest first, each to the lowest-cost sequence with
room for it. As many sequences as the block's tokens need are opened at once, so a piece may find room in
none: then the one with most room takes the beginning and what is left is placed again. A block's padding is therefore
less than one sequence.

Nulls are empty texts and give the end token alone; repeated rows are packed each; an empty table gives no row; extra
columns are ignored. Ties are broken by id and content, so reruns agree.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import byte_batches, held, row_key, table, tokenizer_file
from concord.llm.token_counts import LETTERS, PieceCache, load_tokenizer, segments, words

#: Runs of punctuation whose ids a worker keeps.
TAILS = 10_000


class Encoder:
    """Token ids, as little-endian bytes, for tokenizers that drop white space and encode words apart; others encode whole texts."""

    def __init__(self, path: str, room: int = 1_000_000):
        import json

        tok = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.type = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.bytes = lambda texts: [np.array(e.ids, self.type).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        pre = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = bool(pre) and pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        vocabulary = tok.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

        def joined(cores: list[str]) -> list[bytes] | None:
            ids = np.array(tok.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(cores):
                return None
            data, ends = ids.astype(self.type).tobytes(), (ends * self.type.itemsize).tolist()
            return [data[a:b] for a, b in zip([0, *ends], ends)]

        self.joined, self.tails = joined, {}
        self.cache = PieceCache(self.made, room)

    def made(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces. Letters and the punctuation after them are separate pre-tokens, so either may be known."""
        known, parted, cores, others = self.cache.held, {}, {}, []
        for p in pieces:
            if p.isalpha():
                cores[p] = None
            elif not (m := LETTERS.fullmatch(p)):
                others.append(p)
            elif m[2]:
                parted[p] = core, tail = m.groups()
                if core not in cores:
                    cores[core] = known.get(core)
                if tail not in self.tails:
                    others.append(tail)
            else:
                cores[p] = None
        new = [c for c, ids in cores.items() if ids is None]
        got = self.joined(new) if new else []
        if got is None:
            return self.bytes(pieces)
        cores.update(zip(new, got))
        made = dict(zip(others, self.bytes(others))) if others else {}
        if len(self.tails) > TAILS:
            made |= self.tails
            self.tails = {}
        tails = made | {t: self.tails[t] for _, t in parted.values() if t in self.tails}
        self.tails |= {t: tails[t] for _, t in parted.values()}
        return [cores[p] if p in cores else cores[parted[p][0]] + tails[parted[p][1]] if p in parted else made[p] for p in pieces]

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.bytes([text])[0]
        return b"".join(b"".join(self.cache.all(words(part))) for part in segments(text))


def encoder(path: str, room: int) -> Encoder:
    return held("packing", (path, room), lambda: Encoder(path, room))


def pack_block(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents in descending order of length."""
    out, sequence, rest = [], 0, []
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    many = -(-sum(x[0] for x in rest) // capacity)
    used, cost = np.zeros(many, np.int64), np.zeros(many)
    heap = [(-n, k, d, start) for k, (n, d, start) in enumerate(rest)]
    heapq.heapify(heap)
    while heap:
        n, k, d, start = heapq.heappop(heap)
        room = used + -n <= capacity
        at = int(np.argmin(np.where(room, cost, np.inf))) if room.any() else int(np.argmin(used))
        take = min(-n, capacity - int(used[at]))
        out.append((d, start, take, sequence + at, int(used[at])))
        used[at] += take
        cost[at] += linear * take + quadratic * take * take
        if take < -n:
            heapq.heappush(heap, (n + take, k, d, start + take))
    return out


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 1024, block_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", room: int = 1_000_000) -> DataFrame:
    """One row per piece: the id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    room: distinct words whose ids a worker keeps, about 280 bytes each.
    """
    path = tokenizer_file(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    many, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-many // block_rows))
    # Whole sequences have blocks of their own, as many as their texts' bytes call for.
    more = 1 + (size or 0) // (4 * capacity * block_rows)
    rows = rows.withColumn("key", row_key("id", "text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, room)
        end = np.array([end_id], own.type).tobytes()
        seen: Counter = Counter()
        for batch in byte_batches(batches, "text"):
            out: list[tuple] = []
            for i, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist())):
                ids, copy = own.encode(text) + end, seen[key]
                seen[key] += 1
                total, step = len(ids) // own.type.itemsize, capacity * own.type.itemsize
                for n, at in enumerate(range(0, len(ids), step)):
                    spread = xxhash.xxh64_intdigest(f"{key}:{copy}:{n}")
                    out.append((i, spread % blocks if len(ids) - at < step else blocks + spread % more, n * capacity, total, ids[at : at + step]))
            place, block, start, total, ids = zip(*out)
            size = pa.array([own.type.itemsize] * len(out), pa.int32())
            yield pa.record_batch({"id": batch.column("id").take(pa.array(place)), "block": pa.array(block, pa.int64()), "start": pa.array(start, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "width": size, "ids": pa.array(ids, pa.binary())})

    def place(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches)
        if not block.num_rows:
            return
        names, ids, width = block.column("id").to_pylist(), block.column("ids").to_pylist(), block.column("width")[0].as_py()
        starts, totals = block.column("start").to_pylist(), block.column("doc_tokens").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), names[i] is None, names[i] if names[i] is not None else 0, starts[i], ids[i]))
        lengths = np.array([len(ids[i]) // width for i in order], np.int64)
        base = key[0].as_py() << 31
        pieces = pack_block(lengths, capacity, linear, quadratic)
        for i in range(0, len(pieces), 2000):
            part = pieces[i : i + 2000]
            yield pa.record_batch(
                {
                    "id": pa.array([names[order[d]] for d, *_ in part], block.schema.field("id").type),
                    "start": pa.array([starts[order[p[0]]] + p[1] for p in part], pa.int64()),
                    "length": pa.array([p[2] for p in part], pa.int64()),
                    "ids": pa.array([np.frombuffer(ids[order[d]], f"<u{width}", n, start * width).astype("<u4").tobytes() for d, start, n, _, _ in part], pa.binary()),
                    "doc_tokens": pa.array([totals[order[d]] for d, *_ in part], pa.int64()),
                    "sequence_id": pa.array([base + p[3] for p in part], pa.int64()),
                    "offset": pa.array([p[4] for p in part], pa.int64()),
                }
            )

    encoded = rows.mapInArrow(encode, f"id {kind}, block long, start long, doc_tokens long, width int, ids binary")
    placed = encoded.groupBy("block").applyInArrow(place, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
