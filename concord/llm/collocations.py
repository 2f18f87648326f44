"""Phrase collocations: exact phrase counts by a minimal perfect hash over Apriori-safe candidates.

Two passes over the texts, in Arrow batches that are split into words once each:

1. Phrases of 2 to 3 words are counted by hash bucket, in sorted numpy arrays that are summed by blocks. A phrase that
   occurs `least` times lies in a bucket of at least that sum. Bloom filters keep these buckets, and for each the one task
   of those that have it which is to name its phrases.
2. Candidates are phrases in such buckets of which every shorter phrase inside lies in one too (so no phrase that is frequent
   is lost). Each task sums its candidates and all its words by key, and sends the sums to the key's shard. A shard's
   minimal perfect hash (bit arrays by level, slots by rank) of the named phrases and the words stores its keys in slot
   order; sums are looked up, the stored key is verified, and np.bincount adds them by slot. What is left over is summed
   by key: if a phrase of it occurs `least` times, no task has named it (it shares its bucket). Then all tasks do, and
   counting is repeated.

A shard asks the shards of its phrases' parts for their counts, each once, for each cut. A key is two 64-bit hashes of the
language and the words; that different candidates have different keys is verified when the hash is made. Buckets are
taken in runs of at most SLOTS, each run another pass over the texts, so that what is broadcast (three bytes a bucket) has
that bound for any input.

Null texts are empty, a null language is `und`; texts of any length are read in windows that lose no phrase. Ties are
broken by count, then by the phrase's bytes. Scores are integers without a bound on the way. Repeated rows count each;
an empty table, or one without frequent phrases, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import HELD as HELD_VALUES
from concord.llm.common import byte_batches, checkpoint, held, if_small, release, table

#: Buckets of a run; candidates of a shard; entries that a mapper holds before it writes; bytes split at once.
SLOTS, SHARD, HELD, WINDOW = 1 << 25, 1 << 15, 1 << 22, 4 << 20
#: Bits of the block number of a bucket, and of the table that is looked at first.
BLOCK_BITS, FIRST_BITS = 11, 24
#: Bits of a filter for each entry, and how many of them an entry sets.
FILTER_BITS, PROBES = 12, 3
#: Buckets are this power of two more than the texts' bytes, so that phrases hardly ever share one; bits of a task's number.
SPARE_BITS, PART_BITS = 19, 24
#: Slots salted before a language's best phrases meet.
SALTS = 64
LONGEST, LEVELS = 3, 64
P1, P2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
#: Lower case, tabs as spaces, and every mark that ends a piece as a full stop.
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 10)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def windows(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """(words, with b"." between pieces, and how many of them start phrases here); two more follow where a text is cut."""
    folded = text.translate(FOLDED).replace(b".", b" . ")
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + WINDOW)
        if end < 0:
            words = folded[at:].split()
            yield words, len(words)
            return
        words = folded[at:end].split()
        yield words + folded[end:].split(None, LONGEST - 1)[: LONGEST - 1], len(words)
        at = end


def kept(token: str, make):
    """make(), kept in this worker until another token is asked for."""
    if ("collocations", token) not in HELD_VALUES:
        release()
    return held("collocations", token, make)


class Phrases:
    """A window's words and the keys of its phrases of every length."""

    def __init__(self, words: list[bytes], own: int, lang: str):
        import xxhash

        self.words = list(dict.fromkeys(words))
        place = {w: i for i, w in enumerate(self.words)}
        self.ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        word = ~(self.ids == place.get(b".", -1))
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), "<u8").reshape(-1, 2)
        start = np.frombuffer(xxhash.xxh3_128_digest(lang.encode()), "<u8")
        self.start, self.second = start[1], np.ascontiguousarray(digests[:, 1])
        self.n = int(np.count_nonzero(word[:own]))
        self.at, self.key1 = {}, {}
        first = digests[self.ids, 0]
        at = np.flatnonzero(word[:own])
        key = np.broadcast_to(start[0], at.shape)
        for k in range(1, LONGEST + 1):
            if k > 1:
                keep = at + k - 1 < len(words)
                keep[keep] = word[at[keep] + k - 1]
                at, key = at[keep], key[keep]
            key = key * P1 + first[at + k - 1]
            self.at[k], self.key1[k] = at, stirred(key)

    def key2(self, k: int, places: np.ndarray) -> np.ndarray:
        """Second keys of the phrases of k words at these places of at[k]."""
        at, key = self.at[k][places], np.broadcast_to(self.start, places.shape)
        for i in range(k):
            key = key * P2 + self.second[self.ids[at + i]]
        return stirred(key)

    def text(self, at: int, k: int) -> str:
        return b" ".join(self.words[i] for i in self.ids[at : at + k]).decode()


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Phrases]]:
    """(language, phrases) of windows; short texts of one language are read together."""
    for batch in byte_batches(batches, "text", WINDOW):
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, found in texts.items():
            for words, own in windows("\n".join(found).encode()):
                if words:
                    yield lang, Phrases(words, own, lang)


def runs(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """(first, last) of consecutive places that hold `most` together at most, or are one place; sizes: (place, size)."""
    out, held_now = [], 0
    for place, size in sorted(sizes):
        if out and held_now + size <= most:
            out[-1], held_now = (out[-1][0], place), held_now + size
        else:
            out, held_now = [*out, (place, place)], size
    return out


def bucket_rows(bits: int):
    """mapInArrow function: part, block, gaps between the block's buckets, counts; a count over 255 is several entries."""
    low = bits - BLOCK_BITS

    def flushed(part: int, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        buckets, counts = np.unique(np.concatenate(found), return_counts=True)
        if counts.max() > 255:
            times = -(-counts // 255)
            last = np.cumsum(times) - 1
            buckets, rest = np.repeat(buckets, times), counts - 255 * (times - 1)
            counts = np.full(len(buckets), 255)
            counts[last] = rest
        counts = counts.astype(np.uint8)
        cuts = np.flatnonzero(np.diff(buckets >> np.uint64(low))) + 1
        starts, ends = np.append(0, cuts).tolist(), np.append(cuts, len(buckets)).tolist()
        gaps = np.diff(buckets, prepend=np.uint64(0))
        gaps[starts] = buckets[starts] & np.uint64((1 << low) - 1)
        gaps = gaps.astype("<u4" if gaps.max() < 1 << 32 else "<u8")
        yield pa.record_batch({"part": pa.array([part] * len(starts), pa.int32()), "block": (buckets[starts] >> np.uint64(low)).astype(np.int64), "gaps": pa.array([gaps[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        part, found, size = TaskContext.get().partitionId(), [], 0
        for _, phrases in read(batches):
            found += [phrases.key1[k] >> np.uint64(64 - bits) for k in range(2, LONGEST + 1)]
            size += len(found[-1]) + len(found[-2])
            if size >= HELD:
                yield from flushed(part, found)
                found, size = [], 0
        if size:
            yield from flushed(part, found)

    return count


def filter_places(key: np.ndarray, i: int, size) -> np.ndarray:
    low = np.uint64((1 << 32) - 1)
    return ((key >> np.uint64(32)) + np.uint64(i) * (key | np.uint64(1)) & low) * size >> np.uint64(32)


def filter_of(keys: np.ndarray) -> np.ndarray:
    """A Bloom filter's bytes; its size in bits is eight times theirs."""
    bits = np.zeros(-(-FILTER_BITS * len(keys) // 8) * 8, np.uint8)
    for i in range(PROBES):
        bits[filter_places(keys, i, np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


class Filters:
    """The Bloom filters of a run of blocks as one; blocks: (block, filter's bytes), ascending."""

    def __init__(self, blocks: list[tuple[int, bytes]]):
        self.first = blocks[0][0]
        self.size = np.zeros(blocks[-1][0] - self.first + 1, np.uint64)
        for block, found in blocks:
            self.size[block - self.first] = 8 * len(found)
        self.base = np.cumsum(self.size) - self.size
        self.bits = np.frombuffer(b"".join(found for _, found in blocks), np.uint8)

    def covers(self, block: np.ndarray) -> np.ndarray:
        return (block >= self.first) & (block < self.first + len(self.size))

    def places(self, block: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in their block's filter."""
        at = np.flatnonzero(self.covers(block))
        at = at[self.size[block[at] - self.first] > 0]
        for i in range(PROBES):
            own = block[at] - self.first
            bit = self.base[own] + filter_places(key[at], i, self.size[own])
            at = at[(self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        return at


def frequent_buckets(bits: int, least: int):
    """mapInArrow function: of a block, how many buckets have counts that sum to `least`, a filter of them, and one of
    bucket and task, with one task of those that have the bucket."""
    low, numbered = bits - BLOCK_BITS, np.uint64((1 << PART_BITS) - 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, block, gaps, counts in zip(*[batch.column(c).to_pylist() for c in ("part", "block", "gaps", "counts")]):
                blocks.setdefault(block, []).append((part, gaps, counts))
        for block in sorted(blocks):
            rows = blocks.pop(block)
            buckets = np.concatenate([np.cumsum(np.frombuffer(gaps, "<u4" if len(gaps) == 4 * len(counts) else "<u8"), dtype=np.uint64) for _, gaps, counts in rows]) + np.uint64(block << low)
            counts = np.concatenate([np.frombuffer(c, np.uint8) for _, _, c in rows])
            parts = np.repeat(np.array([p for p, _, _ in rows], np.uint64), [len(c) for _, _, c in rows])
            # Tasks in an order of the bucket's own, so that they name about as many each.
            turn = stirred(buckets * P1 + parts * P2) & ~numbered | parts & numbered
            order = np.argsort(buckets, kind="stable")
            buckets, counts, turn = buckets[order], counts[order].astype(np.int64), turn[order]
            starts = np.append(0, np.flatnonzero(np.diff(buckets)) + 1)
            keep = np.add.reduceat(counts, starts) >= least
            buckets, turn = buckets[starts][keep], np.minimum.reduceat(turn, starts)[keep]
            raw = lambda keys: pa.array([filter_of(keys).tobytes()], pa.binary())
            yield pa.record_batch({"block": pa.array([block]), "often": raw(stirred(buckets)), "namers": raw(named_by(buckets, turn & numbered)), "many": pa.array([len(buckets)])})

    return add


def named_by(buckets: np.ndarray, part) -> np.ndarray:
    """Keys of buckets with a task that is to name their phrases."""
    return stirred(buckets * P2 + part * P1)


def table_of(values: np.ndarray) -> np.ndarray:
    """True at the low bits of the values: rules most other numbers out at one look."""
    first = np.zeros(1 << FIRST_BITS, bool)
    first[low_bits(values)] = True
    return first


def low_bits(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64((1 << FIRST_BITS) - 1)).astype(np.int64)


class Members:
    """Sorted numbers that many others are looked up in."""

    def __init__(self, values: np.ndarray):
        self.values, self.first = values, table_of(values)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Where each x is, or -1."""
        out = np.full(len(x), -1, np.int64)
        at = np.flatnonzero(self.first[low_bits(x)])
        spot = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        out[at] = np.where(self.values[spot] == x[at], spot, -1)
        return out


#: Rows for shards: sums of phrases, sums of words, names, a language's number of words.
PHRASES, WORDS, NAMES, TOTAL = range(4)
SHARD_ROWS = "shard int, kind int, lang string, k1 binary, k2 binary, n binary, phrases binary, total long"


def shard_of(key1: np.ndarray, bits: int) -> np.ndarray:
    return (key1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key1), np.int64)


def summed(key1: np.ndarray, key2: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, ascending, and how often each is there, or the sum of its n."""
    order = np.argsort(key1)
    one, two = key1[order], key2[order]
    if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():
        order = np.lexsort((key2, key1))
        one, two = key1[order], key2[order]
    starts = np.flatnonzero(np.append(np.ones(min(1, len(one)), bool), (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    counts = np.diff(starts, append=len(one)) if n is None else np.add.reduceat(n[order], starts) if len(one) else n
    return one[starts], two[starts], counts


def shard_rows(kind: int, cut: int, key1: np.ndarray, key2: np.ndarray, n: np.ndarray | None = None, phrases: list[bytes] | None = None, lang: str | None = None) -> Iterator[pa.RecordBatch]:
    """Keys, ascending, with their sums or phrases, as one row a shard."""
    if not len(key1):
        return
    shard = shard_of(key1, cut)
    edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(key1)]
    pieces = list(zip(edges, edges[1:]))
    if n is not None:
        n = n.astype(next(t for t in ("<u1", "<u4", "<i8") if n.max() <= np.iinfo(t).max))
    raw = lambda x: pa.array([None if x is None else x[a:b].tobytes() for a, b in pieces], pa.binary())
    named = pa.array([None if phrases is None else b"\n".join(phrases[a:b]) for a, b in pieces], pa.binary())
    same = lambda x, t: pa.array([x] * len(pieces), t)
    yield pa.record_batch({"shard": pa.array(shard[edges[:-1]], pa.int32()), "kind": same(kind, pa.int32()), "lang": same(lang, pa.string()), "k1": raw(key1), "k2": raw(key2), "n": raw(n), "phrases": named, "total": same(None, pa.int64())})


def candidate_rows(bits: int, cut: int, sent, words: bool):
    """mapInArrow function: rows for shards of the candidates in a run of blocks: their sums in this task, and the names of
    those that it is to name; with `words`, also the sums of all words and each language's number of them.

    sent: the run's filters of buckets, and of buckets with the task that names their phrases.
    """
    low, token = np.uint64(bits - BLOCK_BITS), uuid4().hex

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        often, namers = kept(token, lambda: tuple(map(Filters, sent.value)))
        number, totals = np.uint64(part & ((1 << PART_BITS) - 1)), {}
        held: dict[int, list[tuple]] = {PHRASES: [], WORDS: []}
        names: dict[str, dict[int, tuple[int, bytes]]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for kind, found in held.items():
                if found:
                    whole = [np.concatenate(x) for x in zip(*found)]
                    found.clear()
                    yield from shard_rows(kind, cut, *summed(*whole))
            for lang, found in names.items():
                key1 = np.array(sorted(found), np.uint64)
                told = [found[k] for k in key1.tolist()]
                yield from shard_rows(NAMES, cut, key1, np.array([k for k, _ in told], np.uint64), phrases=[p for _, p in told], lang=lang)
            names.clear()

        for lang, phrases in read(batches):
            if words:
                totals[lang] = totals.get(lang, 0) + phrases.n
                # Equal words of a window are counted before their keys are made.
                often_here = np.bincount(phrases.ids[phrases.at[1]], minlength=len(phrases.words))
                at = np.flatnonzero(often_here)
                first = np.zeros(len(phrases.words), np.int64)
                first[phrases.ids[phrases.at[1]]] = np.arange(len(phrases.at[1]))
                held[WORDS].append((phrases.key1[1][first[at]], phrases.key2(1, first[at]), often_here[at]))
                size += len(at)
            rare = np.zeros(len(phrases.ids) + 1, bool)
            for k in range(2, LONGEST + 1):
                bucket = phrases.key1[k] >> np.uint64(64 - bits)
                block = (bucket >> low).astype(np.int64)
                chosen = often.places(block, stirred(bucket))
                if k == 2:
                    # Apriori: no part of a longer phrase lies in a rare bucket. Other runs' blocks are not known here.
                    rare[phrases.at[2]] = often.covers(block)
                    rare[phrases.at[2][chosen]] = False
                else:
                    chosen = chosen[~(rare[phrases.at[k][chosen]] | rare[phrases.at[k][chosen] + 1])]
                key1, key2 = phrases.key1[k][chosen], phrases.key2(k, chosen)
                held[PHRASES].append((key1, key2))
                size += len(key1)
                own = namers.places(block[chosen], named_by(bucket[chosen], number))
                known = names.setdefault(lang, {})
                found, at = np.unique(key1[own], return_index=True)
                for one, two, i in zip(found.tolist(), key2[own[at]].tolist(), phrases.at[k][chosen[own[at]]].tolist()):
                    if one not in known:
                        known[one] = (two, phrases.text(i, k).encode())
            if size >= HELD // 2:
                yield from flushed()
                size = 0
        yield from flushed()
        if totals:
            many = len(totals)
            none = pa.nulls(many, pa.binary())
            yield pa.record_batch({"shard": pa.array([0] * many, pa.int32()), "kind": pa.array([TOTAL] * many, pa.int32()), "lang": pa.array(list(totals), pa.string()), "k1": none, "k2": none, "n": none, "phrases": none, "total": pa.array(list(totals.values()), pa.int64())})

    return name


def naming_rows(cut: int, sent):
    """mapInArrow function: names of all phrases whose first keys are sent (sorted), with every second key that they have."""
    token = uuid4().hex

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = kept(token, lambda: Members(np.frombuffer(sent.value, np.uint64))), set()
        for lang, phrases in read(batches):
            for k in range(2, LONGEST + 1):
                chosen = np.flatnonzero(known.places(phrases.key1[k]) >= 0)
                for one, two, i in zip(phrases.key1[k][chosen].tolist(), phrases.key2(k, chosen).tolist(), phrases.at[k][chosen].tolist()):
                    if (one, two) not in told:
                        told.add((one, two))
                        yield from shard_rows(NAMES, cut, np.array([one], np.uint64), np.array([two], np.uint64), phrases=[phrases.text(i, k).encode()], lang=lang)

    return name


def level_hash(key1: np.ndarray, key2: np.ndarray, level: int) -> np.ndarray:
    return stirred(key1 ^ (key2 * np.uint64(2 * level + 1)) + np.uint64(level))


def perfect_hash(key1: np.ndarray, key2: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Words of the levels' bit arrays, the levels' sizes in bits, and the order of the keys by slot."""
    left, words, sizes, slots, below = np.arange(len(key1)), [], [], np.zeros(len(key1), np.int64), 0
    for level in range(LEVELS):
        if not len(left):
            return np.concatenate(words) if words else np.zeros(0, np.uint64), sizes, np.argsort(slots)
        size = -(-2 * len(left) // 64) * 64
        place = (level_hash(key1[left], key2[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        own = alone[place]
        slots[left[own]] = below + (np.cumsum(alone) - 1)[place[own]]
        below += int(own.sum())
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~own]
    raise RuntimeError("two different candidates have one key")


class Index:
    """The minimal perfect hashes of a run of shards as one: a key's slot, verified by the stored key."""

    def __init__(self, bits: int, first: int, shards: list[tuple[int, bytes, list[int], bytes, bytes]]):
        joined = lambda i: np.frombuffer(b"".join(s[i] for s in shards), np.uint64)
        self.bits, self.first = bits, first
        self.words, self.key1, self.key2 = joined(1), joined(3), joined(4)
        many = shards[-1][0] - first + 1
        self.size, self.base = np.ones((LEVELS, many), np.uint64), np.full((LEVELS, many), -1, np.int64)
        at = 0
        for shard, _, sizes, _, _ in shards:
            for level, size in enumerate(sizes):
                self.size[level, shard - first], self.base[level, shard - first] = size, at
                at += size

    def ready(self) -> Index:
        """With what lookups need besides; not sent."""
        self.rank = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))
        self.table = table_of(self.key1)
        return self

    def slots(self, key1: np.ndarray, key2) -> tuple[np.ndarray, np.ndarray]:
        """(places in key1, slots) of the keys that are stored; key2 gives the second keys of places."""
        left = np.flatnonzero(self.table[low_bits(key1)])
        shard = (key1[left] >> np.uint64(64 - self.bits)).astype(np.int64) - self.first if self.bits else np.zeros(len(left), np.int64)
        inside = (shard >= 0) & (shard < self.size.shape[1])
        left, shard = left[inside], shard[inside]
        one, two = key1[left], key2(left)
        places, found = [], []
        for level in range(LEVELS):
            base = self.base[level, shard]
            if (base < 0).any():
                left, shard, one, two, base = (x[base >= 0] for x in (left, shard, one, two, base))
            if not len(left):
                break
            bit = base + (level_hash(one, two, level) % self.size[level, shard]).astype(np.int64)
            word, rest = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> rest & np.uint64(1)) == 1
            slot = self.rank[bit[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << rest[hit]) - np.uint64(1)))
            true = (self.key1[slot] == one[hit]) & (self.key2[slot] == two[hit])
            places.append(left[hit][true])
            found.append(slot[true])
            left, shard, one, two = (x[~hit] for x in (left, shard, one, two))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *found])


COUNTED = "shard int, words binary, sizes array<long>, keys1 binary, keys2 binary, counts binary, langs array<string>, phrases array<string>, slots binary, missing binary, total_of array<string>, totals array<long>"


def counted_shard(cut: int, least: int):
    """applyInArrow function: a shard's minimal perfect hash with stored keys and their counts, its frequent phrases with
    their slots, first keys of frequent phrases that have no name, and languages' numbers of words."""

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {PHRASES: [], WORDS: []}
        named, total_of, totals = [], [], []
        for batch in batches:
            for kind, lang, one, two, n, phrases, total in zip(*[batch.column(c).to_pylist() for c in ("kind", "lang", "k1", "k2", "n", "phrases", "total")]):
                if kind == TOTAL:
                    total_of.append(lang)
                    totals.append(total)
                    continue
                one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                if kind == NAMES:
                    named += zip(one.tolist(), two.tolist(), [lang] * len(one), phrases.decode().split("\n"))
                else:
                    held[kind].append((one, two, np.frombuffer(n, {1: "<u1", 4: "<u4", 8: "<i8"}[len(n) // len(one)]).astype(np.int64)))
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = {kind: summed(*map(np.concatenate, zip(none, *found))) for kind, found in held.items()}
        # Different phrases of one key stay both, which the perfect hash reports.
        named = sorted(set(named))
        one, two, n = sums[WORDS]
        many = n >= least
        key1 = np.append(np.array([x[0] for x in named], np.uint64), one[many])
        key2 = np.append(np.array([x[1] for x in named], np.uint64), two[many])
        words, sizes, order = perfect_hash(key1, key2)
        shard = key[0].as_py()
        index = Index(cut, shard, [(shard, words.tobytes(), sizes, key1[order].tobytes(), key2[order].tobytes())]).ready()
        counts = np.zeros(len(key1), np.int64)
        for kind, (one, two, n) in sums.items():
            places, slots = index.slots(one, lambda at: two[at])  # noqa: B023
            counts += np.bincount(slots, n[places], len(counts)).astype(np.int64)
            if kind == PHRASES:
                nameless = n >= least
                nameless[places] = False
                missing = one[nameless]
        slot = np.empty(len(order), np.int64)
        slot[order] = np.arange(len(order))
        slot = slot[: len(named)]
        often = np.flatnonzero(counts[slot] >= least).tolist()
        raw = lambda x: pa.array([x.tobytes()], pa.binary())
        some = lambda x, t: pa.array([x], pa.list_(t))
        yield pa.record_batch({
            "shard": pa.array([shard], pa.int32()), "words": raw(words), "sizes": some(sizes, pa.int64()), "keys1": raw(key1[order]), "keys2": raw(key2[order]), "counts": raw(counts),
            "langs": some([named[i][2] for i in often], pa.string()), "phrases": some([named[i][3] for i in often], pa.string()), "slots": raw(slot[often]),
            "missing": raw(missing), "total_of": some(total_of, pa.string()), "totals": some(totals, pa.int64()),
        })

    return count


PARTS = {2: [(1, 0, 1), (1, 1, 2)], 3: [(1, 0, 1), (1, 1, 3), (2, 0, 2), (2, 2, 3)]}


def parts_of(langs: list[str], phrases: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Keys of the phrases' different parts, ascending, and for each l1, r1, l2, r2 the place of each phrase's part (or -1)."""
    split = [p.encode().split(b" ") for p in phrases]
    keys, rows, columns = [], [], []
    for lang in sorted(set(langs)):
        mine = [i for i, other in enumerate(langs) if other == lang]
        # Phrases one after another, a stop between them: a part's key is that of the phrase which starts there.
        words, starts = [], []
        for i in mine:
            starts.append(len(words))
            words += [*split[i], b"."]
        whole = Phrases(words, len(words), lang)
        mine, starts = np.array(mine), np.array(starts)
        size = np.array([len(split[i]) for i in mine])
        for k, cuts in PARTS.items():
            for column, (_, a, b) in enumerate(cuts):
                spot = np.searchsorted(whole.at[b - a], starts[size == k] + a)
                keys.append((whole.key1[b - a][spot], whole.key2(b - a, spot)))
                rows.append(mine[size == k])
                columns.append(np.full(len(spot), column))
    none = np.zeros(0, np.uint64)
    key1, key2 = map(np.concatenate, zip((none, none), *keys))
    order = np.lexsort((key2, key1))
    one, two = key1[order], key2[order]
    new = np.append(np.ones(min(1, len(one)), bool), (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    out = np.full((4, len(phrases)), -1)
    if len(place):
        out[np.concatenate(columns), np.concatenate(rows)] = place
    return one[new], two[new], dict(zip(("l1", "r1", "l2", "r2"), out))


def part_asks(cut: int):
    """mapInArrow function: what each shard asks of others: keys of its phrases' parts, ascending, each once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, langs, phrases in zip(*[batch.column(c).to_pylist() for c in ("shard", "langs", "phrases")]):
                key1, key2, _ = parts_of(langs, phrases)
                for rows in shard_rows(PHRASES, cut, key1, key2):
                    yield pa.record_batch({"shard": rows.column("shard"), "origin": pa.array([origin] * rows.num_rows, pa.int32()), "k1": rows.column("k1"), "k2": rows.column("k2")})

    return ask


def part_counts(cut: int):
    """cogroup function: a shard's answers: the counts of the keys that it is asked for."""

    def answer(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
        shard, out = key[0].as_py(), []
        held = [own.column(c).to_pylist() for c in ("words", "sizes", "keys1", "keys2", "counts")]
        index = Index(cut, shard, [(shard, *(x[0] for x in held[:4]))]).ready() if own.num_rows else None
        for one, two in zip(asked.column("k1").to_pylist(), asked.column("k2").to_pylist()):
            one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            found = np.zeros(len(one), np.int64)
            if index is not None:
                places, slots = index.slots(one, lambda at: two[at])  # noqa: B023
                found[places] = np.frombuffer(held[4][0], np.int64)[slots]
            out.append(found.tobytes())
        return pa.table({"origin": asked.column("origin").cast(pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "counts": pa.array(out, pa.binary())})

    return answer


def judged_cuts(least: int, covered: int):
    """cogroup function: a shard's frequent phrases, judged by their counts and those of their parts by cut, its answers."""

    def judge(key: tuple, answers: pa.Table, own: pa.Table) -> pa.Table:
        langs, phrases, slots, counts = (own.column(c).to_pylist()[0] if own.num_rows else [] for c in ("langs", "phrases", "slots", "counts"))
        # Answers in the order of their shards are in the order of the keys.
        told = sorted(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist()))
        told = np.append(np.frombuffer(b"".join(x for _, x in told), np.int64), 0)
        of = parts_of(langs, phrases)[2]
        a = np.frombuffer(counts, np.int64)[np.frombuffer(slots, np.int64)] if len(phrases) else np.zeros(0, np.int64)
        cuts = pa.record_batch({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string()), "a": a} | {c: told[at] for c, at in of.items()})
        return pa.Table.from_batches(list(judged(least, covered)(iter([cuts]))))

    return judge


def judged(least: int, covered: int):
    """Of frequent phrases (lang, phrase, a, l1, r1, l2, r2) the lowest cut, and the shorter phrases that they cover."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("lang", "phrase", "a", "l", "r", "score", "covers")}
            for lang, phrase, a, l1, r1, l2, r2 in zip(*[batch.column(c).to_pylist() for c in ("lang", "phrase", "a", "l1", "r1", "l2", "r2")]):
                if a < least:
                    continue
                words = phrase.split(" ")
                cuts = [(1_000_000 * a * a // (l * r), k, l, r) for k, l, r in ((1, l1, r1), (2, l2, r2))[: len(words) - 1]]
                score, _, l, r = min(cuts)
                inside = [(" ".join(words[:2]), l2), (" ".join(words[1:]), r1)] if len(words) == 3 else []
                for c, v in zip(out, (lang, phrase, a, l, r, score, [p for p, f in inside if 100 * a >= covered * f])):
                    out[c].append(v)
            kinds = {"lang": pa.string(), "phrase": pa.string(), "covers": pa.list_(pa.string())}
            yield pa.record_batch({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return judge


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, slots: int = SLOTS, shard: int = SHARD, bits: int | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to 3 words that occur `least` times or more."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(63, max(BLOCK_BITS + 9, int(size).bit_length() + SPARE_BITS)) if bits is None else bits
    buckets = rows.mapInArrow(bucket_rows(bits), "part int, block long, gaps binary, counts binary")
    buckets = checkpoint(buckets.repartition("block").mapInArrow(frequent_buckets(bits, least), "block long, often binary, namers binary, many long"))
    blocks = [(r["block"], r["many"]) for r in buckets.select("block", "many").collect() if r["many"]]  # 2 ** BLOCK_BITS rows at most
    if not blocks:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    cut = (-(-sum(many for _, many in blocks) // shard) - 1).bit_length()
    mapped = None
    for i, (first, last) in enumerate(runs(blocks, slots)):
        of = buckets.filter(F.col("block").between(first, last) & (F.col("many") > 0)).select("block", "often", "namers").orderBy("block").toArrow()
        sent = spark.sparkContext.broadcast(tuple(list(zip(of.column("block").to_pylist(), of.column(c).to_pylist())) for c in ("often", "namers")))
        part = rows.mapInArrow(candidate_rows(bits, cut, sent, words=i == 0), SHARD_ROWS)
        mapped = part if mapped is None else mapped.unionByName(part)
    while True:
        shards = checkpoint(mapped.groupBy("shard").applyInArrow(counted_shard(cut, least), COUNTED))
        short = [(r["shard"], r["many"]) for r in shards.select("shard", (F.octet_length("missing") / 8).cast("long").alias("many")).filter("many > 0").collect()]
        if not short:
            break
        for first, last in runs(short, slots):
            of = shards.filter(F.col("shard").between(first, last)).select("missing").toArrow().column("missing").to_pylist()
            sent = spark.sparkContext.broadcast(np.unique(np.frombuffer(b"".join(of), np.uint64)).tobytes())
            mapped = mapped.unionByName(rows.mapInArrow(naming_rows(cut, sent), SHARD_ROWS))
    totals = shards.select(F.explode(F.arrays_zip("total_of", "totals")).alias("t")).groupBy(F.col("t.total_of").alias("lang")).agg(F.sum("t.totals").alias("n"))
    asks = shards.select("shard", "langs", "phrases").mapInArrow(part_asks(cut), "shard int, origin int, k1 binary, k2 binary")
    index = shards.select("shard", "words", "sizes", "keys1", "keys2", "counts")
    answers = asks.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(part_counts(cut), "origin int, shard int, counts binary")
    of = shards.select("shard", "langs", "phrases", "slots", "counts")
    frequent = answers.groupBy("origin").cogroup(of.groupBy("shard")).applyInArrow(judged_cuts(least, covered), "lang string, phrase string, a long, l long, r long, score long, covers array<string>")
    frequent = checkpoint(frequent)
    covers = frequent.select(F.col("lang").alias("_lang"), F.explode("covers").alias("_phrase")).distinct()
    left = frequent.drop("covers").join(covers, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = lambda df, *key: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *key).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    # A language may hold most phrases: its best meet after those of its parts are known.
    chosen = best(best(left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), "salt").drop("salt", "rank"))
    return chosen.join(if_small(checkpoint(totals.withColumnRenamed("lang", "_lang")), 64), F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: concat_ws(' ', w[i], w[i + 1]))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) FROM w
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS place FROM c),
s AS (
  SELECT cut.lang, cut.k, cut.phrase, a, place, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.k = place AND x.phrase = array_to_string(w[1:place], ' ')
           JOIN f y ON y.lang = cut.lang AND y.k = cut.k - place AND y.phrase = array_to_string(w[place + 1:], ' ')
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1
), inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
  FROM low JOIN n ON n.lang = low.lang
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = low.lang AND i.phrase = low.phrase AND 100 * i.a >= 50 * low.a)
) WHERE rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
