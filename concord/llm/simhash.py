"""SimHash fingerprints, exact links within a Hamming radius, and near-duplicate classes.

Links: distinct fingerprints are cut into tiles by the population counts of their four 16-bit quarters. Two fingerprints
within the radius differ by at most the radius in the sum of those counts' distances, so only such tile pairs are
compared, exactly, with numpy exclusive-or and bit counts; all other pairs are skipped. Full tiles are split. Each tile
returns a spanning forest of its links, which has the same components as all of them.

Classes: components of the links by union-find within tasks and large and small stars between them, in written tables.
Copies share a fingerprint and are never paired.

Nulls are empty texts; texts without words have fingerprint 0, which is linked like any other; a null id is a document
of its own and never a class's id unless all are null; repeated rows are linked by their equal fingerprints; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import BROADCAST_BYTES, byte_batches, checkpoint, if_small, release, table

QUARTERS, MOST = 4, 16
TILE = 4096
ROWS_A_TASK = 200_000


def fingerprint(text: str, width: int = 3) -> int:
    """The bits set in over half the XXH64 digests of the word shingles, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) < width:
        return digest(b" ".join(words), 42)
    counts, total, step = np.zeros(64, np.int64), len(words) - width + 1, 1 << 15
    for i in range(0, total, step):
        part = words[i : i + step + width - 1]
        hashes = np.fromiter(map(digest, map(b" ".join, zip(*[part[k:] for k in range(width)])), repeat(42)), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (a signed 64-bit number)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in byte_batches(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch({"id": batch.column("id"), "fp": pa.array(fps.view(np.int64))})

    return rows.mapInArrow(compute, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that sum to the radius at most and whose first nonzero is positive."""
    near = [o for o in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, o)) <= radius]
    return [o for o in near if any(o) and next(x for x in o if x) > 0]


def tile_number(counts: list[Column]) -> Column:
    number = counts[0].cast("int")
    for c in counts[1:]:
        number = number * (MOST + 1) + c
    return number


class Forest:
    """A spanning forest of n nodes: of the edges that are added, those that join two trees are kept."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []
        self.joined = np.arange(n)
        self.stale = 0

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent[x]) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Edges within a tree known before are passed over at once."""
        fresh = self.joined[a] != self.joined[b]
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist()):
            u, v = self.root(x), self.root(y)
            if u != v:
                self.parent[max(u, v)] = min(u, v)
                self.edges.append((x, y))
                self.stale += 1
        if self.stale > len(self.joined) // 64:
            self.joined = np.array([self.root(x) for x in range(len(self.joined))])
            self.stale = 0


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int, same: bool, step: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within the radius, block by block; of one array with itself, each once."""
    rows = max(1, step // max(1, len(right)))
    for i in range(0, len(left), rows):
        start = i + 1 if same else 0
        near = np.bitwise_count(left[i : i + rows, None] ^ right[None, start:]) <= radius
        a, b = np.nonzero(near)
        a, b = a + i, b + start
        if same:
            a, b = a[b > a], b[b > a]
        if len(a):
            yield a, b


def linked(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Forest:
    """A forest over the positions of left and then right (of left alone if they are the same)."""
    forest = Forest(len(left) + (0 if same else len(right)))
    for a, b in near_pairs(left, right, radius, same):
        forest.add(a, b if same else b + len(left))
    return forest


def links(fps: DataFrame, radius: int) -> DataFrame:
    """fps (fp), distinct, as pairs (a, b) that connect the same fingerprints as all pairs within the radius.

    A tile's own rows are split into parts of about TILE, and so are the rows of its neighbours (guests). Each pair of a
    part with a later one or with a part of the guests is one piece of work, so none is larger than that.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).alias(f"c{k}") for k in range(QUARTERS)]
    cells = [F.col(f"c{k}") for k in range(QUARTERS)]
    own = checkpoint(fps.select("fp", *counts).withColumn("tile", tile_number(cells)))
    near = F.array(*[F.struct(*[F.lit(x).alias(f"o{k}") for k, x in enumerate(o)]) for o in offsets(radius)])
    moved = own.select("fp", *cells, F.explode(near).alias("o")).select("fp", *[(F.col(f"c{k}") - F.col(f"o.o{k}")).alias(f"c{k}") for k in range(QUARTERS)])
    moved = moved.filter(" AND ".join(f"c{k} BETWEEN 0 AND {MOST}" for k in range(QUARTERS))).select("fp", tile_number(cells).alias("tile"))
    # At most 17**4 tiles, whatever the input.
    sizes = own.groupBy("tile").agg(F.count("*").alias("n")).join(moved.groupBy("tile").agg(F.count("*").alias("g")), "tile", "left")
    sizes = sizes.select("tile", "n", F.coalesce("g", F.lit(0)).alias("g"))
    sizes = checkpoint(sizes.select("*", F.ceil(F.col("n") / TILE).cast("int").alias("splits"), F.greatest(F.ceil(F.col("g") / TILE), F.lit(1)).cast("int").alias("sides")))
    work = sizes.agg(F.sum(F.col("n") * (F.col("splits") + F.col("sides")) + F.col("g") * F.col("splits"))).first()[0] or 0
    splits = F.broadcast(sizes.select("tile", "splits", "sides"))
    spread = lambda name, first, last: F.explode(F.sequence(first, last)).alias(name)
    homes = own.join(splits, "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("splits")).cast("int"))
    # Work is named by tile, part and other: a later part (below 0) or a part of the guests.
    lead = homes.select("tile", "part", spread("other", F.lit(0), F.col("sides") - 1), F.lit(0).alias("role"), "fp")
    ahead = homes.filter("part < splits - 1").select("tile", "part", spread("other", -F.col("splits") + 1, -F.col("part") - 1), F.lit(0).alias("role"), "fp")
    later = homes.filter("part > 0").select("tile", (-F.col("part")).alias("other"), "fp", "part").select("tile", spread("part", F.lit(0), F.col("part") - 1), "other", F.lit(1).alias("role"), "fp")
    guests = moved.join(splits, "tile").withColumn("other", F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int"))
    guests = guests.select("tile", spread("part", F.lit(0), F.col("splits") - 1), "other", F.lit(1).alias("role"), "fp")
    rows = lead.unionByName(ahead).unionByName(later).unionByName(guests)
    tasks = max(1, work // ROWS_A_TASK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        tile, part, other, role, fp = (t.column(c).to_numpy() for c in ("tile", "part", "other", "role", "fp"))
        order = np.lexsort((fp, role, other, part, tile))
        tile, part, other, role, fp = (x[order] for x in (tile, part, other, role, fp))
        new = (np.diff(tile) != 0) | (np.diff(part) != 0) | (np.diff(other) != 0)
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(fp)]]).tolist()
        for a, b in zip(edges, edges[1:]):
            k = a + int(np.searchsorted(role[a:b], 1))
            mine, others = fp[a:k].view(np.uint64), fp[k:b].view(np.uint64)
            found = Forest(b - a)
            if other[a] == 0:
                for x, y in near_pairs(mine, mine, radius, True):
                    found.add(x, y)
            for x, y in near_pairs(mine, others, radius, False):
                found.add(x, y + len(mine))
            if found.edges:
                ends = np.array(found.edges)
                yield pa.record_batch({"a": fp[a:b][ends[:, 0]], "b": fp[a:b][ends[:, 1]]})

    return rows.repartition(tasks, "tile", "part", "other").mapInArrow(compare, "a long, b long")


def bands(counts: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """(lowest, highest population count, splits) of tiles: neighbouring counts together while they have `size` rows at most."""
    out: list[tuple[int, int, int]] = []
    held = 0
    for pop, n in sorted(counts.items()):
        if out and held + n <= size:
            out[-1], held = (out[-1][0], pop, 1), held + n
        else:
            out, held = [*out, (pop, pop, -(-n // size))], n
    return out


def wide_links(fps: DataFrame, radius: int, tile: int = 16384, across: int = 32) -> DataFrame:
    """As `links`, for radii at which almost all tiles are near each other: pairs (a, b).

    Tiles hold neighbouring population counts, so a pair of tiles is skipped or compared as a whole. Tiles grow with the
    input so that each is read by about `across` others at most, and are shuffled once, to their pairs. A pair of tiles
    returns a spanning forest.
    """
    own = checkpoint(fps.select("fp", F.bit_count("fp").alias("pop")))
    counts = {r["pop"]: r["count"] for r in own.groupBy("pop").count().collect()}  # 65 population counts at most
    found = bands(counts, max(tile, -(-sum(counts.values()) // across))) or [(0, 64, 1)]
    at = F.element_at(F.array(*[F.lit(next((i for i, (low, high, _) in enumerate(found) if low <= pop <= high), 0)) for pop in range(65)]), F.col("pop") + 1)
    splits = F.array(*[F.lit(n) for _, _, n in found])
    number = lambda band, split: F.col(band).cast("long") * (1 << 32) + split
    rows = own.withColumn("band", at).withColumn("tile", number("band", F.pmod(F.xxhash64("fp"), F.element_at(splits, F.col("band") + 1))))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.sort(np.concatenate([b.column("fp").to_numpy() for b in batches]))
        yield pa.record_batch({"tile": pa.array([key[0].as_py()]), "band": pa.array([key[1].as_py()], pa.int32()), "fps": pa.array([held.astype("<i8").tobytes()], pa.binary())})

    tiles = checkpoint(rows.select("tile", "band", "fp").groupBy("tile", "band").applyInArrow(pack, "tile long, band int, fps binary"))
    near = [[j for j, (low, high, _) in enumerate(found) if low - found[i][1] <= radius and found[i][0] - high <= radius] for i in range(len(found))]
    sent = tiles.select("*", F.explode(F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in near]), F.col("band") + 1)).alias("other_band"))
    sent = sent.withColumn("split", F.explode(F.sequence(F.lit(0), F.element_at(splits, F.col("other_band") + 1) - 1))).withColumn("with", number("other_band", F.col("split")))
    sent = sent.select(F.least("tile", "with").alias("tile"), F.greatest("tile", "with").alias("other"), (F.col("with") < F.col("tile")).alias("second"), "fps")
    total = sum(n for _, _, n in found)
    pairs = sum(found[i][2] * found[j][2] for i, r in enumerate(near) for j in r)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        waiting: dict[tuple[int, int], tuple[bool, bytes]] = {}
        for batch in batches:
            for tile, other, second, fps in zip(*[batch.column(c).to_pylist() for c in ("tile", "other", "second", "fps")]):
                same = tile == other
                if not same and (tile, other) not in waiting:
                    waiting[tile, other] = (second, fps)
                    continue
                sides = {second: fps} if same else dict([waiting.pop((tile, other)), (second, fps)])
                left, right = (np.frombuffer(sides.get(side, fps), "<u8") for side in (False, True))
                found = linked(left, right, radius, same)
                if found.edges:
                    every, ends = (left if same else np.concatenate([left, right])).view(np.int64), np.array(found.edges)
                    yield pa.record_batch({"a": every[ends[:, 0]], "b": every[ends[:, 1]]})

    return sent.repartition(max(1, (pairs + total) // 2), "tile", "other").mapInArrow(compare, "a long, b long")


def sized(rows: DataFrame) -> DataFrame:
    """Narrow rows, written, and read in as many tasks as their number calls for: few rows are then not shuffled again."""
    written = checkpoint(rows)
    return written.coalesce(max(1, -(-written.count() // ROWS_A_TASK)))


def shingles(text: str, width: int) -> set[int]:
    import xxhash

    words = text.encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))} if words else set()


def similarity(a: str, b: str, width: int = 5) -> float:
    """Jaccard similarity of the texts' sets of word shingles; of two texts without words it is 1."""
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y) if x or y else 1.0


#: Texts whose shingles are counted to tell common ones, and how many of these the driver keeps; members of a shingle's
#: group that are paired at once, or compared; bytes of the sets that a block of such members holds; pairs of a member
#: that are listed rather than their block compared on the whole sets.
COUNTED, COMMON, FEW, MEMBERS, BLOCK_BYTES, LOOSE = 20_000, 2_000_000, 32, 4096, 64 << 20, 4


def ordered_prefix(found: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a text's shingles, rare ones first: texts of Jaccard similarity `least` have one of these in common.

    A text shares least * n of its n shingles with any such text, so it can't be without all but these. Any one order of
    shingles is right; `common` (sorted high halves) and `counts` only keep the groups of equal shingles small.
    """
    times = np.zeros(len(found), np.int64)
    if len(common):
        half = (found >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(common, half), len(common) - 1)
        times = np.where(common[at] == half, counts[at], 0)
    keep = len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1
    return found[np.lexsort((found, times))[:keep]] if len(found) else np.zeros(1, np.uint64)


def group_links(sets: list[np.ndarray], known: list, sides: list[int], least: float) -> Iterator[tuple[int, int]]:
    """Positions of verified links that join the known classes of a group as all its links do; with two sides, across them."""
    parent = {c: c for c in known}

    def root(x):
        while (up := parent[x]) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    values, starts = np.unique(every[order], return_index=True)
    ends = np.append(starts[1:], len(every))
    side = np.array(sides)
    label = np.array([root(c) for c in known])
    for x in range(len(sets)):
        may = (side > side[x]) if side.any() else (np.arange(len(sets)) > x)
        may &= label != label[x]
        may &= (size >= least * size[x] - 1e-6) & (size[x] >= least * size - 1e-6)
        if not may.any():
            continue
        at = np.searchsorted(values, sets[x])
        held = [owner[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist())]
        both = np.bincount(np.concatenate(held), minlength=len(sets)) if held else np.zeros(len(sets), np.int64)
        joined = False
        for y in np.flatnonzero(may & (both >= least * (size[x] + size - both))).tolist():
            u, v = root(known[x]), root(known[y])
            if u != v:
                parent[max(u, v)] = min(u, v)
                joined = True
                yield x, y
        if joined:
            label = np.array([root(c) for c in known])


def few_pairs(start: int, unit: np.ndarray, label: np.ndarray, n: np.ndarray, at: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Pairs of one shingle's rows of different classes whose sizes allow a link: positions, and whether their places do
    if this is the first shingle that they have in common."""
    a, b = np.triu_indices(len(unit), 1)
    near = (label[a] != label[b]) & (n[a] >= least * n[b] - 1e-6) & (n[b] >= least * n[a] - 1e-6)
    a, b = a[near], b[near]
    swap = unit[a] > unit[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return a + start, b + start, np.minimum(n[a] - at[a], n[b] - at[b]) >= least / (1 + least) * (n[a] + n[b]) - 1e-6


def texts_of(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows (id, digest, tag, ...) of the units' first documents, with unit and _id, a key of the id; units (unit, first, digest, tag, ...)."""
    key = lambda c: F.xxhash64(F.col(c).isNull(), c)
    named = units.select(F.col("digest").alias("_d"), F.col("tag").alias("_t"), key("first").alias("_f"), "first", *[c for c in units.columns if c not in ("digest", "tag", "first")])
    same = F.coalesce(F.col("id") == F.col("first"), F.col("id").isNull() & F.col("first").isNull())
    return rows.withColumn("_id", key("id")).join(named, (F.col("digest") == F.col("_d")) & (F.col("tag") == F.col("_t")) & (F.col("_id") == F.col("_f")) & same).drop("_d", "_t", "_f", "first")


def whole_set(text: str, width: int) -> np.ndarray:
    return np.sort(np.fromiter(shingles(text, width), np.uint64))


def marks_of(found: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by their low bits, in two to four bits a shingle."""
    size = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(marks: np.ndarray, words: int) -> np.ndarray:
    """Marks (in rows) as those of the same sets with `words` words, a smaller power of two."""
    while marks.shape[-1] > words:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


def may_link(n, m, differing, least: float):
    """Whether sets of n and m may have the Jaccard similarity: each differing parity is a shingle that one of them lacks."""
    return (1 + least) * (n + m - differing) >= 2 * least * (n + m) - 1e-6


def chosen_bits(units: DataFrame, many: int) -> tuple[int, np.ndarray]:
    """A bitmap of about 16 bits a unit, with the bit of each one's digest, and its size: rules most other texts out."""
    size = 1 << max(15, (16 * many - 1).bit_length())
    at = F.col("digest").bitwiseAND(F.lit(size - 1))
    found = units.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).toArrow()
    out = np.zeros((size >> 15, 1 << 12), np.uint8)
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
        out[part] = np.frombuffer(bits, np.uint8)
    return size, out.reshape(-1)


def unit_sets(rows: DataFrame, units: DataFrame, width: int, made=None) -> DataFrame:
    """unit, whole: the sorted set of shingles, as bytes, of each of the units' texts (or what `made` makes of it), and n, its size.

    Few units are broadcast once counted. Else sets are made where the texts lie, if a bitmap of the units' digests has
    theirs, and only these are shuffled, never the texts. Only a unit of several documents can have its first one twice.
    """
    wanted = checkpoint(units.select("unit", "first", "digest", "tag", "several"))
    many = wanted.count()
    few = many * 41 <= BROADCAST_BYTES
    size, bits = (0, None) if few else chosen_bits(wanted, many)
    known = rows.sparkSession.sparkContext.broadcast(bits)
    names = ["unit"] if few else ["id", "digest", "tag"]

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            if size:
                at = batch.column("digest").to_numpy().view(np.uint64) & np.uint64(size - 1)
                batch = batch.filter(pa.array((known.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))
            sets = [whole_set(t, width) for t in batch.column("text").to_pylist()]
            whole = [(x if made is None else made(x)).tobytes() for x in sets]
            yield pa.record_batch({c: batch.column(c) for c in names} | {"n": pa.array([len(x) for x in sets], pa.int32()), "whole": pa.array(whole, pa.binary())})

    if few:
        found = texts_of(rows, F.broadcast(wanted))
        again = found.filter("several").groupBy("unit").agg(F.min("text").alias("text"))
        return checkpoint(found.filter("NOT several").select("unit", "text").unionByName(again).mapInArrow(shrink, "unit long, n int, whole binary"))
    kind = rows.schema["id"].dataType.simpleString()
    found = texts_of(rows.mapInArrow(shrink, f"id {kind}, digest long, tag int, n int, whole binary"), wanted)
    # Repeated rows of a first document lie together by the join's keys.
    return checkpoint(found.groupBy("digest", "tag", "_id").agg(F.min("unit").alias("unit"), F.min(F.struct("n", "whole")).alias("r")).select("unit", "r.*"))


def marked(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) that their marks (unit, n, whole) don't rule out."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*[batch.column(c).to_pylist() for c in ("n", "m", "x", "y")]):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                words = min(len(x), len(y))
                keep.append(may_link(n, m, int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()), least))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    both = pairs.join(marks.select(F.col("unit").alias("u"), "n", F.col("whole").alias("x")), "u").join(marks.select(F.col("unit").alias("v"), F.col("n").alias("m"), F.col("whole").alias("y")), "v")
    return both.select("u", "v", "n", "m", "x", "y").mapInArrow(judge, "u long, v long")


def marked_pairs(marks: list[np.ndarray], n: np.ndarray, label: np.ndarray, side: np.ndarray, least: float, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of different classes (across the sides, if there are two) that their marks don't rule out."""
    words = np.array([len(x) for x in marks])
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        own = own[np.argsort(n[own], kind="stable")]
        # Sets whose sizes allow a link have as many words, or one of them twice as many.
        large = np.flatnonzero(words == 2 * w)
        every = np.concatenate([own, large[np.argsort(n[large], kind="stable")]])
        table = np.stack([folded(marks[x], w) for x in every.tolist()])
        rows = max(1, step // (len(every) * w))
        for i in range(0, len(own), rows):
            a = np.arange(i, min(i + rows, len(own)))
            differing = np.bitwise_count(table[a, None] ^ table[None, i:]).sum(-1, dtype=np.int64)
            x, y = np.nonzero(may_link(n[every[a], None], n[every[None, i:]], differing, least) & (label[every[a], None] != label[every[None, i:]]))
            x, y = x + i, y + i
            x, y = every[x[y > x]], every[y[y > x]]
            across = side[x] != side[y] if side.any() else np.ones(len(x), bool)
            if across.any():
                yield x[across], y[across]


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the (checkpointed) pairs (u, v) whose sets have a Jaccard similarity of at least `least`."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x", "y"))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    # Few pairs leave the sets that they don't need in place.
    few = if_small(pairs, 24)
    second = sets.select(F.col("unit").alias("v"), F.col("whole").alias("y")).join(few.select("v"), "v", "left_semi")
    both = few.join(sets.select(F.col("unit").alias("u"), F.col("whole").alias("x")), "u").join(second, "v")
    return sized(both.select("u", "v", "x", "y").mapInArrow(verify, "u long, v long"))


def common_shingles(rows: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """High halves of shingles, sorted, that several rows have, and their counts: the commonest, whole counts at a time,
    `most` at most.

    They only order shingles, so that halves do and any bound is right: six bytes each on the driver, whatever the
    texts' length. There are as many different counts as rows of one half at most.
    """
    counted = rows.groupBy(F.shiftright("shingle", 32).cast("int").alias("half")).agg(F.least(F.count("*"), F.lit(32767)).cast("short").alias("times"))
    counted = checkpoint(counted.filter("times > 1"))
    least, kept = 2, 0
    for row in counted.groupBy("times").count().orderBy(F.desc("times")).collect():
        kept += row["count"]
        if kept > most:
            least = row["times"] + 1
            break
    found = counted.filter(F.col("times") >= least).toArrow()
    values, times = found.column("half").to_numpy().view(np.uint32), found.column("times").to_numpy()
    order = np.argsort(values)
    return values[order], times[order]


def exact_links(rows: DataFrame, known: DataFrame, least: float, width: int, few: int = FEW, members: int = MEMBERS, block_bytes: int = BLOCK_BYTES, loose: int = LOOSE) -> DataFrame:
    """Pairs (u, v) of units that, with the known classes, join the same units as all pairs of similarity `least` do.

    rows (id, digest, tag, text); known (unit, first, digest, tag, class, and several, true if left out): the units' first documents. Two such texts have a shingle of their
    prefixes in common. Of `few` rows or less with an equal shingle, the pairs of different classes are listed, and
    compared if their places and their number of common prefix shingles allow it. Larger groups are compared in blocks of
    about `members` or `block_bytes` of sets. Both are first compared by marks, a thirtieth of the sets: these rule
    out pairs that can't be links. The pairs left are compared on the whole sets; of blocks with more than `loose` of them
    a row, the whole block is, and returns verified links only.
    """
    known = known if "several" in known.columns else known.withColumn("several", F.lit(True))
    kind = rows.schema["id"].dataType.simpleString()

    def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            for t in batch.column("text").to_pylist():
                yield pa.record_batch({"shingle": pa.array(np.fromiter(shingles(t, width), np.uint64).view(np.int64))})

    chance = F.shiftrightunsigned(F.xxhash64("digest", F.lit(5)), 12) / float(1 << 52)
    sampled = rows.filter(chance * F.lit(max(1, known.count())) < COUNTED).select("text")
    tokens, counts = common_shingles(sampled.mapInArrow(all_shingles, "shingle long"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            sets = [whole_set(t, width) for t in batch.column("text").to_pylist()]
            kept = [ordered_prefix(x, least, tokens, counts).view(np.int64) for x in sets]
            yield pa.record_batch({"id": batch.column("id"), "digest": batch.column("digest"), "tag": batch.column("tag"), "n": pa.array([len(x) for x in sets], pa.int32()), "kept": pa.array(kept, pa.list_(pa.int64()))})

    prefixes = texts_of(rows.mapInArrow(first, f"id {kind}, digest long, tag int, n int, kept array<long>"), known)
    # Repeated rows of a unit's first document give the same prefix again. They lie together by the join's keys.
    prefixes = prefixes.groupBy("digest", "tag", "_id").agg(*[F.min(c).alias(c) for c in ("unit", "class", "n", "kept")])
    prefixes = prefixes.select("unit", "class", "n", F.posexplode("kept").alias("at", "shingle"))
    kinds = {"shingle": pa.int64(), "unit": pa.int64(), "class": pa.int64(), "n": pa.int32(), "reach": pa.float64(), "shortest": pa.int32(), "blocks": pa.int32(), "u": pa.int64(), "v": pa.int64(), "nu": pa.int32(), "nv": pa.int32(), "ok": pa.bool_()}
    ddl = "shingle long, unit long, class long, n int, reach double, shortest int, blocks int, u long, v long, nu int, nv int, ok boolean"

    def given(columns: dict) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.record_batch({k: pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in kinds.items()})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None

        def groups(t: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            shingle, unit, label, n, at = t
            edges = np.flatnonzero(np.diff(shingle)) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(shingle))
            found, count = [], 0
            for i, j in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                if (label[i:j] == label[i]).all():
                    continue
                if j - i <= few:
                    found.append(few_pairs(i, unit[i:j], label[i:j], n[i:j], at[i:j], least))
                    count += len(found[-1][0])
                    if count > 50_000 or j == ends[-1]:
                        a, b, ok = map(np.concatenate, zip(*found))
                        yield given({"u": unit[a], "v": unit[b], "nu": n[a], "nv": n[b], "ok": ok})
                        found, count = [], 0
                else:
                    # The largest text that can still share enough with one of n shingles, the first `at` of which it hasn't.
                    blocks = max(-(-(j - i) // members), -(-8 * int(n[i:j].sum(dtype=np.int64)) // block_bytes))
                    reach = (n[i:j] - at[i:j]) * ((1 + least) / least) - n[i:j] + 1e-6
                    yield given({"shingle": shingle[i:j], "unit": unit[i:j], "class": label[i:j], "n": n[i:j], "reach": reach, "shortest": np.full(j - i, n[i:j].min()), "blocks": np.full(j - i, blocks)})
            if found:
                a, b, ok = map(np.concatenate, zip(*found))
                yield given({"u": unit[a], "v": unit[b], "nu": n[a], "nv": n[b], "ok": ok})

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("shingle", "unit", "class", "n", "at")]
            now = now if carry is None else [np.concatenate(x) for x in zip(carry, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            carry = [x[cut:] for x in now]
            if cut:
                yield from groups([x[:cut] for x in now])
        if carry is not None and len(carry[0]):
            yield from groups(carry)

    grouped = prefixes.repartition("shingle").sortWithinPartitions("shingle").select("shingle", "unit", "class", "n", "at")
    grouped = checkpoint(grouped.mapInArrow(gather, ddl))

    many = grouped.filter("blocks IS NOT NULL")
    hot = many.groupBy(F.col("unit").alias("u")).agg(F.count("*").alias("hot"))
    rest = lambda n: F.greatest(F.ceil(F.col(n) * least - 1e-9) - 1, F.lit(0))
    pairs = grouped.filter("u IS NOT NULL").groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("both"), F.max("ok").alias("ok")).filter("ok").join(hot, "u", "left")
    # What prefixes share, and at most the rest of one of both texts: of that whose prefix ends first.
    pairs = pairs.filter(F.col("both") + F.coalesce("hot", F.lit(0)) + F.greatest(rest("nu"), rest("nv")) >= least / (1 + least) * (F.col("nu") + F.col("nv")) - 1e-6)
    pairs = sized(pairs.select("u", "v").distinct())
    many = checkpoint(many.filter((F.col("reach") >= F.col("shortest"))).select("unit", "class", "shingle", "blocks"))
    ends = lambda rows: rows.select(F.explode(F.array("u", "v")).alias("unit"))
    needed = ends(pairs).unionByName(many.select("unit")).distinct()
    marks = unit_sets(rows, known.join(needed, "unit", "left_semi"), width, marks_of)

    block = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    blocked = many.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = blocked.select("unit", "class", "shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    names = ["shingle", "i", "j", "unit", "class", "side"]

    def by_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
        now, held = None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in columns]):
                if row[:3] != now:
                    if held:
                        yield held
                    now, held = row[:3], []
                held.append(row)
        if held:
            yield held

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"u": pa.int64(), "v": pa.int64(), "shingle": pa.int64(), "i": pa.int32(), "j": pa.int32(), "unit": pa.int64(), "class": pa.int64(), "side": pa.int32()}
        given = lambda columns, rows: pa.record_batch({k: pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in kinds.items()})
        for held in by_block(batches, [*names, "n", "whole"]):
            n, label, side = (np.array([r[k] for r in held], np.int64) for k in (6, 4, 5))
            unit, found, count = np.array([r[3] for r in held], np.int64), [], 0
            for a, b in marked_pairs([np.frombuffer(r[7], "<u8") for r in held], n, label, side, least):
                found.append((a, b))
                count += len(a)
                if count > loose * len(held):
                    break
            if count > loose * len(held):
                yield given({c: [r[k] for r in held] for k, c in enumerate(names)}, len(held))
            elif count:
                a, b = map(np.concatenate, zip(*found))
                yield given({"u": unit[np.where(unit[a] < unit[b], a, b)], "v": unit[np.where(unit[a] < unit[b], b, a)]}, len(a))

    in_blocks = lambda rows: rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    sifted = checkpoint(in_blocks(blocked.join(marks, "unit").select(*names, "n", "whole")).mapInArrow(sift, "u long, v long, shingle long, i int, j int, unit long, class long, side int"))
    heavy = sifted.filter("unit IS NOT NULL").select(*names)
    pairs = sized(marked(pairs, marks, least).unionByName(sifted.filter("u IS NOT NULL").select("u", "v")).distinct())
    sets = unit_sets(rows, known.join(ends(pairs).unionByName(heavy.select("unit")).distinct(), "unit", "left_semi"), width)
    true = verified(pairs, sets, least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_block(batches, [*names, "whole"]):
            if len({r[4] for r in held}) > 1:
                _, _, _, units, classes_known, sides, found = zip(*held)
                links_found = list(group_links([np.frombuffer(x, np.uint64) for x in found], list(classes_known), list(sides), least))
                if links_found:
                    yield pa.record_batch({"u": pa.array([units[a] for a, _ in links_found], pa.int64()), "v": pa.array([units[b] for _, b in links_found], pa.int64())})

    whole = in_blocks(heavy.join(sets.select("unit", "whole"), "unit").select(*names, "whole"))
    return checkpoint(whole.mapInArrow(compare, "u long, v long")).unionByName(true).distinct()


#: Candidates of a text that a round tries, before all are.
MOST_TRIED = 32


def near_duplicates(docs: DataFrame, radius: int = 11, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (of the text), tag (a second digest), component, component_id (its least id, null if all are), one row
    per document: classes of documents that links join; a link is an exact Jaccard similarity of at least `least` on
    word shingles. A null id or one that several texts have is a document like any other.

    Equal texts are one unit. First, candidates within the SimHash `radius` come as a spanning forest of each pair of tiles, so no
    group's pairs are all emitted. They are verified on the whole texts in rounds: of each text one candidate, then twice
    as many as before, and only between classes that are still apart, until none is left. So a large group costs about
    a pair a text. Then `exact_links` finds every link between the classes that these leave apart, whatever its distance.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.hash(text).alias("tag"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in byte_batches(batches, "text"):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch({"id": batch.column("id"), "digest": batch.column("digest"), "tag": batch.column("tag"), "fp": pa.array(fps.view(np.int64))})

    prints = checkpoint(rows.mapInArrow(compute, f"id {kind}, digest long, tag int, fp long"))
    units = checkpoint(prints.groupBy("digest", "tag").agg(F.min("fp").alias("fp"), F.min("id").alias("first"), (F.count("*") > 1).alias("several")))
    # Numbers by place in a written table stay the same when a lost part is computed again.
    units = checkpoint(units.withColumn("unit", F.monotonically_increasing_id()))
    heads = checkpoint(units.groupBy("fp").agg(F.min("unit").alias("head")))
    named = lambda c, n: heads.select(F.col("fp").alias(c), F.col("head").alias(n))
    across = wide_links(heads.select("fp"), radius).join(named("a", "u"), "a").join(named("b", "v"), "b").select("u", "v")
    within = units.join(heads, "fp").filter("unit != head").select(F.col("head").alias("u"), F.col("unit").alias("v"))
    both = across.unionByName(within).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    candidates = sized(both.distinct())
    needed = candidates.select(F.explode(F.array("u", "v")).alias("unit")).distinct()
    sets = unit_sets(rows, units.join(needed, "unit", "left_semi"), width)

    nothing = units.select(F.col("unit").alias("a"), F.col("unit").alias("b")).limit(0)
    true, roots, most = nothing, nothing.toDF("node", "root"), 1
    while not candidates.isEmpty():
        place = F.row_number().over(Window.partitionBy("v").orderBy("u"))
        chosen = candidates.withColumn("place", place).filter(F.col("place") <= most) if most <= MOST_TRIED else candidates
        tried = sized(chosen.select("u", "v"))
        good = verified(tried, sets, least)
        if not good.isEmpty():
            true = sized(true.unionByName(good.toDF("a", "b")))
            roots = components(true)
        of = lambda c: if_small(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), 24)
        left = candidates.join(if_small(tried, 24), ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
        candidates = sized(left.filter(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"))
        most *= 2
    with_class = lambda: units.join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("class", F.coalesce("root", "unit")).drop("root")
    more = exact_links(rows, checkpoint(with_class().select("unit", "first", "digest", "tag", "several", "class")), least, width)
    if not more.isEmpty():
        roots = components(true.unionByName(more.toDF("a", "b")))
    whole = checkpoint(with_class().select("digest", "tag", "first", F.col("class").alias("component")))
    least_id = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = whole.drop("first").join(least_id, "component")
    return prints.select("id", "digest", "tag").join(whole, ["digest", "tag"]).select(F.col("id").alias(id_col), "digest", "tag", "component", "component_id")


#: So many edges are contracted in one task.
EDGES_A_TASK = 200_000


def components(edges: DataFrame, rounds: int = 100, a_task: int = EDGES_A_TASK) -> DataFrame:
    """edges (a, b) as node, root: the least node of each component.

    Each round contracts the edges of every task to stars by union-find, `a_task` edges to a task. Once one task holds all
    edges, its stars are the result. Else, by a large star, each node's larger neighbours move to its least neighbour, and
    by a small star so do its smaller ones. All three keep the components, and when nothing changes every node hangs from
    its root. It is an error if that takes over `rounds`.
    """
    # Repeated edges are dropped by the first contraction.
    now = checkpoint(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    kind = now.schema["a"].dataType.simpleString()

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        for i in range(0, len(nodes), 50_000):
            part, of = nodes[i : i + 50_000], batch.schema.field("a").type
            yield pa.record_batch({"a": pa.array([root(x) for x in part], of), "b": pa.array(part, of)})

    state = None
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    for _ in range(rounds):
        # As many tasks as the edges call for.
        parts = max(1, -(-now.count() // a_task))
        now = checkpoint((now.coalesce(1) if parts == 1 else now.repartition(parts)).mapInArrow(contract, f"a {kind}, b {kind}"))
        if parts == 1:
            break  # the stars of one task that held all edges are whole: a further round would find the same
        both = now.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.*")
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        large = checkpoint(large)
        smallest = large.groupBy(F.col("b").alias("w")).agg(F.min("a").alias("m"))
        moved = large.join(smallest, F.col("b") == F.col("w"))
        small = moved.select(F.explode(F.array(pair("m", "b"), F.when(F.col("a") != F.col("m"), pair("m", "a")))).alias("e")).filter("e IS NOT NULL").select("e.*")
        now = checkpoint(small.distinct())
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        state = seen
    else:
        raise RuntimeError(f"components that {rounds} rounds don't join")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """prints (id, fp) with component_id, the least id that links within the radius lead to."""
    prints = checkpoint(prints)
    heads = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(heads.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    whole = heads.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(whole.join(ids, "root").select("fp", "component_id"), "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(fingerprints(table(spark, sf_dir, "documents")), 2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
