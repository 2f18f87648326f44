"""Jaccard join of word shingle sets over signature trees, and the classes that its links make.

A document's signature is a bitmap of its shingles, a power of two of at least as many bits as it has shingles, so the
signature of a set that is close enough has as many bits or a neighbouring power, and the wider one folds onto the
other. Documents are cut into tiles by set size. Each tile is a tree: nodes of LEAF documents, FAN of which make a node of
the next level, hold the documents' bitmaps combined by OR, the range of their sizes, and the most shingles of one
document that share a bit. Two tiles whose sizes allow a link are traversed together from their roots: a pair of nodes is
left if the sizes don't allow a link, or if what one document shares with another, which is at most the bits that the nodes
have in common plus the shingles that share a bit, is less than a link needs. Pairs of documents are judged by the same
bound; those that pass are compared on their whole sets.

Equal sets are one unit. First each pair of tiles gives a spanning forest of the pairs that pass, which is verified. Then
trees of the documents in these forests alone, less those whose pairs are all within one class by now, are traversed, and
every document that still has a partner that passes in another class is compared with such partners, in blocks of bounded
size that return links only. So no link between classes is missed, and a dense group costs about a pair a document.

Nulls are empty texts; a text without words has size 0 and is linked with nothing, not even with another such; one with
fewer words than a shingle is one shingle. A null id is a document like any other, and a class's id only if all of its
ids are null. Rows that repeat an id are documents of their own. An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import byte_batches, checkpoint, if_small, release, table
from concord.llm.simhash import Forest, components, sized, unit_sets

LEAF, FAN = 64, 8
#: Bytes of a tile: what few tiles hold, what none exceeds, and so many tiles that are made before they grow.
TILE_LEAST, TILE_MOST, TILES = 256 << 10, 64 << 20, 48
#: Size bands to a power of two; shingles of one side of a verified block.
STEPS, BLOCK = 16, 1 << 20
#: What a document takes in a tile besides its bitmap.
ROW_BYTES = 32


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted XXH64 digests of the text's distinct word shingles."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*[words[k:] for k in range(width)]) if len(words) >= width else [words]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(42)), np.uint64))


def words_of(n: int) -> int:
    """64-bit words of the signature of n shingles."""
    return 1 << max(0, (n - 1).bit_length() - 6) if n > 0 else 1


def signature(found: np.ndarray) -> bytes:
    bits = np.zeros(words_of(len(found)) * 64, np.uint8)
    bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def prints(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents as id, digest, tag, text, and of each also n, set digests d1 and d2, and sig in place of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.hash(text).alias("tag"), text.alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        for batch in byte_batches(batches, "text"):
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            whole = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            half = lambda k: pa.array(np.array([(x >> k) & (2**64 - 1) for x in whole], np.uint64).view(np.int64))
            yield pa.record_batch({"id": batch.column("id"), "digest": batch.column("digest"), "tag": batch.column("tag"), "n": pa.array([len(s) for s in sets], pa.int32()), "d1": half(64), "d2": half(0), "sig": pa.array([signature(s) for s in sets], pa.binary())})

    return rows, rows.mapInArrow(compute, f"id {rows.schema['id'].dataType.simpleString()}, digest long, tag int, n int, d1 long, d2 long, sig binary")


class Tree:
    """A signature tree over documents of one signature width, in order of size."""

    def __init__(self, at: np.ndarray, n: np.ndarray, bits: np.ndarray):
        self.at, self.n, self.bits = at, n, bits
        self.slack = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.columns = np.ascontiguousarray(bits.T)
        self.levels = [self.up(bits, n, n, self.slack, LEAF)]
        while len(self.levels[-1][1]) > FAN:
            self.levels.append(self.up(*self.levels[-1], FAN))

    @staticmethod
    def up(bits: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray, many: int) -> tuple[np.ndarray, ...]:
        starts = np.arange(0, len(low), many)
        return np.bitwise_or.reduceat(bits, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(slack, starts)

    def folded(self) -> Tree:
        half = self.bits.shape[1] // 2
        return Tree(self.at, self.n, self.bits[:, :half] | self.bits[:, half:])


def enough(both: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `total` shingles together, `both` of them shared, reach the percentage."""
    return (100 + percent) * both >= percent * total


def node_pairs(left: Tree, right: Tree, same: bool, percent: int, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lowest nodes that the dual traversal leaves."""
    top = max(len(left.levels), len(right.levels)) - 1
    level_of = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
    a, b = len(level_of(left, top)[1]), len(level_of(right, top)[1])
    i, j = np.divmod(np.arange(a * b), b)
    stack = [(top, i, j)]
    while stack:
        k, i, j = stack.pop()
        if len(i) > most:
            stack += [(k, i[s : s + most], j[s : s + most]) for s in range(0, len(i), most)]
            continue
        if same:
            i, j = i[i <= j], j[i <= j]
        (x, low_x, high_x, slack_x), (y, low_y, high_y, slack_y) = level_of(left, k), level_of(right, k)
        keep = (100 * high_x[i] >= percent * low_y[j]) & (100 * high_y[j] >= percent * low_x[i])
        i, j = i[keep], j[keep]
        shared = np.minimum(slack_x[i], slack_y[j]) + np.bitwise_count(x[i] & y[j]).sum(1, dtype=np.int64)
        keep = enough(shared, low_x[i] + low_y[j], percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if k == 0:
            yield i, j
            continue
        below = lambda tree, at: (at[:, None] * FAN + np.arange(FAN)) if k < len(tree.levels) else at[:, None]
        u, v = below(left, i), below(right, j)
        u, v = np.repeat(u, v.shape[1], axis=1).ravel(), np.tile(v, (1, u.shape[1])).ravel()
        real = (u < len(level_of(left, k - 1)[1])) & (v < len(level_of(right, k - 1)[1]))
        stack.append((k - 1, u[real], v[real]))


def leaf_pairs(left: Tree, right: Tree, first: int, part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, in the leaf that begins at `first` and in `part`, of documents whose bitmaps and sizes allow a link.

    Most pairs are ruled out by their first words: what the others can share is at most the bits that either has in them.
    """
    rows, chosen = left.bits[first : first + LEAF], right.columns[:, part]
    words = rows.shape[1]
    n, m = left.n[first : first + LEAF], right.n[part]
    # Shared shingles that a link needs, less those that share a bit: (100 + percent) * both >= percent * (n + m).
    need = -(-percent * (n[:, None] + m) // (100 + percent)) - np.minimum(left.slack[first : first + LEAF, None], right.slack[part])
    near = 100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m)
    need, both = need.astype(np.int32), np.zeros((len(rows), len(part)), np.int32)
    seen, cut = 0, max(1, words // 4)
    while seen < words:
        until = min(words, seen + cut)
        for k in range(seen, until):
            both += np.bitwise_count(rows[:, k, None] & chosen[k])
        seen = until
        rest = np.minimum(np.bitwise_count(rows[:, seen:]).sum(1, dtype=np.int32)[:, None], np.bitwise_count(chosen[seen:]).sum(0, dtype=np.int32))
        a, b = np.nonzero(near & (both + rest >= need))
        if seen < words and 16 * len(a) <= both.size:  # few are left: the rest of their words, pair by pair
            found = both[a, b] + np.bitwise_count(rows[a, seen:] & chosen[seen:, b].T).sum(1, dtype=np.int32)
            keep = found >= need[a, b]
            return a[keep], b[keep]
    return a, b


def tree_pairs(left: Tree, right: Tree, same: bool, percent: int, step: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of documents whose bitmaps and sizes allow a link; of one tree with itself, each pair once."""
    for i, j in node_pairs(left, right, same, percent):
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for node, others in zip(i[np.append(0, cuts)].tolist(), np.split(j, cuts)):
            first = node * LEAF
            every = (others[:, None] * LEAF + np.arange(LEAF)).ravel()
            every = every[every < len(right.n)]
            for at in range(0, len(every), step):
                part = every[at : at + step]
                a, b = leaf_pairs(left, right, first, part, percent)
                a, b = a + first, part[b]
                if same:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    yield left.at[a], right.at[b]


def trees_of(tile: dict) -> dict[int, Tree]:
    """A tile's trees by their signatures' words."""
    size = np.array([words_of(x) for x in tile["n"].tolist()], np.int64)
    flat, ends = np.frombuffer(tile["sigs"], "<u8"), np.cumsum(size)
    out = {}
    for words in np.unique(size).tolist():
        at = np.flatnonzero(size == words)
        out[words] = Tree(at, tile["n"][at], flat[(ends[at] - words)[:, None] + np.arange(words)])
    return out


def passing(left: dict, right: dict, same: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in two tiles of documents that may be linked; in one tile with itself each pair once."""
    a, b = trees_of(left), trees_of(right)
    for words, tree in a.items():
        if words in b:
            yield from tree_pairs(tree, tree if same else b[words], same, percent)
        if 2 * words in b:
            yield from tree_pairs(tree, b[2 * words].folded(), False, percent)
        if words // 2 in b and words > 1 and not same:
            yield from tree_pairs(tree.folded(), b[words // 2], False, percent)


def tile_plan(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(first band, last band, least size, largest size, splits) of tiles; found: (band, least, largest, bytes), in order."""
    limit = min(TILE_MOST, max(TILE_LEAST, sum(x[3] for x in found) // TILES))
    out, held = [], 0
    for band, low, high, size in found:
        if out and held + size <= limit:
            out[-1], held = (out[-1][0], band, out[-1][2], high, 1), held + size
        else:
            out, held = [*out, (band, band, low, high, -(-size // limit))], size
    return out


def tiles_of(units: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """pair rows (tile, other, side, and a tile's documents packed), and how many pairs there are.

    units: unit, class, n, sig. A tile goes to every tile whose sizes allow a link, itself included.
    """
    banded = units.withColumn("band", F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int"))
    sizes = banded.groupBy("band").agg(F.min("n"), F.max("n"), F.sum(F.length("sig") + ROW_BYTES))
    found = tile_plan(sorted(map(tuple, sizes.collect())))  # at most 31 * STEPS bands
    if not found:
        return None, 0
    near = [[j for j, (_, _, low, high, _) in enumerate(found) if 100 * high >= percent * least and 100 * most >= percent * low] for _, _, least, most, _ in found]
    place = {band: i for i, (start, end, *_) in enumerate(found) for band in range(start, end + 1)}
    at = F.element_at(F.array(*[F.lit(place.get(band, 0)) for band in range(31 * STEPS + 1)]), F.col("band") + 1)
    splits = F.array(*[F.lit(x[4]) for x in found])
    number = lambda run, split: F.col(run).cast("long") * (1 << 32) + split
    dealt = banded.withColumn("run", at).withColumn("tile", number("run", F.pmod(F.xxhash64("unit"), F.element_at(splits, F.col("run") + 1))))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("n", "ascending"), ("sig", "ascending"), ("unit", "ascending")])
        raw = lambda c, kind: pa.array([np.ascontiguousarray(t.column(c).to_numpy(), kind).tobytes()], pa.binary())
        yield pa.record_batch({"tile": pa.array([key[0].as_py()]), "run": pa.array([key[1].as_py()], pa.int32()), "units": raw("unit", np.int64), "classes": raw("class", np.int64), "ns": raw("n", np.int64), "sigs": pa.array([b"".join(t.column("sig").to_pylist())], pa.binary())})

    packed = dealt.select("tile", "run", "unit", "class", "n", "sig").groupBy("tile", "run").applyInArrow(pack, "tile long, run int, units binary, classes binary, ns binary, sigs binary")
    spread = checkpoint(packed).withColumn("_run", F.explode(F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in near]), F.col("run") + 1)))
    spread = spread.withColumn("_split", F.explode(F.sequence(F.lit(0), F.element_at(splits, F.col("_run") + 1) - 1))).withColumn("_other", number("_run", F.col("_split")))
    pairs = sum(found[i][4] * found[j][4] if i != j else found[i][4] * (found[i][4] + 1) // 2 for i, x in enumerate(near) for j in x if j >= i)
    side = (F.col("tile") > F.col("_other")).cast("int")
    return spread.select(F.least("tile", "_other").alias("tile"), F.greatest("tile", "_other").alias("other"), side.alias("side"), "units", "classes", "ns", "sigs"), pairs


def traversed(units: DataFrame, percent: int, found_in, ddl: str) -> DataFrame | None:
    """What found_in(tile, other, left, right) yields of every pair of tiles; None without any."""
    rows, pairs = tiles_of(units, percent)
    if not pairs:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        waiting: dict[tuple, dict] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("tile", "other", "side")}
                row |= {c: np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("units", "classes", "ns")}
                row |= {"n": row["ns"], "sigs": batch.column("sigs")[i].as_buffer()}
                key = (row["tile"], row["other"])
                if row["tile"] == row["other"]:
                    yield from found_in(*key, row, row)
                elif key in waiting:
                    one = waiting.pop(key)
                    yield from found_in(*key, *((one, row) if row["side"] else (row, one)))
                else:
                    waiting[key] = row

    return rows.repartition(pairs, "tile", "other").mapInArrow(run, ddl)


def forest_of(percent: int):
    """found_in that gives a spanning forest (u, v) of the pairs that pass."""

    def found(tile: int, other: int, left: dict, right: dict) -> Iterator[pa.RecordBatch]:
        same = tile == other
        names = left["units"] if same else np.concatenate([left["units"], right["units"]])
        forest = Forest(len(names))
        for a, b in passing(left, right, same, percent):
            forest.add(a, b if same else b + len(left["units"]))
        if forest.edges:
            ends = names[np.array(forest.edges)]
            yield pa.record_batch({"u": ends.min(1), "v": ends.max(1)})

    return found


def apart_of(percent: int, block: int = BLOCK):
    """found_in that gives the documents with a partner that passes in another class: block (tile, other, i, j), side, unit, class."""

    def found(tile: int, other: int, left: dict, right: dict) -> Iterator[pa.RecordBatch]:
        same = tile == other
        i_of, j_of = np.cumsum(left["n"]) // block, np.cumsum(right["n"]) // block
        wide = np.int64(j_of[-1]) + 1
        members: list[list[np.ndarray]] = [[], []]
        for a, b in passing(left, right, same, percent):
            differ = left["classes"][a] != right["classes"][b]
            a, b = a[differ], b[differ]
            if len(a):
                i, j = i_of[a], j_of[b]
                if same:  # rows of one tile: the earlier block first
                    swap = i > j
                    a, b, i, j = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, j, i), np.where(swap, i, j)
                one = (i == j) if same else np.zeros(len(a), bool)
                key = i * wide + j
                members[0].append(np.unique(np.stack([np.concatenate([key, key[one]]), np.concatenate([a, b[one]])], 1), axis=0))
                members[1].append(np.unique(np.stack([key[~one], b[~one]], 1), axis=0))
        for side, of in enumerate((left, right)):
            if members[side] and len(held := np.unique(np.concatenate(members[side]), axis=0)):
                key, at = held[:, 0], held[:, 1]
                yield pa.record_batch({"tile": np.full(len(at), tile), "other": np.full(len(at), other), "i": key // wide, "j": key % wide, "side": pa.array(np.full(len(at), side), pa.int32()), "unit": of["units"][at], "class": of["classes"][at]})

    return found


def block_links(sets: list[np.ndarray], known: list[int], sides: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Places of links that join the known classes of a block as all its links do; with two sides, across them."""
    parent = {c: c for c in known}

    def root(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, every = np.repeat(np.arange(len(sets)), size)[order], every[order]
    label, two = np.array([root(c) for c in known]), bool(sides.any())
    for x in np.flatnonzero(sides == 0).tolist():
        may = (sides == 1) if two else (np.arange(len(sets)) > x)
        may &= (label != label[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
        if not may.any():
            continue
        start, end = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
        many = end - start
        spots = np.repeat(start - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        both = np.bincount(owner[spots], minlength=len(sets))
        joined = False
        for y in np.flatnonzero(may & enough(both, size + size[x], percent)).tolist():
            u, v = root(known[x]), root(known[y])
            if u != v:
                parent[max(u, v)] = min(u, v)
                joined = True
                yield x, y
        if joined:
            label = np.array([root(c) for c in known])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the written pairs (u, v) that are links on their whole sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x", "y"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(enough(both, len(x) + len(y), percent)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    few = if_small(pairs, 16)
    both = few.join(sets.select(F.col("unit").alias("u"), F.col("whole").alias("x")), "u").join(sets.select(F.col("unit").alias("v"), F.col("whole").alias("y")), "v")
    return sized(both.select("u", "v", "x", "y").mapInArrow(verify, "u long, v long"))


def verified_blocks(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) within the blocks of `apart`, enough to join their classes."""
    key = ["tile", "other", "i", "j"]
    rows = apart.join(sets, "unit").repartition(*key).sortWithinPartitions(*key, "side", "unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len({c for _, _, c, _ in held}) > 1:
                names, sides, known, sets = zip(*held)
                found = list(block_links(list(sets), list(known), np.array(sides), percent))
                if found:
                    yield pa.record_batch({"u": pa.array([names[a] for a, _ in found], pa.int64()), "v": pa.array([names[b] for _, b in found], pa.int64())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, "unit", "side", "class")]
            for at, (*name, unit, side, known) in enumerate(zip(*columns)):
                if name != now:
                    yield from done()
                    now, held = name, []
                held.append((unit, side, known, np.frombuffer(batch.column("whole")[at].as_py(), np.uint64)))
        yield from done()

    return sized(rows.select(*key, "unit", "side", "class", "whole").mapInArrow(compare, "u long, v long"))


def jaccard_classes(docs: DataFrame, percent: int = 90, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id: links are Jaccard similarities of at least `percent` percent."""
    rows, printed = prints(docs, width, id_col, text_col)
    printed = checkpoint(printed)
    # Nulls are last: a null id names a class only if all are null.
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "tag")).alias("lead")
    units = printed.filter("n > 0").groupBy("d1", "d2").agg(lead, F.min("n").alias("n"), F.min("sig").alias("sig"), (F.count("*") > 1).alias("several"))
    units = checkpoint(units.select("d1", "d2", "n", "sig", F.col("lead.id").alias("first"), F.col("lead.digest").alias("digest"), F.col("lead.tag").alias("tag"), "several"))
    # Numbers by place in a written table stay the same when a lost part is computed again.
    units = checkpoint(units.withColumn("unit", F.monotonically_increasing_id()))
    sets_of = lambda needed: unit_sets(rows, units.select("unit", "first", "digest", "tag", "several").join(needed, "unit", "left_semi"), width)
    roots = units.select(F.col("unit").alias("node"), F.col("unit").alias("root")).limit(0)
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    forest = traversed(units.select("unit", F.col("unit").alias("class"), "n", "sig"), percent, forest_of(percent), "u long, v long")
    if forest is not None:
        pairs = sized(forest.distinct())
        links = verified(pairs, sets_of(pairs.select(F.explode(F.array("u", "v")).alias("unit")).distinct()), percent).toDF("a", "b")
        roots = components(links)
        # A document with a partner that passes is in the forest of their tiles; where a whole class of the forests ended
        # up in one class of links, none of its pairs joins two.
        tried = components(pairs.toDF("a", "b")).select(F.explode(F.array("node", "root")).alias("unit"), F.col("root").alias("tried")).distinct()
        known = units.join(tried, "unit").join(roots.withColumnRenamed("node", "unit"), "unit", "left").select("unit", "tried", F.coalesce("root", "unit").alias("class"), "n", "sig")
        mixed = known.groupBy("tried").agg((F.min("class") < F.max("class")).alias("mixed")).filter("mixed").select("tried")
        known = known.join(mixed, "tried", "left_semi").select("unit", "class", "n", "sig")
        apart = traversed(checkpoint(known), percent, apart_of(percent), "tile long, other long, i long, j long, side int, unit long, class long")
        if apart is not None:
            apart = checkpoint(apart)
            more = verified_blocks(apart, sets_of(apart.select("unit").distinct()), percent)
            roots = components(links.unionByName(more.toDF("a", "b")))
    whole = units.select("unit", "d1", "d2", "first").join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    named = whole.join(least, "root").select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "component_id")
    linked = printed.filter("n > 0").join(named, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))).select("id", "n", "component_id")
    alone = printed.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


OP13_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS MATERIALIZED (SELECT doc_id, list_sort(list(hash(g))) AS k FROM s GROUP BY doc_id),
heads AS MATERIALIZED (SELECT k, min(doc_id) AS head FROM sets GROUP BY k),
same AS MATERIALIZED (SELECT sets.doc_id, head FROM sets JOIN heads USING (k)),
r AS MATERIALIZED (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id) WHERE s.doc_id IN (SELECT head FROM heads)),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS MATERIALIZED (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (
  SELECT head AS x, head AS y FROM heads UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
), least_of AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least_of.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN same USING (doc_id) LEFT JOIN least_of ON same.head = least_of.x
"""


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
