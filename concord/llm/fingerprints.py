"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame operations only.

A text's elements are the digests of its distinct paragraph pieces: a line, or, where a line is long, its sentences, as
many together as make LEAST characters, and at most MOST characters. Pieces end where sentences end, so after an edit
the same pieces are found again. A sketch has TABLES tables of cells; an element goes to one cell of each, where its
sign, its digest and a check value are summed (by exclusive or).

The fingerprint is the sketch of all of a text's elements with CELLS cells a table, after their number, as hexadecimal
text. Two texts' sketches subtract cell by cell: common elements vanish, and peeling the cells that hold one element
recovers every digest that only one text has, with its side. The two fingerprints are subtracted and peeled first. A pair
that doesn't come out empty is tried again with tables for as many elements as both texts have, then with tables of twice
the size each time, until it does; so a pair's result is never one of an incomplete peeling.
Likeness is the share of common elements in all of both texts' elements; of two texts without any it is 1.

Nulls are empty texts; an empty text has empty cells. Rows with equal ids are documents of their own, in order of text
digest, so a repeated row is followed by its copy; a null id comes first; a lone document follows itself. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import checkpoint, table

LEAST, MOST = 64, 192
TABLES = 3
#: Cells in each table of a fingerprint.
CELLS = 6
#: Steps of peeling, one table each: of a fingerprint, and of a larger sketch.
STEPS, LARGE_STEPS = 12, 5
TRIES = 20
KEY = ["bucket", "rn"]


def elements(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(f"[^\\n]{{{LEAST},{MOST - 1}}}?[.!?](?= )|[^\\n]{{1,{MOST}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def check(digest: str) -> str:
    return f"(xxhash64({digest}, 99) & 4294967295L)"


def cell(digest: str, j: int | str, size: int | str) -> str:
    return f"CAST(pmod(xxhash64({digest}, {j}), {size}) + {j} * {size} AS INT)"


def cell_sum(n: str, x: str, c: str) -> str:
    return f"named_struct('n', CAST({n} AS INT), 'x', {x}, 'c', {c})"


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def sketched(digests: str, size: int = CELLS) -> str:
    """SQL of a small sketch as an array of cells (n, x, c), for arrays of digests."""
    placed = f"transform({digests}, d -> named_struct('x', d, 'c', {check('d')}, " + ", ".join(f"'k{j}', {cell('d', j, size)}" for j in range(TABLES)) + "))"
    total = "aggregate(filter(every, e -> e.k{j} = {i}), " + cell_sum("0", "0L", "0L") + ", (a, e) -> " + cell_sum("a.n + 1", "a.x ^ e.x", "a.c ^ e.c") + ")"
    return let("every", placed, "array(" + ", ".join(total.format(j=j, i=j * size + i) for j in range(TABLES) for i in range(size)) + ")")


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> " + cell_sum("p.n - q.n", "p.x ^ q.x", "p.c ^ q.c") + ")"


def peeled(cells: str, size: int = CELLS, steps: int = STEPS) -> str:
    """SQL of the number of elements in which two sketches differ, from their subtracted cells; null if peeling leaves any.

    A step takes the cells of one table that hold one element each, so it takes no element twice.
    """
    pure = f"filter(transform(s.cells, (v, i) -> CASE WHEN abs(v.n) = 1 AND v.c = {check('v.x')} AND i = {cell('v.x', f'(t % {TABLES})', size)} THEN v END), v -> v IS NOT NULL)"
    placed = f"transform({pure}, p -> named_struct('p', p, 'at', array({', '.join(cell('p.x', j, size) for j in range(TABLES))})))"
    without = "aggregate(filter(found, f -> array_contains(f.at, i)), v, (a, f) -> " + cell_sum("a.n - f.p.n", "a.x ^ f.p.x", "a.c ^ f.p.c") + ")"
    step = let("found", placed, f"named_struct('cells', transform(s.cells, (v, i) -> {without}), 'count', s.count + size(found))")
    end = f"aggregate(sequence(0, {steps - 1}), named_struct('cells', {cells}, 'count', 0), (s, t) -> {step})"
    return let("z", end, "CASE WHEN forall(z.cells, v -> v.n = 0 AND v.x = 0 AND v.c = 0) THEN z.count END")


def summed(cells: DataFrame, by: list[str]) -> DataFrame:
    out = cells.groupBy(*by).agg(F.expr("CAST(sum(n) AS INT) AS n"), F.expr("bit_xor(digests) AS digests"), F.expr("bit_xor(checks) AS checks"))
    return out.filter("n != 0 OR digests != 0 OR checks != 0")


def peel(signed: DataFrame, by: list[str], steps: int = LARGE_STEPS) -> DataFrame:
    """signed (by..., size, digest, n: 1 or -1) sketched with `size` cells a table, subtracted and peeled: rows with cell
    -1 hold a recovered digest (found) and its side n; others are cells that remain. `size` depends on `by`."""
    by = [*by, "size"]
    spread = signed.selectExpr(*by, "n", "digest AS digests", f"{check('digest')} AS checks", f"explode(array({', '.join(cell('digest', j, 'size') for j in range(TABLES))})) AS cell")
    rows = summed(spread, [*by, "cell"]).selectExpr(*by, "cell", "n", "digests", "checks", "0L AS found")
    row = "named_struct('cell', {}, 'n', {}, 'digests', digests, 'checks', checks, 'found', {})"
    for step in range(steps):
        j = step % TABLES
        pure = f"abs(n) = 1 AND cell >= {j} * size AND cell < {j + 1} * size AND checks = {check('digests')} AND cell = {cell('digests', j, 'size')}"
        gone = [row.format(cell("digests", k, "size"), "-n", "0L") for k in range(TABLES) if k != j]
        out = f"explode(CASE WHEN {pure} THEN array({', '.join([row.format(-1, 'n', 'digests'), *gone])}) ELSE array({row.format('cell', 'n', 'found')}) END) AS r"
        rows = summed(rows.selectExpr(*by, out).select(*by, "r.*"), [*by, "cell", "found"])
    return rows


def differences(pairs: DataFrame, by: list[str], left: str, right: str, whole: bool = True, start: float = 2.0, tries: int = TRIES) -> DataFrame:
    """pairs (by..., two arrays of distinct digests) as by..., apart and, if `whole`, only_left and only_right (arrays).

    Pairs without a difference are left out. The first try has tables of `start` cells for each element of both texts,
    later ones twice as many as the one before, for the pairs that it left. A try's sums stay within its partitions.
    """
    many = F.size(left) + F.size(right)
    side = lambda c, s: F.transform(F.col(c), lambda x: F.struct(x.alias("digest"), F.lit(s).alias("n")))
    lists = [F.array_sort(F.collect_list(F.when((F.col("cell") == -1) & (F.col("n") == n), F.col("found")))).alias(c) for c, n in (("only_left", 1), ("only_right", -1))]
    done, todo, factor = None, pairs, start
    for _ in range(tries):
        sized = todo.select(*by, (F.ceil(many * factor) + 16).cast("int").alias("size"), left, right).repartition(*by)
        signed = sized.select(*by, "size", F.explode(F.concat(side(left, 1), side(right, -1))).alias("e")).select(*by, "size", "e.*")
        got = checkpoint(peel(signed, by).groupBy(*by).agg(F.count_if(F.col("cell") == -1).alias("apart"), (F.max("cell") < 0).alias("recovered"), *(lists if whole else [])))
        new = got.filter("recovered").drop("recovered")
        done = new if done is None else done.unionByName(new)
        failed = got.filter("NOT recovered").select(*by)
        if failed.isEmpty():
            return done
        todo, factor = todo.join(failed, by, "left_semi"), factor * 2
    raise RuntimeError(f"pairs that {tries} sizes of tables don't recover")


def diff(versions: DataFrame, id_col: str, before: str, after: str, start: float = 2.0) -> DataFrame:
    """Per version: the digests of paragraph pieces that only `before` and only `after` has. Pairs without any are left out."""
    rows = versions.select(F.col(id_col), elements(F.coalesce(F.col(before), F.lit(""))).alias("_a"), elements(F.coalesce(F.col(after), F.lit(""))).alias("_b"))
    return differences(rows, [id_col], "_a", "_b", start=start)


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, next_text in order of id (null first) and text digest, after the last the first; bucket, rn: a row's number.

    Texts are shuffled once, by ranges of ids and text digests whose first keys alone reach the driver, four for each shuffle partition. A
    range's first row also goes to the range before it, as the one that follows its last row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct((F.col(id_col).isNotNull()).alias("k0"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("k1"), F.xxhash64(text).alias("k2"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.select(key.alias("k")).repartitionByRange(4 * parts, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("first"))
    firsts = sorted(tuple(r["first"]) for r in ranges.collect())
    n = len(firsts)
    step = max(1, int(n**0.5))
    literal = lambda some: F.array(*[F.struct(F.lit(a).alias("k0"), F.lit(b).cast("long").alias("k1"), F.lit(c).cast("long").alias("k2")) for a, b, c in some or [(False, 0, 0)]])
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("k")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("k"))
    # Two steps of search: among every step-th first id, and among those from there to the next.
    rows = rows.withColumn("group", F.greatest(below(literal(firsts[::step])), F.lit(1)))
    rows = rows.withColumn("own", F.element_at(F.array(*[literal(firsts[i : i + step]) for i in range(0, max(1, n), step)]), F.col("group")))
    rows = rows.withColumn("bucket", F.greatest((F.col("group") - 1) * step + below("own") - 1, F.lit(0)))
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(1, n))).alias("bucket"), F.lit(1).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(F.array_contains("own", F.col("k")), F.array(home, guest)).otherwise(F.array(home))))
    order = Window.partitionBy("bucket").orderBy("guest", "k")
    rows = rows.select("id", "text", "k", "to.bucket", "to.guest").repartition(parts, "bucket")
    return rows.withColumn("rn", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).filter("guest = 0").select("id", "text", "next_text", "bucket", "rn")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and its likeness to that and the next document's."""
    both = beside_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    both = both.select("id", *KEY, "n_chars", "text", "next_text", edited.alias("edited"))
    rows = checkpoint(both.select("id", *KEY, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), elements(F.col("text")).alias("all"), elements(F.col("edited")).alias("edited_all"), elements(F.col("next_text")).alias("next_all")))

    cells = rows.select(*KEY, "all", "edited_all", "next_all", *[F.expr(sketched(c)).alias(f"{n}_cells") for n, c in (("own", "all"), ("edited", "edited_all"), ("next", "next_all"))])
    apart = checkpoint(cells.select(*KEY, *[F.expr(peeled(subtracted("own_cells", f"{n}_cells"))).alias(n) for n in ("edited", "next")]))
    pair = lambda which, c: F.struct(F.lit(which).alias("which"), F.col("all").alias("a"), F.col(c).alias("b"))
    again = apart.select(*KEY, F.explode(F.array(*[F.when(F.col(n).isNull(), F.lit(w)) for w, n in enumerate(("edited", "next"))])).alias("which")).filter("which IS NOT NULL")
    pairs = rows.select(*KEY, F.explode(F.array(pair(0, "edited_all"), pair(1, "next_all"))).alias("p")).select(*KEY, "p.*")
    found = differences(pairs.join(again, [*KEY, "which"], "left_semi"), [*KEY, "which"], "a", "b", whole=False)
    found = found.groupBy(*KEY).agg(F.max(F.when(F.col("which") == 0, F.col("apart"))).alias("edited_more"), F.max(F.when(F.col("which") == 1, F.col("apart"))).alias("next_more"))
    # Counts alone, so this is small beside the texts.
    apart = apart.join(found, KEY, "left").select(*KEY, *[F.coalesce(n, f"{n}_more", F.lit(0)).alias(f"{n}_apart") for n in ("edited", "next")])

    def shown(c: str) -> Column:
        value = lambda x, width: f"lpad(lower(hex({x})), {width}, '0')"
        return F.expr(f"concat({value(f'size({c})', 8)}, array_join(transform({sketched(c)}, v -> concat({value('v.n', 8)}, {value('v.x', 16)}, {value('v.c', 8)})), ''))")

    counted = [F.size(c).alias(f"{n}_n") for n, c in (("own", "all"), ("edited", "edited_all"), ("next", "next_all"))]
    prints = rows.select("id", *KEY, "n_chars", "edited_sha256", *counted, shown("all").alias("fingerprint"), shown("edited_all").alias("edited_fingerprint"))

    def likeness(n: str) -> Column:
        total, off = F.col("own_n") + F.col(f"{n}_n"), F.col(f"{n}_apart")
        return F.when(total > 0, (total - off) / (total + off)).otherwise(1.0)

    columns = [F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("edited").alias("near_edited"), likeness("next").alias("near_next")]
    return prints.join(apart, KEY).select(*columns)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
