"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case words. The examples are a bounded sample of labelled documents, and all their words are the
vocabulary; document frequencies come from all documents. A document's vector holds its terms' (1 + log tf) * idf, at
unit length, where the idf of a term that goes with label 1 among the examples beyond chance is raised by one plus the
lower bound of its log odds ratio. Words that no example has are left out. Examples with equal vectors are one group
with its counts of labels.

Search: a term's postings lie in blocks of groups, with the highest weight in each block; the blocks of a term that fills
over an eighth of them are stored as one dense row. The dense rows are added first; the k-th best sum so far is a bound
from below, and blocks that cannot reach it by their highest weights are skipped. The others are scored exactly. The k
nearest groups vote with weight count / (0.05 + distance), with the base rate as a prior; documents without any term get
the rate of such examples. Scores are then calibrated by isotonic regression over the examples' own leave-one-out votes.

Nulls are empty texts and, like empty texts, are scored as documents without terms. Labels are those of the rows that
`learn` admits; null labels and labels without a document don't count, of several labels of an id the highest does, and
of several texts of an id that with the least digest; without labels all scores are 0. Ties between groups go to the one
with the smaller vector. Repeated rows get equal scores. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import byte_batches, checkpoint, release, table

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled documents that are learned from, those with the least hashes of their ids.
EXAMPLES = 4000
NEIGHBOURS = 16
BLOCK = 64
EVIDENCE = 3


def word_counts(text: str) -> Counter:
    return Counter(LETTERS.findall(text.lower()))


def vector(text: str, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the text's known words, ascending, and their counts."""
    words = LETTERS.findall(text.lower())
    found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
    return np.unique(found[found >= 0], return_counts=True)


def sampled(labels: DataFrame, label_col: str, id_col: str, learn: Column, most: int) -> DataFrame:
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(learn, F.lit(False)))
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return own.orderBy(F.xxhash64("id"), "id").limit(most)


def examples_of(rows: DataFrame, sample: DataFrame) -> tuple[list[str], list[tuple]]:
    """All words of the sampled documents, and (id, terms, counts, label) of each in order of id; as many as the sample
    has at most. Terms are the words' places, ascending. Words reach the driver in Arrow columns and become numbers there."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            got = [word_counts(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), "words": pa.array([list(c) for c in got], pa.list_(pa.string())), "counts": pa.array([list(c.values()) for c in got], pa.list_(pa.int64()))})

    both = rows.join(F.broadcast(sample), "id")  # EXAMPLES rows at most
    one = both.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", "label", F.col("t.text").alias("text"))
    found = one.mapInArrow(split, f"id {rows.schema['id'].dataType.simpleString()}, label int, words array<string>, counts array<long>").toArrow().combine_chunks()
    known = pa.array(sorted({w for c in found.column("words").chunks for w in pc.unique(c.flatten()).to_pylist()}), pa.string())
    out = []
    for batch in found.to_batches():
        words = batch.column("words")
        terms, counts = pc.index_in(words.flatten(), value_set=known).to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int32)
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        for name, label, start, end in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist()):
            order = np.argsort(terms[start:end])
            out.append((name, terms[start:end][order], counts[start:end][order], label))
    return known.to_pylist(), sorted(out, key=lambda e: e[0])


def document_frequencies(rows: DataFrame, words: list[str]) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that have each of the words."""
    known = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number, held, total = known.value, np.zeros(len(words), np.int64), 0
        for batch in byte_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                total += 1
                held[[number[w] for w in set(LETTERS.findall(text.lower())) if w in number]] += 1
        terms = np.flatnonzero(held)
        yield pa.record_batch({"term": pa.array(np.append(terms, -1), pa.int32()), "n": pa.array(np.append(held[terms], total), pa.int64())})

    found = rows.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per word of the examples
    known.destroy()
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(len(words), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def association(examples: list[tuple], size: int) -> np.ndarray:
    """By term, how much its examples go with label 1: the lower bound of the log odds ratio, or 0."""
    yes, no = np.zeros(size), np.zeros(size)
    for _, terms, _, label in examples:
        (yes if label else no)[terms] += 1
    all_yes = sum(1 for e in examples if e[3])
    all_no = len(examples) - all_yes
    a, b, c, d = yes + 0.5, no + 0.5, all_yes - yes + 0.5, all_no - no + 0.5
    return np.maximum(0.0, np.log(a * d / (b * c)) - 2.6 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one after the other, and each range's size."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size), size


class Index:
    """Groups of equal example vectors with postings in blocks and each block's highest weight, by term."""

    def __init__(self, idf: np.ndarray, examples: list[tuple], k: int = NEIGHBOURS, dense: float = 0.125):
        self.idf, self.k = idf, k
        groups: dict[tuple, list[tuple[int, int]]] = {}
        for name, terms, counts, label in examples:
            groups.setdefault((tuple(np.asarray(terms).tolist()), tuple(np.asarray(counts).tolist())), []).append((label, name))
        empty = groups.pop(((), ()), [])
        order = sorted(groups)
        self.groups = {key: g for g, key in enumerate(order)}
        self.total = np.array([len(groups[key]) for key in order], np.float64)
        self.positive = np.array([sum(label for label, _ in groups[key]) for key in order], np.float64)
        self.names = [sorted(name for _, name in groups[key])[:EVIDENCE] for key in order]
        n, pos = self.total.sum() + len(empty), self.positive.sum() + sum(label for label, _ in empty)
        self.base = float(pos / n) if n else 0.0
        self.silent = float((sum(label for label, _ in empty) + self.base) / (len(empty) + 1))
        self.blocks = -(-len(order) // BLOCK)
        self.lists(order, dense)
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        votes = [(self.vote(key, own=True, label=label), label) for key in order for label, _ in groups[key]]
        if votes:
            self.curve = isotonic(np.array([v for v, _ in votes]), np.array([y for _, y in votes], np.float64))

    def lists(self, order: list[tuple], dense: float) -> None:
        places = self.blocks * BLOCK
        term = np.concatenate([np.array(t, np.int64) for t, _ in order]) if order else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(order)), [len(t) for t, _ in order])
        weight = np.concatenate([self.weights(t, c) for t, c in order]) if order else np.zeros(0)
        often = np.bincount(term, minlength=len(self.idf)) > max(1, dense * len(order))
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), places))
        full = often[term]
        self.rows[self.row[term[full]], group[full]] = weight[full]
        term, group, weight = term[~full], group[~full], weight[~full]
        at = np.lexsort((group, term))
        self.group, self.weight = group[at], weight[at]
        # One entry for each block of a term: where its postings start, and the highest weight.
        key = term[at] * max(1, self.blocks) + self.group // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.start, self.end = first, np.append(first[1:], len(key))[: len(first)]
        self.highest = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block = key[first] % max(1, self.blocks)
        self.entries = np.searchsorted(key[first] // max(1, self.blocks), np.arange(len(self.idf) + 1))

    def weights(self, terms, counts) -> np.ndarray:
        w = (1 + np.log(np.array(counts, np.float64))) * self.idf[np.asarray(terms, np.int64)]
        return w / max(float(np.sqrt((w * w).sum())), 1e-12)

    def dense_sums(self, queries: list[tuple]) -> np.ndarray:
        """What the dense rows add to all groups, by query (terms, weights): one product for all queries."""
        held = np.zeros((len(queries), len(self.rows)))
        for i, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            held[i, row[row >= 0]] = weights[row >= 0]
        return held @ self.rows

    def nearest(self, terms, counts, without: int = -1, q: np.ndarray | None = None, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest groups and their cosines, in order; all that have a term in common, if fewer."""
        if not self.blocks or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        t = np.asarray(terms, np.int64)
        q = self.weights(t, counts) if q is None else q
        sums = self.dense_sums([(t, q)])[0] if sums is None else sums.copy()
        rarely = self.row[t] < 0
        entry, size = ranges(self.entries[t[rarely]], self.entries[t[rarely] + 1])
        rare = np.repeat(q[rarely], size)
        bound = sums.reshape(self.blocks, BLOCK).max(1) + np.bincount(self.block[entry], rare * self.highest[entry], self.blocks)
        # One place more, for the group that is left out.
        least = float(np.partition(sums, len(sums) - self.k - 1)[len(sums) - self.k - 1]) if len(sums) > self.k + 1 else 0.0
        alive = (bound >= least - 1e-12) & (bound > 0)
        if not alive.all():
            kept = alive[self.block[entry]]
            entry, rare = entry[kept], rare[kept]
        post, size = ranges(self.start[entry], self.end[entry])
        sums += np.bincount(self.group[post], np.repeat(rare, size) * self.weight[post], len(sums))
        sums *= np.repeat(alive, BLOCK)
        if without >= 0:
            sums[without] = 0
        ids = np.flatnonzero(sums)
        if len(ids) > self.k:
            cut = np.partition(sums[ids], len(ids) - self.k)[len(ids) - self.k]
            ids = ids[sums[ids] >= cut - 1e-9]
        ids = ids[np.lexsort((ids, -np.round(sums[ids], 12)))[: self.k]]
        return ids, sums[ids]

    def shares(self, ids: np.ndarray, cosines: np.ndarray, n: np.ndarray, positive: np.ndarray) -> float:
        w = 1 / (0.05 + np.maximum(0.0, 1 - cosines))
        return float(((w * positive).sum() + self.base) / ((w * n).sum() + 1))

    def vote(self, key: tuple, own: bool = False, label: int = 0) -> float:
        """The share of label 1 among the nearest, before calibration; `own`: without one example of this vector and label."""
        ids, cosines = self.nearest(*key)
        n, positive = self.total[ids].copy(), self.positive[ids].copy()
        if own:
            here = ids == self.groups[key]
            n[here] -= 1
            positive[here] -= label
        return self.shares(ids, cosines, n, positive)

    def scores(self, queries: list[tuple], step: int = 128) -> Iterator[tuple[float, list[int]]]:
        for i in range(0, len(queries), step):
            part = queries[i : i + step]
            weights = [self.weights(*q) for q in part]
            sums = self.dense_sums([(terms, w) for (terms, _), w in zip(part, weights)])
            yield from (self.score(*q, w, s) for q, w, s in zip(part, weights, sums))

    def score(self, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> tuple[float, list[int]]:
        if not len(terms):
            return self.silent, []
        ids, cosines = self.nearest(terms, counts, q=weights, sums=sums)
        value = self.shares(ids, cosines, self.total[ids], self.positive[ids])
        if self.curve is not None:
            value = float(np.interp(value, *self.curve))
        return min(1.0, max(0.0, value)), [n for g in ids[:EVIDENCE] for n in self.names[g]][:EVIDENCE]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: a rising curve through the means, with one example of doubt at either end."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][0] == pools[-1][0]):
            p, q = pools.pop(), pools.pop()
            n = p[2] + q[2]
            pools.append([(p[0] * p[2] + q[0] * q[2]) / n, (p[1] * p[2] + q[1] * q[2]) / n, n])
    return np.array([p[0] for p in pools]), np.array([(p[1] * p[2] + 0.5) / (p[2] + 1) for p in pools])


def score(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, examples: int = EXAMPLES, keep: list[str] | None = None) -> DataFrame:
    """Per row: the id (or the columns `keep`), score, predicted, and evidence, ids of nearest examples.

    learn: which rows of labels may be learned from.
    """
    columns = keep or [id_col]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text)
    words, own = examples_of(rows, checkpoint(sampled(labels, label_col, id_col, learn, examples)))
    number, index = {w: i for i, w in enumerate(words)}, None
    if words:
        total, often = document_frequencies(rows, words)
        index = Index((np.log((1 + total) / (1 + often)) + 0.1) * (1 + association(own, len(words))), own)
        index.groups = {}
    base = float(np.mean([label for *_, label in own])) if own else 0.0
    shared = docs.sparkSession.sparkContext.broadcast((number, index))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number, index = shared.value
        for batch in byte_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            out = list(index.scores([vector(t, number) for t in texts])) if index is not None else [(base, [])] * len(texts)
            yield pa.record_batch({"row": batch.column("row"), "score": pa.array([s for s, _ in out], pa.float64()), "evidence": pa.array([e for _, e in out], pa.list_(pa.int64()))})

    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    out = docs.select(F.struct(*columns).alias("row"), text).mapInArrow(judge, f"row struct<{kind}>, score double, evidence array<long>")
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
