"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > g) = sigmoid(w . x - threshold_g): one weight vector over hashed text features, shared by all grades, and
ordered thresholds. The expected grade is the lowest grade plus the sum over the grades' steps; the tail probability
P(grade >= cut) selects. It is fitted on at most `sample` rated documents, those with the least hashes of their ids,
by full-batch Adam on the driver, to which a document's features go summed by bucket, so at most 2**bits numbers.

Features: lower-case words (sub-linear frequency, unit length), word shapes (share of words), and bands of the shares of
upper case, symbols, distinct words and repeated lines. The whole text counts.

Nulls are empty texts and are scored like them. Without any rating of at least two grades, every document has the
lowest grade there is (or null without any) and tail probability 1, so none is rejected. Repeated rows get equal
results; a document with several ratings counts for each, within the sample; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import byte_batches, held, table

BITS = 18
SAMPLE = 6000
ROOM = 400_000
SHAPES = [(re.compile(p), s) for p, s in (("[A-ZÀ-ÖØ-Þ]+", "A"), ("[a-zß-öø-ÿ]+", "a"), ("[0-9]+", "0"))]


class Features:
    """Hashed features of texts; words' numbers are remembered up to ROOM words."""

    def __init__(self, bits: int):
        self.mask, self.seen = (1 << bits) - 1, {}

    def number(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "surrogatepass")) & self.mask

    def word(self, word: str) -> int:
        shape = word
        for pattern, sign in SHAPES:
            shape = pattern.sub(sign, shape)
        got = self.number("w:" + word.lower()) << 32 | self.number("s:" + shape[:8])
        if len(self.seen) >= ROOM:
            self.seen.clear()
        if len(word) < 48:
            self.seen[word] = got
        return got

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        both = np.fromiter((self.seen.get(w) or self.word(w) for w in counts), np.int64, len(counts))
        tf = np.fromiter(counts.values(), np.float64, len(counts))
        weight = 1 + np.log(tf) if len(tf) else tf
        weight = weight / max(np.sqrt((weight**2).sum()), 1e-9)
        share = tf * (3.0 / max(1, len(words)))
        lines = text.split("\n")
        bands = {
            "upper": sum(map(str.isupper, counts)) / max(1, len(counts)),
            "symbols": 1 - sum(map(str.isalpha, counts)) / max(1, len(counts)),
            "distinct": len(counts) / max(1, len(words)),
            "lines": len(set(lines)) / len(lines),
            "length": min(1.0, np.log2(1 + len(words)) / 20),
        }
        fixed = [self.number(f"{k}:{int(10 * v)}") for k, v in bands.items()]
        index = np.concatenate([both >> 32, both & 0xFFFFFFFF, np.array(fixed, np.int64)])
        return index, np.concatenate([weight, share, np.full(len(fixed), 0.5)])

    def summed(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """As `of`, with one entry for each bucket: 2**bits at most, however long the text is."""
        index, value = self.of(text)
        index, at = np.unique(index, return_inverse=True)
        return index, np.bincount(at, value, len(index))


def features(bits: int) -> Features:
    return held("quality", bits, lambda: Features(bits))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Ordinal:
    """Weights and ordered thresholds; grades are numbered from 0."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > g) for each g but the last, by row."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, bits: int, steps: int = 160, rate: float = 0.1, ridge: float = 2e-5) -> Ordinal:
        size = 1 << bits
        at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        used, index = np.unique(index, return_inverse=True)
        shares = np.array([(grades > g).mean() for g in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
        start = -np.log(shares / (1 - shares))
        # thresholds: the first, then logarithms of the gaps, so they stay ordered.
        p = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        m, s, k = np.zeros_like(p), np.zeros_like(p), len(used)
        for t in range(1, steps + 1):
            gaps = np.exp(p[k + 1 :])
            cuts = np.concatenate([[-np.inf], p[k] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
            score = np.bincount(at, p[:k][index] * value, len(rows))
            low, high = sigmoid(score - cuts[grades]), sigmoid(score - cuts[grades + 1])
            chance = np.maximum(low - high, 1e-9)
            d_low, d_high = low * (1 - low) / chance, high * (1 - high) / chance
            d_score = -(d_low - d_high) / len(rows)
            d_cut = np.bincount(grades, d_low, n_grades + 1)[1:n_grades] - np.bincount(grades + 1, d_high, n_grades + 1)[1:n_grades]
            d_cut = d_cut / len(rows)
            after = np.cumsum(d_cut[::-1])[::-1]
            g = np.concatenate([np.bincount(index, d_score[at] * value, k) + ridge * p[:k], after[:1], after[1:] * gaps])
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        weights = np.zeros(size, np.float32)
        weights[used] = p[:k]
        return cls(weights, p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))]))


def rated(docs: DataFrame, ratings: DataFrame, grade_col: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """At most `sample` rows (text, grade), by hash of the id."""
    chosen = ratings.filter(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(grade_col).cast("long").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = texts.join(F.broadcast(chosen), "_id")  # `sample` rows at most
    return both.select("text", "grade", F.xxhash64("_id", "text", "grade").alias("order"))


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS) -> tuple[Ordinal | None, list[int]]:
    """The model and the grades that it knows, in order."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = features(bits)
        for batch in byte_batches(batches, "text"):
            got = [own.summed(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"grade": batch.column("grade"), "order": batch.column("order"), "i": pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), "v": pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))})

    rows = rated(docs, ratings, grade_col, id_col, text_col, sample)
    found = rows.mapInArrow(extract, "grade long, order long, i array<int>, v array<float>").orderBy("order").limit(sample).toArrow()
    values = found.column("grade").to_numpy()
    grades = sorted(set(values.tolist()))
    if len(grades) < 2:
        return None, grades
    lists = lambda c: [x.values.to_numpy() for x in found.column(c)]
    model = Ordinal.fit(list(zip(lists("i"), [v.astype(np.float64) for v in lists("v")])), np.searchsorted(grades, values), len(grades), bits)
    return model, grades


def score(docs: DataFrame, model: Ordinal | None, grades: list[int], cut: int | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """Per row: the id (or the columns `keep`), expected_grade, tail_probability of `cut` (default: the second lowest grade), selected."""
    columns = keep or [id_col]
    if model is None:
        return docs.select(*columns, F.lit(float(grades[0]) if grades else None).cast("double").alias("expected_grade"), F.lit(1.0).alias("tail_probability"), F.lit(True).alias("selected"))
    step = max(1, int(np.searchsorted(grades, cut)) if cut is not None else 1)
    weights, thresholds, gaps = docs.sparkSession.sparkContext.broadcast(model.weights), model.thresholds, np.diff(grades)
    low = float(grades[0])
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = docs.select(*columns).schema

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w, known = features(bits), weights.value, Ordinal(weights.value, thresholds)
        for batch in byte_batches(batches, "text"):
            got = [own.of(t) for t in batch.column("text").to_pylist()]
            tails = known.tails(np.array([float(w[i] @ v) for i, v in got]))
            yield pa.record_batch({"row": batch.column("row"), "expected_grade": low + tails @ gaps, "tail_probability": tails[:, step - 1]})

    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    out = rows.mapInArrow(grade, f"row struct<{kind}>, expected_grade double, tail_probability double")
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], "expected_grade", "tail_probability", (F.col("tail_probability") >= threshold).alias("selected"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, grades = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, grades)
