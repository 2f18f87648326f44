"""Token counts of whole texts: Arrow batches in, lengths out.

A text is split at boundaries that the tokenizer's own pre-tokenizer always makes, so the pieces' counts add up to
the text's count however long it is. Each distinct piece is encoded once for a batch and then remembered, within a
bounded cache; texts that contain a special token's string are first cut around it, as the library does.

Nulls count as empty texts; empty texts have no tokens; repeated rows are counted like others; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import byte_batches, held, table, tokenizer_file

#: Unicode white space as the tokenizers' patterns take it; str.isspace() has four control characters more.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level pattern with its kinds of non-space merged: its boundaries are a subset of that pattern's.
BYTE_LEVEL = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Letters, perhaps after a space, perhaps before ASCII punctuation without apostrophe and underscore: two pre-tokens at most.
LETTERS = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-^`{-~]*)")
WORDS = re.compile(f"[^{SPACE}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
SEGMENT = 1 << 20


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def words(text: str) -> list[str]:
    """Runs of non-space, as the tokenizers' patterns have them."""
    return WORDS.findall(text) if ODD_SPACE.search(text) else text.split()


class PieceCache:
    """What `make` gives for each distinct piece, for many pieces at once; emptied when it holds `room` pieces."""

    def __init__(self, make: Callable[[list[str]], list], room: int = 1_000_000, longest: int = 48):
        self.make, self.room, self.longest, self.held = make, room, longest, {}

    def all(self, pieces: list[str]) -> list:
        found = list(map(self.held.get, pieces))
        if None not in found:
            return found
        new = list({p for p, v in zip(pieces, found) if v is None})
        if len(self.held) + len(new) > self.room:
            self.held.clear()
        got = dict(zip(new, self.make(new)))
        self.held.update((p, v) for p, v in got.items() if len(p) <= self.longest)
        return [got[p] if v is None else v for p, v in zip(pieces, found)]


class Counter:
    """Counts the tokens of texts for one tokenizer file (.json for tokenizers, .model for sentencepiece)."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.special, self.split = [], None
            self.whole = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            return
        tok = load_tokenizer(path)
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.whole = lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and norm is None
        odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", []))
        self.split = BYTE_LEVEL.findall if plain and not odd else None
        vocabulary = tok.get_vocab()
        first = np.zeros(max(vocabulary.values()) + 1, bool)
        first[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

        def joined(cores: list[str]) -> list[int] | None:
            at = np.flatnonzero(first[ids := np.array(tok.encode("".join(cores), add_special_tokens=False).ids)])
            return np.diff(at, append=len(ids)).tolist() if len(at) == len(cores) else None

        self.cache = PieceCache(lambda pieces: by_letters(pieces, True, self.whole, joined))

    def count(self, texts: list[str]) -> list[int]:
        if self.split is None:
            return self.whole(texts)
        out = []
        for text in texts:
            parts = self.cut.split(text) if self.special and any(s in text for s in self.special) else [text]
            n = 0
            for i, part in enumerate(parts):
                if i % 2:
                    n += 1
                else:
                    for piece in segments(part):
                        n += sum(self.cache.all(self.split(piece)))
            out.append(n)
        return out


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about `most` characters, cut before a space between two non-spaces; one part where there is none."""
    at = 0
    safe = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
    while len(text) - at > most:
        hit = safe.search(text, at + most)
        if not hit:
            break
        yield text[at : hit.start()]
        at = hit.start()
    yield text[at:] if at else text


def by_letters(pieces: list[str], space: bool, whole: Callable[[list[str]], list], joined: Callable[[list[str]], list | None]) -> list:
    """What `whole` gives for each piece, where letters and the punctuation after them are separate pre-tokens.

    Encoding a word alone costs several times the word itself, so all that are letters (after one space, if `space`)
    go through `joined` as one text; that gives a result for each or None if the text's tokens don't part as expected.
    """
    found = [m if (m := LETTERS.fullmatch(p)) and (p[0] == " ") == space else None for p in pieces]
    cores = list({m[1] for m in found if m})
    got = joined(cores) if cores else []
    if got is None:
        return whole(pieces)
    core, rest = dict(zip(cores, got)), list({p if m is None else m[2] for p, m in zip(pieces, found) if m is None or m[2]})
    other = dict(zip(rest, whole(rest))) if rest else {}
    return [other[p] if m is None else core[m[1]] + other[m[2]] if m[2] else core[m[1]] for p, m in zip(pieces, found)]


def counter(path: str) -> Counter:
    """One for each worker process, kept between batches and tasks."""
    return held("token_counts", path, lambda: Counter(path))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens, and over_limit (n_tokens > limit)."""
    path = tokenizer_file(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in byte_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.record_batch({"id": batch.column("id"), "n_tokens": pa.array(own.count(texts), pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64())})

    return rows.mapInArrow(lengths, f"id {kind}, n_tokens long, n_bytes long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
