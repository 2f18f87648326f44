"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import checkpoint, shared_dir, ship  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str):
    """A 64-bit key of a row that tells null from empty."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


#: A side of a join is broadcast only if its rows, counted first, are this many bytes at most.
BROADCAST_BYTES = 4 << 20


def if_small(small: DataFrame, row_bytes: int) -> DataFrame:
    """small (already computed), marked for broadcast if its counted rows are few bytes; else as it is, for a shuffled join."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


#: What a worker process keeps between tasks, for one operator at a time: (owner, key) -> value.
HELD: dict[tuple, object] = {}


def held(owner: str, key, make):
    """make(), kept in this worker until another operator keeps something."""
    if any(o != owner for o, _ in HELD):
        HELD.clear()
    if (owner, key) not in HELD:
        HELD[owner, key] = make()
    return HELD[owner, key]


def release() -> None:
    """Frees what this worker keeps; a function of this module, so that it reaches the worker's own HELD."""
    HELD.clear()


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `most` bytes of `column` each, and one row at least."""
    for batch in batches:
        size = batch.column(column).nbytes
        step = max(1, batch.num_rows * most // max(size, 1))
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            if step > 1 and part.num_rows > 1 and sum(len(x) for x in part.column(column).to_pylist() if x) > 2 * most:
                for k in range(part.num_rows):
                    yield part.slice(k, 1)
            else:
                yield part


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file by name; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
