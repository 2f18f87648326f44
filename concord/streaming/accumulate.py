"""Micro-batches of raw rows merged into the store: the same merge as in batch, in foreachBatch.

State lives in the store's tables, not in the stream, so a restart goes on from the last committed version. Nothing is
too late but what is dated before `before`, which each batch lets expire. A batch that is delivered again changes nothing but times of observation, because a stored source
and checksum is only refreshed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from concord.operators.observe import observations
from concord.operators.store import Store
from concord.session import checkpoint


def accumulate(raw: DataFrame, store: Store, progress: str, available_now: bool = True, trust: dict[str, float] | None = None, before: Callable[[], str] | str | None = None, by_id: bool = False) -> StreamingQuery:
    """before: the date before which events expire with each batch, or what gives it then. by_id: rows are told apart by
    id, so that the stored events are those of one batch over all rows (see merge_observations)."""

    def merge(batch: DataFrame, number: int) -> None:
        # Written once: the merge reads a batch several times.
        rows = checkpoint(observations(batch, trust))
        if not rows.isEmpty():
            store.upsert(rows, f"batch_{number:09d}", before() if callable(before) else before, by_id=by_id)

    writer = raw.writeStream.foreachBatch(merge).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
