"""An inbox folder watched as a stream: new images are read once, merged into the store, and moved out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.operators.observe import observations
from concord.operators.store import Busy, Store
from concord.session import checkpoint
from concord.sources.feeds import images, read_images, settle, vision_events

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, read: Callable[[str, bytes], str], store: Store, progress: str, today: str, processed: str, failed: str, owner: str = "inbox", at_once: int = 100, before: str | None = None) -> int | None:
    """Works off what the folder holds and returns the number of images that were read or failed; None if another run does.

    One run at a time holds the store's lease. The stream's checkpoint (progress) names the files that are done, so a file
    counts once even if it could not be moved; a run that is broken off begins its batch again, and a batch that is merged
    again changes nothing but times of observation. An image whose reader fails goes to `failed` and stops nothing.
    """
    done = []

    def merge(batch: DataFrame, number: int) -> None:
        results = checkpoint(read_images(batch, read))
        rows = checkpoint(observations(vision_events(results.filter("error IS NULL"), today)))
        if not rows.isEmpty():
            store.upsert(rows, f"inbox_{number:09d}", before)
        done.append(results.count())
        settle(results, folder, processed, failed)

    try:
        with store.lease(owner):
            files = images(spark.readStream.schema(BINARY).format("binaryFile").option("maxFilesPerTrigger", at_once).load(folder))
            files.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    except Busy:
        return None
    return sum(done)
