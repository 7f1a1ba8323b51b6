"""Appending streamed listings once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loanloom.sources import stores


def append_stream(batches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's new urls to the table at path, one partition for each batch: repeats within a batch go by
    listing_id, repeats of what the other batches hold by an anti join. A batch that is run again after a failure replaces
    its own partition, so it adds nothing twice, rows without url included."""

    def add(batch: DataFrame, number: int) -> None:
        stores.append_batch(batch, path, number)

    return batches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
