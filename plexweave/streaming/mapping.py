"""The mapping stage over a stream of read pairs: each micro-batch goes through the batch plan and is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plexweave.functions.geometry import Geometry
from plexweave.operators.mapping import Libraries, flagged, records


def map_stream(reads: DataFrame, geometry: Geometry, libraries: Libraries, path: str, checkpoint: str, window: int = 1, exact: bool = False, available_now: bool = True) -> StreamingQuery:
    """Write the records of a streaming `reads` under `path`, a folder for each batch, so a batch that runs again replaces itself.

    Counts of one molecule in several batches add up when the records are read and weighed again.
    """

    def one(batch: DataFrame, number: int) -> None:
        records(flagged(batch, geometry, libraries, window, exact)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
