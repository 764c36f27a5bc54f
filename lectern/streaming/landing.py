"""Continuous ingestion: files that land in a folder become chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import store
from lectern.operators.snapshots import BucketedTable
from lectern.plans.api import Engine
from lectern.session import written


def watch(engine: Engine, folder: str, checkpoint: str, doc_type: str = "sermon", available_now: bool = True) -> StreamingQuery:
    """A stream over the text files of ``folder`` into the engine's table.

    Each micro-batch replaces the chunks of its files; chunk ids depend on file and index only,
    so a batch that is repeated after a failure gives the same table.
    """
    files = engine.spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").load(folder)
    docs = files.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.add(batch, doc_type)

    w = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", order: str = "arrived_at") -> StreamingQuery:
    """A stream of chunk rows into a table at ``path``, the latest row of a key counting.

    Each micro-batch writes only the folders of its keys and appears as one version, so one that
    is repeated after a failure gives the same table.
    """
    table = BucketedTable(stream.sparkSession, path, key)

    def put(batch: DataFrame, _: int) -> None:
        new = store.latest(batch.where(F.col(key).isNotNull()), key, order)
        new = written(new)
        if not new.isEmpty():
            table.change(new, lambda old, rows: store.upsert(old, rows, key))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
