"""Streams into engine tables: each micro-batch is one insert, its indexes kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkdex.plans.engine import Engine


def feed_table(engine: Engine, table: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream's rows to a table. Rows of a batch become visible together, and a
    batch delivered again after a failure is not inserted twice.

    Batches count from 0 in every checkpoint, so they are remembered by the id the
    checkpoint gives its query: other streams into the table, and this one from a new
    checkpoint, are streams of their own and lose nothing.
    """

    def insert(batch: DataFrame, number: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream_id:
            raise RuntimeError("the running stream has no id")
        engine.insert_frame(table, batch, (stream_id, number))

    w = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
