"""Continuous loading: a stream of rows into a table, each micro-batch as one atomic append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tesela.session import Engine


def stream_into(engine: Engine, table: str, rows: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a streaming DataFrame with the table's columns. Invalid places are skipped, as in bulk appends.

    A batch that runs again after a failure is added once: the table keeps the last batch of each checkpoint folder.
    """

    def add(batch: DataFrame, number: int) -> None:
        engine.bulk_append(table, batch, stream=checkpoint, batch=number)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if once else writer).start()
