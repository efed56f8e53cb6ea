"""Streams into a collection: each micro-batch is one upsert, the last row of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..collection import Collection


def upsert_stream(rows: DataFrame, collection: Collection, checkpoint: str, order_by: str | None = None, **trigger):
    """Start a query that upserts a stream with ``_id`` and the fields. A batch that is run again upserts the same rows.

    ``order_by`` may be a column that the collection has not: it only tells which row of a key is last.
    """

    def write(batch: DataFrame, number: int) -> None:
        turn = F.desc(order_by) if order_by else F.monotonically_increasing_id().desc()
        last = batch.withColumn("_turn", F.row_number().over(Window.partitionBy("_id").orderBy(turn))).where("_turn = 1").drop("_turn")
        last = last.drop(*[c for c in (order_by,) if c is not None and c not in collection.schema])
        collection.upsert_df(last)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
