"""Views kept up to date from a stream of changes.

foreachBatch delivers a batch at least once. Each batch's result is therefore committed through the store's manifest together
with the number of the batch; a batch that comes again is found there and skipped. Order is that of seq, not of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedgework.database import Database
from sedgework.operators import views as V

PROGRESS = "number bigint"


def change_stream(spark: SparkSession, path: str, schema: str = "seq bigint, collection string, doc_id string") -> DataFrame:
    """A folder of Parquet files to which changes are added, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def maintain_view(database: Database, changes: DataFrame, view: V.View, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes (seq, collection, doc_id) to a view, all that is there, then stop.

    Only changes of the view's source count; null ids are ignored. A batch is applied exactly once, whatever fails between.
    """
    progress = f"stream/{view.name}"

    def apply(batch: DataFrame, number: int) -> None:
        with database.write_transaction() as t:
            done = t.read(progress, database.spark.createDataFrame([], PROGRESS).schema).agg(F.max("number")).first()[0]
            if done is not None and number <= done:
                return
            own = batch.where((F.col("collection") == view.source) & F.col("doc_id").isNotNull()).select("seq", "doc_id")
            database.apply_view(view, own)
            t.write(progress, database.spark.createDataFrame([(number,)], PROGRESS))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
