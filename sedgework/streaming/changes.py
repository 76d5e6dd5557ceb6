"""Change capture over a stream of deliveries: each new revision of a record once, through failures and re-deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sedgework.operators.changes import ChangeCapture


def capture(job: ChangeCapture, deliveries: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append deliveries to a log and run one batch of the job after each micro-batch.

    The log is the job's input: files of a micro-batch are written to a folder of its number and overwritten if it
    comes again. That number is the offset that the job's plans are made of (its ``at`` must be ``batch``), so each run reads the folders that are new,
    whatever times their deliveries have, and a repeated micro-batch adds nothing.
    """
    if job.at != "batch":
        raise ValueError("a job over a stream has the number of the micro-batch as its offset: at='batch'")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        job.run(batch.sparkSession.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(log_path))

    return deliveries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
