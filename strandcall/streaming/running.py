"""Running totals and cumulative results while responses arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandcall.operators.metrics import percent

BATCH = "batch_no"


def running_approval(stream: DataFrame, approved: Column) -> DataFrame:
    """Processed and approved rows so far, and the share in percent."""
    return stream.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(approved).alias("approved")
    ).withColumn("approval_pct", percent(F.col("approved"), F.col("processed")))


def _trigger(interval: str | None) -> dict[str, object]:
    return {"processingTime": interval} if interval else {"availableNow": True}


def write_snapshot(
    totals: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write the totals after each micro-batch to a folder of its own below ``path``.

    A replayed batch overwrites its folder, and no reader ever finds ``path`` without the
    totals before. Without an ``interval`` the query handles what is there and ends.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval))
        .start()
    )


def read_snapshot(totals: DataFrame, path: str) -> DataFrame:
    """The latest complete totals."""
    spark = totals.sparkSession
    schema = T.StructType([*totals.schema, T.StructField(BATCH, T.LongType())])
    stored = spark.read.schema(schema).option("basePath", path).parquet(path)
    latest = stored.agg(F.max(BATCH)).first()[0]
    return stored.where(F.col(BATCH) == latest).drop(BATCH)


def stream_results(
    results: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Add each micro-batch to the results at ``path``.

    A batch owns one partition folder and overwrites it, so a batch that is
    replayed after a failure leaves no duplicates.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return (
        results.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(interval))
        .start()
    )


def finish(query: StreamingQuery) -> None:
    """Wait for all available input; raises what the query raised."""
    query.awaitTermination()


def stored_results(results: DataFrame, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Everything a results stream has written so far."""
    stored = results.sparkSession.read.schema(results.schema).option("basePath", path).parquet(path)
    return stored.select(*(columns or results.columns))
