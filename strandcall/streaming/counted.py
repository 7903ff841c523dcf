"""Counted results as a state that micro-batches merge into.

Reports need counts, not rows. Each micro-batch is counted by what the reports look at, and
its counts are merged into the state: one small table, written anew as a version under the
number of the micro-batch. Version k is made of version k - 1 and the rows of batch k alone, so
that a replayed batch writes the same version again. Every N batches a version is also kept as a
snapshot, and ``finish`` leaves one final set of files. A reader opens one version, however
many micro-batches there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandcall.operators.metrics import eval_counts

VERSION, SNAPSHOT, FINAL = "version", "snapshot", "final"
KEPT_VERSIONS = 2  # the last one, and the one before it that a replay starts from
STATE_FILES = 16  # files of a version: counts are few


def merged(*counts: DataFrame) -> DataFrame:
    """Counts of the same kind added up; missing keys are keys."""
    both = counts[0]
    for more in counts[1:]:
        both = both.unionByName(more)
    keys = [c for c in both.columns if c != "n"]
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The complete folders of a kind below ``path``, by number: those whose writer left its mark."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop.Path(f"{path}/{kind}=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _forget(spark: SparkSession, path: str, kind: str, number: int) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/{kind}={number}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _read(spark: SparkSession, path: str, kind: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{kind}={number}")


def merge_counts(path: str, every: int, count: Callable[[DataFrame], DataFrame] = eval_counts) -> Callable[[DataFrame, int], None]:
    """What a stream does with a micro-batch: see the module.

    Versions start at 0; a batch without rows writes its version too, so that the next one finds it.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = count(batch)
        if number > 0:
            counts = merged(_read(spark, path, VERSION, number - 1), counts)
        counts.coalesce(STATE_FILES).write.mode("overwrite").parquet(f"{path}/{VERSION}={number}")
        if (number + 1) % every == 0:
            _read(spark, path, VERSION, number).coalesce(1).write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}={number}")
        for old in _numbers(spark, path, VERSION):
            if old <= number - KEPT_VERSIONS:
                _forget(spark, path, VERSION, old)

    return save


def stream_counts(
    results: DataFrame, path: str, checkpoint: str, every: int = 10, interval: str | None = None,
    count: Callable[[DataFrame], DataFrame] = eval_counts,
) -> StreamingQuery:
    """Merge each micro-batch of parsed results into the counted state at ``path``, with a snapshot every ``every`` batches."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        results.writeStream.foreachBatch(merge_counts(path, every, count))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def current(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all micro-batches that are done."""
    versions = _numbers(spark, path, VERSION)
    if not versions:
        raise ValueError(f"no counts at {path}")
    return _read(spark, path, VERSION, versions[-1])


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots, with the number of micro-batches that each has seen in ``batches``."""
    numbers = _numbers(spark, path, SNAPSHOT)
    if not numbers:
        raise ValueError(f"no snapshot at {path}")
    each = [_read(spark, path, SNAPSHOT, k).withColumn("batches", F.lit(k + 1).cast("long")) for k in numbers]
    both = each[0]
    for more in each[1:]:
        both = both.unionByName(more)
    return both


def finish(query: StreamingQuery, spark: SparkSession, path: str) -> DataFrame:
    """Wait for the stream, then leave its counts as one final file; raises what the stream raised."""
    query.awaitTermination()
    current(spark, path).coalesce(1).write.mode("overwrite").parquet(f"{path}/{FINAL}")
    return spark.read.parquet(f"{path}/{FINAL}")
