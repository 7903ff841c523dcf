"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BATCH_ROWS = 512
WHITE = "\\x20\\x09-\\x0D"
ASCII_GAP = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"


def ship(name: str) -> None:
    """Send the functions of a module to the executors with the job itself.

    Executors then need no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` beside ``more``, so that no names can clash."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in more.items()])


def text_hash(text: Column) -> Column:
    """Beside the id it tells apart rows that repeat an id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def row_key(id_col: str, text_col: str) -> dict[str, Column]:
    """``id_key`` and ``h``, never null, which name a row; rows that repeat both are alike.

    A null id has the key of an empty string.
    """
    return {"id_key": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "h": text_hash(F.col(text_col))}


def modest_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python at most ``BATCH_ROWS`` at a time: texts are long.

    This lowers the session's setting, which is per row count, if it is higher.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Slices of few rows: what a task holds at once depends on few texts, not on a whole batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


ship(__name__)
