"""Fixed-size batches, shards and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.operators.ordering import with_row_index


def assign_batches(
    df: DataFrame, size: int, seed: int | str, keys: Sequence[str], drop_last: bool = False
) -> DataFrame:
    """Add ``batch_id`` over a seeded order; training drops the incomplete last batch."""
    indexed = with_row_index(df, seed, keys)
    batches = indexed.withColumn("batch_id", F.floor(F.col("row_index") / size))
    if drop_last:
        full = df.agg(F.floor(F.count(F.lit(1)) / size).alias("n")).scalar()
        batches = batches.where(F.col("batch_id") < full)
    return batches


def assign_shard(df: DataFrame, world: int, seed: int | str, keys: Sequence[str]) -> DataFrame:
    """Add ``shard``: rows dealt in turn over ``world`` workers, in a seeded order."""
    return with_row_index(df, seed, keys).withColumn("shard", F.col("row_index") % world)


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in a given order, for inspection."""
    return df.orderBy(*order).limit(n)
