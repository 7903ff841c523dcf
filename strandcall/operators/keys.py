"""Grouping that leaves a later join its own shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_packed(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Group by ``keys`` packed into one struct; distinct keys if no aggregate is given.

    Made for the small side of a join on the same keys. The join cannot reuse the
    partitioning of the packed group, so its inputs are plain shuffles, which
    adaptive execution can split where the other side has a hot key.
    """
    packed = df.withColumn("_key", F.struct(*keys))
    grouped = packed.groupBy("_key").agg(*aggs) if aggs else packed.select("_key").distinct()
    return grouped.select("_key.*", *[c for c in grouped.columns if c != "_key"])
