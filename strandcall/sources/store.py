"""Stores of several parts: example sets side by side, and training shards on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcall.operators.batching import assign_shard
from strandcall.operators.curation import EXAMPLE_COLUMNS

# What an example set is named by, in the order of the folders.
PARTS = ("model", "script", "split_name")
SHARD = "shard"


def store_examples(examples: DataFrame, base: str, model: str, script: str, split_name: str = "default") -> None:
    """Write one example set into the store at ``base``; the set of the same names is replaced, others stay.

    Rows are written by the tasks that have them. An empty set replaces nothing: it has no part.
    """
    named = examples.select(*EXAMPLE_COLUMNS, *[F.lit(value).alias(name) for name, value in zip(PARTS, (model, script, split_name))])
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PARTS).parquet(base)


def stored_examples(spark: SparkSession, base: str, model: str | None = None, script: str | None = None, split_name: str | None = None) -> DataFrame:
    """Examples of the sets with these names; folders of other sets are not opened."""
    schema = ", ".join(f"{c} string" for c in (*EXAMPLE_COLUMNS, *PARTS))
    found = spark.read.schema(schema).option("basePath", base).parquet(base)
    for name, value in zip(PARTS, (model, script, split_name)):
        if value is not None:
            found = found.where(F.col(name) == value)
    return found


def write_shards(df: DataFrame, path: str, world: int, seed: int | str, keys: Sequence[str]) -> None:
    """One folder for each of ``world`` ranks, whose rows differ in number by one at most.

    Rows are sent to the tasks of their rank; a rank with much data has several tasks and files, which
    adaptive execution cuts by size.
    """
    sharded = assign_shard(df, world, seed, keys).select(*df.columns, SHARD)
    sharded.hint("rebalance", F.col(SHARD)).write.mode("overwrite").partitionBy(SHARD).parquet(path)


def read_shard(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """The rows of one rank, without its number; only its folder is opened."""
    return spark.read.parquet(f"{path}/{SHARD}={rank}")
