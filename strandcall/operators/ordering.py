"""Positions in a seeded hash order, without a global sort.

The first hex digits of a hash cut any table into even buckets. Bucket sizes
are a small table, their running total gives each bucket's offset, and ranks
are needed only inside buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcall.session import stage

HASH = "_hash"
BUCKET_DIGITS = 4  # 65,536 buckets: the size table is at most that long per group
KEY_BUCKETS = 1 << 16
MOST_IN_TASK = 1_000_000  # rows of one bucket of keys that a task may sort


def hash_of(seed: int | str, keys: Sequence[str | Column]) -> Column:
    """md5 over seed and keys, joined by ``|``; missing keys are skipped."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def add_hash(df: DataFrame, seed: int | str, keys: Sequence[str | Column]) -> DataFrame:
    return df.withColumn(HASH, hash_of(seed, keys))


def bucket_of(digits: int = BUCKET_DIGITS) -> Column:
    return F.substring(HASH, 1, digits)


def collapse(df: DataFrame, copies: str = "copies") -> DataFrame:
    """One row per distinct row of ``df`` with its number of copies."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))


def expand(df: DataFrame, first: Column, stop: Column, out: str, step: int = 4096) -> DataFrame:
    """One row per value of ``[first, stop)``.

    Long ranges are cut into blocks, and the blocks are dealt out over the
    partitions, so that no single task writes all copies of a frequent row.
    """
    blocks = df.withColumn("_first", first).withColumn("_stop", stop).where(F.col("_first") < F.col("_stop"))
    last = F.floor((F.col("_stop") - 1 - F.col("_first")) / step)
    return (
        blocks.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
        .repartition(HASH, "_block")
        .withColumn("_first", F.col("_first") + F.col("_block") * step)
        .withColumn("_stop", F.least(F.col("_stop"), F.col("_first") + step))
        .withColumn(out, F.explode(F.sequence(F.col("_first"), F.col("_stop") - 1)))
        .drop("_first", "_stop", "_block")
    )


def number_copies(df: DataFrame, keys: Sequence[str], out: str = "occurrence", most: int = MOST_IN_TASK) -> DataFrame:
    """Number the rows that share ``keys`` from 0, in the order of the other columns.

    With ``out`` among its keys a sample draws rows even where keys repeat. Rows are counted in ``KEY_BUCKETS``
    buckets of their keys first. Those of buckets of up to ``most`` rows are numbered behind one shuffle by their keys; the others,
    which hold the frequent keys, in ranges. Use it on narrow frames.
    """
    rest = [c for c in df.columns if c not in keys] or list(keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    counted = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = [row.bucket for row in counted.collect()]  # KEY_BUCKETS numbers at most
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest)).cast("bigint") - 1
    if not large:
        return df.withColumn(out, place)
    frequent = _number_in_ranges(df.where(bucket.isin(large)), keys, out)
    return df.where(~bucket.isin(large)).withColumn(out, place).unionByName(frequent)


def _number_in_ranges(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``number_copies`` of frequent keys.

    Equal rows are counted and written out again in blocks, so that a frequent row is
    spread over the partitions. The counted rows are stored in ranges of (keys, other columns):
    a frequent key spans many ranges, which are numbered side by side, each
    from the number of rows in the ranges in front of it.
    """
    others = [c for c in df.columns if c not in keys]
    ranged = collapse(df).repartitionByRange(*keys, *others)
    placed = stage(ranged.withColumn("_range", F.spark_partition_id()), "ranges").select(F.struct(*keys).alias("_key"), *others, "copies", "_range")
    before = (Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_key", "_range").agg(F.sum("copies").alias("_size"))
    across = Window.partitionBy("_key").orderBy("_range").rowsBetween(*before)
    offsets = sizes.select("_key", "_range", F.coalesce(F.sum("_size").over(across), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_key", "_range").orderBy(*(others or ["_key"])).rowsBetween(*before)
    inside = placed.withColumn("_within", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    started = inside.join(offsets, ["_key", "_range"]).withColumn("_from", F.col("_offset") + F.col("_within"))
    started = started.withColumn(HASH, F.xxhash64("_key", *others))  # deals out the rows of a key as well
    found = expand(started, F.col("_from"), F.col("_from") + F.col("copies"), out)
    return found.select("_key.*", *others, out).select(*df.columns, out)


def run_starts(
    runs: DataFrame,
    copies: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``_start``: copies in front of a row in (hash, ties) order within ``by``.

    ``runs`` carries ``HASH`` and a copy count; its rows differ in (by, hash, ties).
    Every group is cut into 16 to the power of ``digits`` buckets.
    """
    bucketed = runs.withColumn("_bucket", bucket_of(digits))
    before = (Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy(*by, "_bucket").agg(F.sum(copies).alias("_size"))
    across = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(*before)
    offsets = sizes.select(
        *by, "_bucket", F.coalesce(F.sum("_size").over(across), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*by, "_bucket").orderBy(HASH, *ties).rowsBetween(*before)
    return (
        bucketed.withColumn("_within", F.coalesce(F.sum(copies).over(within), F.lit(0)))
        .join(offsets, [*by, "_bucket"])
        .withColumn("_start", F.col("_offset") + F.col("_within"))
        .drop("_bucket", "_offset", "_within")
    )


def with_row_index(df: DataFrame, seed: int | str, keys: Sequence[str], out: str = "row_index") -> DataFrame:
    """Add each row's position in hash order, from 0, over the whole table.

    Rows that agree on all columns are counted, placed as one run and expanded
    again. Use it on narrow frames and join wide text afterwards.
    """
    columns = df.columns
    counted = collapse(df)
    rest = [c for c in columns if c not in keys]
    placed = run_starts(add_hash(counted, seed, keys), "copies", ties=[*keys, *rest])
    start = F.col("_start")
    return expand(placed, start, start + F.col("copies"), out).select(*columns, out)
