"""Equi-depth ranges: a column's own quantiles cut its rows into even parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINE = 32
RANGES = FINE * FINE


def splitters(df: DataFrame, column: str) -> Column:
    """The approximate quantiles of ``column`` as one value for the whole query.

    A quantile sketch: at most ``RANGES`` - 1 numbers, whatever the number of rows. They come in two
    levels, ``coarse`` and the ``fine`` ones of each coarse range, so that a search looks at 64 of them.
    """
    shares = [k / RANGES for k in range(1, RANGES)]
    quantiles = F.percentile_approx(F.col(column).cast("double"), shares, 16 * RANGES)
    cuts = F.coalesce(F.array_sort(F.array_distinct(quantiles)), F.array().cast("array<double>"))
    starts = F.sequence(F.lit(1), F.lit(RANGES), F.lit(FINE))
    return (
        df.agg(cuts.alias("cuts"))
        .select(
            F.struct(
                F.filter("cuts", lambda x, i: i % FINE == FINE - 1).alias("coarse"),
                F.transform(starts, lambda s: F.slice("cuts", s, FINE - 1)).alias("fine"),
            ).alias("splitters")
        )
        .scalar()
    )


def with_range(df: DataFrame, column: str, out: str, over: DataFrame | None = None) -> DataFrame:
    """Add the number of the range that a value falls into, of ranges over ``over`` (else ``df``).

    The order of ranges is that of values; nulls are in the first.
    """
    number = F.col(column).cast("double")
    cut = df.withColumn("_cuts", splitters(df if over is None else over, column))
    cut = cut.withColumn("_coarse", F.size(F.filter(F.col("_cuts.coarse"), lambda c: c <= number)))
    fine = F.size(F.filter(F.get(F.col("_cuts.fine"), F.col("_coarse")), lambda c: c <= number))
    return cut.withColumn(out, F.col("_coarse") * FINE + fine).drop("_cuts", "_coarse")
