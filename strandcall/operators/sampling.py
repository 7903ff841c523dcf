"""Exact-size, repeatable samples.

A sample of m rows is the m lowest rows of a seeded hash order. Three small jobs
find the hash at which to cut (a histogram over hash prefixes, one over longer
prefixes in the bucket that the cut falls into, then the hashes of its part at
the cut); the sample itself is a filter on the hash.
Nothing is sorted or sent to the driver but one cut per run.

The input is read once per job: stage it first if it is expensive to compute.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from strandcall.operators.ordering import BUCKET_DIGITS, HASH, bucket_of, collapse, expand, hash_of
from strandcall.operators.splits import filter_direction

RUN = "run"


@dataclass(frozen=True)
class Cut:
    """Where one run's sample ends."""

    run: int
    total: int
    wanted: int
    last_hash: str  # rows below are in; "" when nothing is wanted
    needed: int  # rows with exactly this hash that are in
    present: int  # rows with exactly this hash


def _wanted(total: Column, fraction: float, min_one: bool) -> Column:
    size = F.floor(total.cast("double") * F.lit(float(fraction)))
    return F.greatest(size, F.least(total, F.lit(1))) if min_one else size


def _crossing(sizes: DataFrame, item: str) -> DataFrame:
    """The row of each run in whose range the ``wanted``-th position falls."""
    upto = Window.partitionBy(RUN).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sizes.withColumn("end", F.sum("n").over(upto))
        .withColumn("needed", F.col("wanted") - (F.col("end") - F.col("n")))
        .where((F.col("needed") > 0) & (F.col("needed") <= F.col("n")))
    )


def _per_run(values: dict[int, object], default: object) -> Column:
    expr = F.lit(default)
    for run, value in values.items():
        expr = F.when(F.col(RUN) == run, F.lit(value)).otherwise(expr)
    return expr


def _same_prefix(prefixes: dict[int, str], digits: int) -> Column:
    return F.substring(HASH, 1, digits) == _per_run(prefixes, None)


def find_cuts(keyed: DataFrame, fraction: float, min_one: bool, wanted: dict[int, int] | None = None) -> list[Cut]:
    """Cuts of a frame with ``RUN`` and ``HASH``; at most one row per run is collected.

    Positions are counted over hash prefixes, then over prefixes twice as long in
    the bucket at the cut, then over the hashes of the bucket at this cut.
    """
    by_prefix = keyed.groupBy(RUN, bucket_of().alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(RUN))
    size = _per_run(wanted, 0) if wanted is not None else _wanted(F.col("total"), fraction, min_one)
    sized = by_prefix.withColumn("total", total).withColumn("wanted", size.cast("bigint"))
    first = {row[RUN]: row for row in _crossing(sized, "prefix").collect()}
    if not first:
        return []

    def crossing_in(at: dict[int, Row], digits: int, item: Column) -> dict[int, Row]:
        inside = keyed.where(_same_prefix({run: row["prefix"] for run, row in at.items()}, digits))
        counted = inside.groupBy(RUN, item.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        left = _per_run({run: row["needed"] for run, row in at.items()}, 0).cast("bigint")
        return {row[RUN]: row for row in _crossing(counted.withColumn("wanted", left), "prefix").collect()}

    digits = 2 * BUCKET_DIGITS
    at = crossing_in(first, BUCKET_DIGITS, F.substring(HASH, 1, digits))
    return [
        Cut(
            run=run,
            total=first[run]["total"],
            wanted=first[run]["wanted"],
            last_hash=row["prefix"],
            needed=row["needed"],
            present=row["n"],
        )
        for run, row in crossing_in(at, digits, F.col(HASH)).items()
    ]


def _split_ties(tied: DataFrame, columns: list[str], cuts: list[Cut], depth: int) -> DataFrame:
    """Rows that share the hash at the cut: choose the needed number among them.

    First by a hash over the whole row. Rows that still agree are copies of each
    other: they are counted, the count is divided, and the copies are written out.
    """
    needed = {cut.run: cut.needed for cut in cuts}
    if depth == 0:
        by_row = tied.withColumn(HASH, F.md5(F.to_json(F.struct(*columns))))
        return mark_lowest(by_row, columns, find_cuts(by_row, 0.0, False, needed), depth + 1)
    counted = collapse(tied.select(*columns, RUN, HASH), "copies")
    inside = F.least(_per_run(needed, 0).cast("bigint"), F.col("copies"))

    def span(kept: bool, first: Column, stop: Column) -> Column:
        return F.struct(F.lit(kept).alias("kept"), first.alias("a"), stop.alias("b"))

    parts = F.array(span(True, F.lit(0).cast("bigint"), inside), span(False, inside, F.col("copies")))
    spans = counted.select(*columns, RUN, HASH, F.inline(parts))
    return expand(spans, F.col("a"), F.col("b"), "_copy").select(*columns, RUN, "kept")


def mark_lowest(keyed: DataFrame, columns: list[str], cuts: list[Cut], depth: int = 0) -> DataFrame:
    """Add ``kept`` to every row of a frame with ``RUN`` and ``HASH``."""
    last = _per_run({cut.run: cut.last_hash for cut in cuts}, "")
    partial = [cut for cut in cuts if cut.needed < cut.present]
    marked = keyed.withColumn("kept", F.col(HASH) <= last)
    if not partial:
        return marked.select(*columns, RUN, "kept")
    at_cut = F.col(HASH) == _per_run({cut.run: cut.last_hash for cut in partial}, "")
    tied = _split_ties(keyed.where(at_cut), columns, partial, depth)
    return marked.where(~at_cut).select(*columns, RUN, "kept").unionByName(tied)


def _marked(df: DataFrame, fraction: float, seed: int | str, keys: Sequence[str], min_one: bool) -> DataFrame:
    keyed = df.withColumn(RUN, F.lit(1)).withColumn(HASH, hash_of(seed, keys))
    return mark_lowest(keyed, df.columns, find_cuts(keyed, fraction, min_one))


def sample_exact(
    df: DataFrame, fraction: float, seed: int | str, keys: Sequence[str], min_one: bool = True
) -> DataFrame:
    """``int(n * fraction)`` rows, at least one of a non-empty table if ``min_one``."""
    return _marked(df, fraction, seed, keys, min_one).where("kept").select(df.columns)


def repeated_samples(
    df: DataFrame, runs: int, fraction: float, seed: int | str, keys: Sequence[str], stage: str = "dif"
) -> DataFrame:
    """``runs`` independent samples in one frame with a ``run`` column.

    A row is hashed once for each run, but only runs that take it become rows.
    In stage ``dir`` each sample is narrowed to directions afterwards.
    """
    hashes = {run: hash_of(seed, [F.lit(run), *keys]) for run in range(1, runs + 1)}
    each = [F.struct(F.lit(run).alias(RUN), h.alias(HASH)) for run, h in hashes.items()]
    cuts = find_cuts(df.select(F.inline(F.array(*each))), fraction, True)
    last = {cut.run: cut.last_hash for cut in cuts}
    taking = [F.when(one[HASH] <= last[run], one) for run, one in zip(hashes, each) if run in last]
    below = F.filter(F.array(*taking), lambda one: one.isNotNull()) if taking else F.array(*each[:0]).cast(f"array<struct<{RUN}:int,{HASH}:string>>")
    kept = mark_lowest(df.select("*", F.inline(below)), df.columns, cuts).where("kept").select(RUN, *df.columns)
    return filter_direction(kept) if stage == "dir" else kept


def train_val_split(
    df: DataFrame, train_fraction: float, seed: int | str, keys: Sequence[str]
) -> DataFrame:
    """Add ``part``: exactly ``int(n * train_fraction)`` rows ``train``, the rest ``val``."""
    marked = _marked(df, train_fraction, seed, keys, False)
    return marked.withColumn("part", F.when(F.col("kept"), "train").otherwise("val")).select(*df.columns, "part")
