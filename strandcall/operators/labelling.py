"""Joining calls with directions, and what the join says about label quality.

Hot keys: both sides are collapsed before they are shuffled. The row-level join
keeps the calls' shuffle directly under the sort-merge join, so adaptive
execution can split an oversized partition of calls; the directions side holds
each key in short runs. The counted form never expands duplicates at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.functions.labels import UNRESOLVED, raw_label, repair_label
from strandcall.operators.keys import group_packed
from strandcall.vocab import SAMPLE_KEYS

# Longest run of equal direction rows kept in one row of the collapsed side.
RUN_ROWS = 4096
NULL_SAFE_KEYS = ("cell_type", "_pert", "_pert_missing", "_gene", "_gene_missing")


def _label_number() -> Column:
    return F.expr("try_cast(label as double)")


def _whole_label(truncate: bool) -> Column:
    """The label as a whole number, cut off toward zero if asked for; null if there is none."""
    number = _label_number()
    if truncate:
        number = F.when(F.abs(number) < 1e9, number.cast("int").cast("double"))
    return number


def _usable_label(truncate: bool = False) -> Column:
    return F.coalesce(_whole_label(truncate).isin(0.0, 1.0), F.lit(False))


def label_report(df: DataFrame, truncate: bool = False) -> DataFrame:
    """Rows by label text and verdict: ``kept``, ``not a number``, ``not 0 or 1``."""
    number, usable = _label_number(), _usable_label(truncate)
    reason = F.when(number.isNull() | F.isnan(number), "not a number").otherwise("not 0 or 1")
    kept = number.cast("int").cast("string")
    return df.groupBy(
        F.when(usable, kept).otherwise(F.col("label").cast("string")).alias("label"),
        F.when(usable, "kept").otherwise(reason).alias("reason"),
    ).agg(F.count(F.lit(1)).alias("n"))


def valid_labels(df: DataFrame, truncate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split off rows whose label is not 0 or 1.

    ``truncate`` cuts fractions off first, so that 1.5 counts as 1 and 0.7 as 0.
    Returns the clean rows (label int, keys string) and a count of rejects by
    label text and reason.
    """
    clean = df.where(_usable_label(truncate)).withColumns(
        {
            "pert": F.col("pert").cast("string"),
            "gene": F.col("gene").cast("string"),
            "label": _label_number().cast("int"),
        }
    )
    return clean, label_report(df.where(~_usable_label(truncate)), truncate)


def collapse_directions(directions: DataFrame) -> DataFrame:
    """One row per key, direction and run of at most ``RUN_ROWS`` equal rows."""
    counted = group_packed(directions, [*SAMPLE_KEYS, "label"], F.count(F.lit(1)).alias("n"))
    last_run = F.floor((F.col("n") - 1) / RUN_ROWS)
    return counted.withColumn("run", F.explode(F.sequence(F.lit(0), last_run))).select(
        *[F.col(key).alias(f"d_{key}") for key in SAMPLE_KEYS],
        F.col("label").alias("direction"),
        F.least(F.lit(RUN_ROWS), F.col("n") - F.col("run") * RUN_ROWS).cast("int").alias("copies"),
    )


def label_join(calls: DataFrame, directions: DataFrame) -> DataFrame:
    """Left join of calls to directions on pert and gene within a cell line.

    Duplicates fan out and missing keys match each other. ``label`` becomes
    ``is_de``; ``direction`` is null where nothing matched.
    """
    right = collapse_directions(directions)
    joined = calls.withColumnRenamed("label", "is_de").join(
        right,
        (F.col("cell_type") == F.col("d_cell_type"))
        & F.col("pert").eqNullSafe(F.col("d_pert"))
        & F.col("gene").eqNullSafe(F.col("d_gene")),
        "left",
    )
    copies = F.coalesce(F.col("copies"), F.lit(1))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop(
        "_copy", "copies", "d_pert", "d_gene", "d_cell_type"
    )


def labelled_samples(calls: DataFrame, directions: DataFrame) -> DataFrame:
    """One row per sample with its repaired three-way ``label``."""
    joined = label_join(calls, directions)
    label = repair_label(raw_label(F.col("is_de"), F.col("direction")))
    return joined.withColumn("label", label).drop("is_de", "direction")


def null_safe_keys(df: DataFrame) -> list[Column]:
    """Sample keys in a form on which missing values are equal and hashable."""
    return [
        F.col("cell_type"),
        F.coalesce(F.col("pert"), F.lit("")).alias("_pert"),
        F.col("pert").isNull().alias("_pert_missing"),
        F.coalesce(F.col("gene"), F.lit("")).alias("_gene"),
        F.col("gene").isNull().alias("_gene_missing"),
    ]


def direction_counts(directions: DataFrame) -> DataFrame:
    """Rows per key and direction, on null-safe keys."""
    return directions.groupBy(*null_safe_keys(directions)).agg(
        F.count_if(F.col("label") == 0).alias("n_down"),
        F.count_if(F.col("label") == 1).alias("n_up"),
        F.count(F.lit(1)).alias("n_directions"),
    )


def label_counts(calls: DataFrame, directions: DataFrame) -> DataFrame:
    """Samples per cell line and raw label (0, 1, 2, -1), without building them.

    Both sides shrink to one row per key; the fan-out of the join is the product
    of the two counts. One shuffle per side, reused by the join.
    """
    per_key = calls.groupBy(*null_safe_keys(calls)).agg(
        F.count_if(F.col("label") == 0).alias("n_same"),
        F.count_if(F.col("label") == 1).alias("n_changed"),
        F.count(F.lit(1)).alias("n_calls"),
    )
    joined = per_key.join(direction_counts(directions), list(NULL_SAFE_KEYS), "left")
    partners = F.greatest(F.coalesce(F.col("n_directions"), F.lit(0)), F.lit(1))
    samples = F.col("n_calls") * partners
    same = F.col("n_same") * partners
    down = F.col("n_changed") * F.coalesce(F.col("n_down"), F.lit(0))
    up = F.col("n_changed") * F.coalesce(F.col("n_up"), F.lit(0))
    per_cell = joined.groupBy("cell_type").agg(
        F.sum(same).alias("same"),
        F.sum(down).alias("down"),
        F.sum(up).alias("up"),
        F.sum(samples - same - down - up).alias("unresolved"),
    )
    pairs = F.array(
        *[
            F.struct(F.lit(code).alias("raw_label"), F.col(name).alias("n"))
            for code, name in ((0, "same"), (1, "down"), (2, "up"), (UNRESOLVED, "unresolved"))
        ]
    )
    return per_cell.select("cell_type", F.inline(pairs)).where(F.col("n") > 0)


def ternary_label_counts(calls: DataFrame, directions: DataFrame) -> DataFrame:
    """Samples per cell line and repaired label."""
    return (
        label_counts(calls, directions)
        .groupBy("cell_type", repair_label(F.col("raw_label")).alias("label"))
        .agg(F.sum("n").alias("n"))
    )


def label_quality(calls: DataFrame, directions: DataFrame) -> DataFrame:
    """Samples per cell line and how many needed the repair."""
    broken = F.when(F.col("raw_label") == UNRESOLVED, F.col("n")).otherwise(0)
    return (
        label_counts(calls, directions)
        .groupBy("cell_type")
        .agg(F.sum("n").alias("n_samples"), F.sum(broken).alias("n_repaired"))
    )


def distinct_used(used: DataFrame) -> DataFrame:
    """Distinct complete keys of already used examples."""
    complete = F.col("pert").isNotNull() & F.col("gene").isNotNull() & F.col("cell_type").isNotNull()
    return group_packed(used.where(complete), SAMPLE_KEYS)


def exclude_used(samples: DataFrame, used: DataFrame) -> DataFrame:
    """Samples whose key was not used before; missing keys never match."""
    return samples.join(distinct_used(used), list(SAMPLE_KEYS), "left_anti").select(samples.columns)


def excluded_counts(samples: DataFrame, used: DataFrame) -> DataFrame:
    """Skipped samples per cell line."""
    return (
        samples.select(*SAMPLE_KEYS)
        .join(distinct_used(used), list(SAMPLE_KEYS), "left_semi")
        .groupBy("cell_type")
        .agg(F.count(F.lit(1)).alias("n_excluded"))
    )


def load_report(calls: DataFrame, directions: DataFrame, used: DataFrame, keep: Column) -> DataFrame:
    """Rows before and after the split, samples, exclusions, and what remains.

    One row per cell line and one total row (``cell_type`` null). ``keep`` says
    which calls are in the split. Everything is counted per key first, so no
    sample is built and all three inputs meet on one partitioning.
    """
    keys = list(NULL_SAFE_KEYS)
    per_key = calls.groupBy(*null_safe_keys(calls)).agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(keep).alias("rows_after")
    )
    partners = directions.groupBy(*null_safe_keys(directions)).agg(F.count(F.lit(1)).alias("n_directions"))
    known = distinct_used(used)
    known = known.select(*null_safe_keys(known), F.lit(True).alias("is_used"))
    samples = F.col("rows_after") * F.coalesce(F.col("n_directions"), F.lit(1))
    excluded = F.when(F.col("is_used"), samples).otherwise(F.lit(0))
    per_cell = (
        per_key.join(partners, keys, "left")
        .join(known, keys, "left")
        .groupBy("cell_type")
        .agg(
            F.sum("rows_before").alias("rows_before"),
            F.sum("rows_after").alias("rows_after"),
            F.sum(samples).alias("samples"),
            F.sum(excluded).alias("excluded"),
        )
        .withColumn("kept", F.col("samples") - F.col("excluded"))
    )
    return per_cell.rollup("cell_type").agg(
        *[F.sum(c).alias(c) for c in ("rows_before", "rows_after", "samples", "excluded", "kept")],
        F.count_if(F.col("kept") > 0).alias("cell_lines"),
    )
