"""Row splits and cell-line holdouts."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.session import stage
from strandcall.vocab import DOWN, UP

# Holdout settings that mean "no holdout".
NO_HOLDOUT = ("none", "default")
# Set by the readers: false for rows of a file that has no split column at all.
HAS_SPLIT = "has_split"


def parse_cell_lines(text: str | None, keywords: tuple[str, ...] = NO_HOLDOUT) -> list[str]:
    """Cell lines of a comma list, trimmed and lower-cased; empty means no holdout."""
    if not text or text.lower() in keywords:
        return []
    lines = [name.strip().lower() for name in text.split(",")]
    return [name for name in lines if name]


def in_split(df: DataFrame, split: str | None) -> Column:
    """Whether a row belongs to ``split``; rows that know no split belong to every one."""
    if split is None:
        return F.lit(True)
    if "split" not in df.columns:
        warnings.warn(f"no split column, keeping every row for split '{split}'", stacklevel=2)
        return F.lit(True)
    wanted = F.col("split") == split
    if HAS_SPLIT in df.columns:
        wanted = wanted | ~F.col(HAS_SPLIT)
    return F.coalesce(wanted, F.lit(False))


def filter_split(df: DataFrame, split: str | None) -> DataFrame:
    if split is None:
        return df
    if "split" in df.columns and HAS_SPLIT not in df.columns:
        return df.where(F.col("split") == split)
    return df.where(in_split(df, split))


def filter_holdout(
    df: DataFrame,
    split: str | None,
    test_lines: str | None,
    keywords: tuple[str, ...] = NO_HOLDOUT,
) -> DataFrame:
    """Hold out whole cell lines; this overrides the row split.

    ``test`` keeps the listed lines, ``train`` the others, ``None`` all of them,
    any other split nothing. Without a usable list the row split applies.
    """
    lines = parse_cell_lines(test_lines, keywords)
    if not lines:
        return filter_split(df, split)
    if split is None:
        return df
    listed = F.lower("cell_type").isin(lines)
    if split == "test":
        return df.where(listed)
    if split == "train":
        return df.where(~listed)
    warnings.warn(f"split '{split}' is unknown to the cell-line holdout, nothing is loaded", stacklevel=2)
    return df.where(F.lit(False))


def holdout_by_lines(df: DataFrame, split: str | None, lines: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``filter_holdout`` with the held-out lines as a table (column ``line``, any case, nulls and repeats don't count).

    ``cells`` has the cell lines of ``df`` in ``cell_type``, one a row or more; without it they are taken from ``df``, of which
    only that column is read. The wanted ones are staged first and meet ``df`` in one semi join, so that of a table in
    folders by ``cell_type`` the folders of other lines are not opened if the wanted ones are few enough for Spark to send
    round. An empty table of lines holds nothing out: ``test`` keeps no row then, ``train`` all. As in
    ``filter_holdout``, rows without a cell line belong to no part.
    """
    if split is None:
        return df
    if split not in ("train", "test"):
        warnings.warn(f"split '{split}' is unknown to the cell-line holdout, nothing is loaded", stacklevel=2)
        return df.where(F.lit(False))
    held = lines.select(F.lower("line").alias("_line")).where("_line is not null").distinct()
    cells = (df if cells is None else cells).select(F.col("cell_type").alias("_cell")).where("_cell is not null").distinct()
    wanted = cells.join(held, F.lower("_cell") == F.col("_line"), "left_semi" if split == "test" else "left_anti")
    # Spark prunes folders only by a side with a comparison in its filter; this one holds for every name.
    wanted = stage(wanted, "cell-lines").where(F.length("_cell") >= 0)
    return df.join(wanted, F.col("cell_type") == F.col("_cell"), "left_semi")


def holdout_cells(df: DataFrame, test_lines: str | None) -> DataFrame:
    """Part (``train`` or ``test``) of every cell line that occurs in ``df``."""
    lines = parse_cell_lines(test_lines)
    cell = F.lower("cell_type").alias("cell_line")
    part = F.when(F.col("cell_line").isin(lines), "test").otherwise("train") if lines else F.lit("train")
    return df.select(cell).distinct().withColumn("part", part)


def filter_direction(df: DataFrame) -> DataFrame:
    """Rows whose gold answer is a direction; apply it after sampling."""
    return df.where(F.col("solution").isin(UP, DOWN))


def valid_prompts(df: DataFrame) -> DataFrame:
    """Rows with at least one chat message."""
    return df.where(F.col("prompt").isNotNull() & (F.size("prompt") > 0))


def union_cells(*frames: DataFrame) -> DataFrame:
    """Bag union of the cell lines' tables, by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def require_rows(df: DataFrame, reason: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"dataset is empty: {reason}")
    return df
