"""Readers for trees of paired CSV files, one pair per cell line.

The file name is the only place that holds the cell line. Columns may come in
any order and ``split`` may be missing, but a CSV schema is applied by position,
so files are grouped by their header line and each group is read with its own
schema. Only file names and header lines reach the driver.
"""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandcall.operators.splits import HAS_SPLIT, NO_HOLDOUT, parse_cell_lines, union_cells
from strandcall.vocab import SAMPLE_KEYS

# File name endings and columns of the tree.
SUFFIX = {"de": "-de.csv", "dir": "-dir.csv"}
REQUIRED = ("pert", "gene", "label")
OPTIONAL = ("split",)

TYPES = {"pert": T.StringType(), "gene": T.StringType(), "label": T.DoubleType(), "split": T.StringType()}
HEADER_READERS = 16

CALL_SCHEMA = "pert string, gene string, label double, split string, cell_type string, has_split boolean"
UNQUOTED = '(^|,)(?:"[^"]*+")++'  # a quoted field; what is left of a line has only the commas between fields
RAGGED = "_ragged"


@dataclass(frozen=True)
class CallFile:
    path: str
    cell_type: str
    header: tuple[str, ...]

    @property
    def missing(self) -> list[str]:
        return [c for c in REQUIRED if c not in self.header]


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of one CSV file; reads its first line only."""
    return tuple(spark.read.option("header", True).csv(path).columns)


def list_files(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Paths of one kind, sorted."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX[kind]}").load(folder).select("path")
    )
    return sorted(row.path for row in listing.collect())


def cell_of(path: str, kind: str) -> str:
    return os.path.basename(path)[: -len(SUFFIX[kind])]


def _with_headers(spark: SparkSession, paths: list[str], kind: str) -> list[CallFile]:
    """Open the first line of these files, several at a time."""
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(lambda p: header_of(spark, p), paths))
    return [CallFile(p, cell_of(p, kind), h) for p, h in zip(paths, headers)]


def _call_paths(spark: SparkSession, folder: str, kind: str) -> list[str]:
    paths = list_files(spark, folder, kind)
    if not paths:
        raise ValueError(f"no *{SUFFIX[kind]} files found in {folder}")
    return paths


def call_files(spark: SparkSession, folder: str, kind: str) -> list[CallFile]:
    return _with_headers(spark, _call_paths(spark, folder, kind), kind)


def _read_group(spark: SparkSession, files: list[CallFile], kind: str, ragged: str) -> DataFrame:
    header = files[0].header
    drop = ragged == "drop"
    schema = T.StructType([T.StructField(c, T.StringType() if drop else TYPES.get(c, T.StringType())) for c in header])
    reader = spark.read.option("header", True).option("escape", '"')
    if drop:  # only a wrong number of fields is marked in a schema of texts, and only if all of them are parsed
        schema = schema.add(RAGGED, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", RAGGED).option("columnPruning", False)
    # File names are URL-encoded; a plus sign is a plus sign there.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    rows = reader.schema(schema).csv([f.path for f in files])
    if drop:  # the second condition never holds; Spark refuses a count that looks at the mark alone
        rows = rows.where(F.col(RAGGED).isNull() | (F.length("pert") < 0))
    return (
        rows.select(
            *[F.col(c).try_cast(TYPES[c]).alias(c) if drop else c for c in (*REQUIRED, *OPTIONAL) if c in header],
            F.regexp_replace(name, rf"{SUFFIX[kind]}$", "").alias("cell_type"),
            F.lit("split" in header).alias(HAS_SPLIT),
        )
    )


def _read_files(spark: SparkSession, files: Iterable[CallFile], kind: str, ragged: str = "keep") -> DataFrame:
    groups: dict[tuple[str, ...], list[CallFile]] = {}
    for file in files:
        groups.setdefault(file.header, []).append(file)
    if not groups:
        return spark.createDataFrame([], CALL_SCHEMA)
    union = union_cells(*[_read_group(spark, group, kind, ragged) for group in groups.values()])
    if "split" not in union.columns:
        union = union.withColumn("split", F.lit(None).cast("string"))
    return union.select("pert", "gene", "label", "split", "cell_type", HAS_SPLIT)


def require_columns(columns: Iterable[str], required: Iterable[str], source: str, on_missing: str = "error") -> bool:
    """Whether all required columns are there; ``skip`` warns, ``error`` raises."""
    missing = [c for c in required if c not in set(columns)]
    if not missing:
        return True
    text = f"{source} lacks columns: {', '.join(missing)}"
    if on_missing == "error":
        raise ValueError(text)
    warnings.warn(text, stacklevel=2)
    return False


def file_report(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(cell_type, path, header, n_rows, n_short, n_long) of every file of one kind, as one job over all of them.

    The first line that isn't blank is the header; rows with fewer or more fields than it are counted. The scan shrinks
    to one row for each block of a file and number of fields before it is shuffled, a second one keeps the headers; no path reaches the driver.
    A file of blank lines has no header and no rows, one of no bytes is not listed by Spark. Quoted fields don't span lines, as in ``read_calls``.
    """
    glob = f"*{SUFFIX[kind]}"
    # File names are URL-encoded; a plus sign is a plus sign there.
    key, path = F.col("_metadata.file_path").alias("key"), F.url_decode(F.replace(F.col("key"), F.lit("+"), F.lit("%2B")))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(key)
    lines = spark.read.option("pathGlobFilter", glob).text(folder).where(F.trim("value") != "")
    bare = F.regexp_replace("value", UNQUOTED, "$1")
    fields = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","))) + 1
    block, line = F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    lines = lines.select(key, block, line, fields.alias("fields"), "value")  # a second scan gives lines the same numbers
    counted = lines.groupBy("key", "block", "fields").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))  # numbers only: hashed, not sorted
    files = counted.groupBy("key").agg(
        F.min(F.struct("block", "line", "fields")).alias("top"), F.collect_list(F.struct("fields", "n")).alias("sizes")
    )  # as many sizes as there are blocks and numbers of fields
    tops = files.select("key", "top.block", "top.line")
    heads = lines.join(F.broadcast(tops), ["key", "block", "line"]).select("key", "value")  # a line of each file

    def rows(wanted: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("sizes", lambda s: wanted(s["fields"])), F.lit(0).cast("long"), lambda n, s: n + s["n"])

    found = listed.join(files, "key", "left").join(heads, "key", "left").withColumn("width", F.col("top.fields"))
    names = F.split("value", ",")
    return found.select(
        F.regexp_replace(F.element_at(F.split(path, "/"), -1), rf"{re.escape(SUFFIX[kind])}$", "").alias("cell_type"),
        path.alias("path"),
        F.coalesce(F.transform(names, lambda c: F.btrim(F.btrim(c), F.lit('"'))), F.array().cast("array<string>")).alias("header"),
        F.coalesce(rows(lambda f: F.lit(True)) - 1, F.lit(0)).alias("n_rows"),
        F.coalesce(rows(lambda f: f < F.col("width")), F.lit(0)).alias("n_short"),
        F.coalesce(rows(lambda f: f > F.col("width")), F.lit(0)).alias("n_long"),
    )


def pair_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per cell line: its two paths, whether it can be loaded, and how many rows its files have.

    ``status`` is ``ok`` or ``skipped``; ``reason`` says why. A full outer join of the two listings: direction files
    without calls are listed as well. ``*_ragged`` counts rows with another number of fields than the header.
    """

    def side(kind: str) -> DataFrame:
        lacks = F.array_join(F.array_except(F.array(*map(F.lit, REQUIRED)), "header"), ", ")
        ragged = (F.col("n_short") + F.col("n_long")).alias(f"{kind}_ragged")
        return file_report(spark, folder, kind).select(
            "cell_type", F.col("path").alias(f"{kind}_path"), lacks.alias(f"{kind}_lacks"), F.col("n_rows").alias(f"{kind}_rows"), ragged
        )

    both = side("de").join(side("dir"), "cell_type", "full")
    reason = (
        F.when(F.col("de_path").isNull(), "no call file")
        .when(F.col("dir_path").isNull(), "no direction file")
        .when(F.col("de_lacks") != "", F.concat(F.lit("call file lacks "), "de_lacks"))
        .when(F.col("dir_lacks") != "", F.concat(F.lit("direction file lacks "), "dir_lacks"))
    )
    status = F.when(reason.isNull(), "ok").otherwise("skipped")
    counts = ("de_rows", "de_ragged", "dir_rows", "dir_ragged")
    return both.select("cell_type", "de_path", "dir_path", status.alias("status"), reason.alias("reason"), *counts)


def _pairs(
    spark: SparkSession, folder: str, wanted: Callable[[str], bool] = lambda cell: True
) -> list[tuple[tuple, CallFile, CallFile | None]]:
    """Pairs of the wanted cell lines; files of others, and files without a partner, are listed but not opened."""
    calls = {cell_of(p, "de"): p for p in _call_paths(spark, folder, "de")}
    partners = {cell_of(p, "dir"): p for p in list_files(spark, folder, "dir")}
    cells = [cell for cell in calls if wanted(cell)]
    paired = [cell for cell in cells if cell in partners]
    call_of = dict(zip(paired, _with_headers(spark, [calls[c] for c in paired], "de")))
    partner_of = dict(zip(paired, _with_headers(spark, [partners[c] for c in paired], "dir")))
    pairs = []
    for cell in cells:
        call, partner = call_of.get(cell) or CallFile(calls[cell], cell, ()), partner_of.get(cell)
        if partner is None:
            reason = "no direction file"
        elif call.missing:
            reason = f"call file lacks {', '.join(call.missing)}"
        elif partner.missing:
            reason = f"direction file lacks {', '.join(partner.missing)}"
        else:
            reason = None
        status = "skipped" if reason else "ok"
        row = (cell, call.path, partner.path if partner else None, status, reason)
        pairs.append((row, call, partner))
    return pairs


def _wanted(cell: str, split: str | None, lines: list[str]) -> bool:
    if not lines or split is None:
        return True
    return {"test": cell.lower() in lines, "train": cell.lower() not in lines}.get(split, False)


def read_calls(spark: SparkSession, folder: str, kind: str, ragged: str = "keep") -> DataFrame:
    """All files of one kind as one table with ``cell_type``; incomplete files are skipped.

    Rows with too few or too many fields: ``keep`` fills them up with nulls or cuts them, ``drop`` leaves them out.
    """
    files = call_files(spark, folder, kind)
    complete = [f for f in files if require_columns(f.header, REQUIRED, f.path, "skip")]
    return _read_files(spark, complete, kind, ragged)


def read_pairs(
    spark: SparkSession,
    folder: str,
    split: str | None = None,
    test_lines: str | None = None,
    keywords: tuple[str, ...] = NO_HOLDOUT,
    ragged: str = "keep",
) -> tuple[DataFrame, DataFrame]:
    """Calls and directions of every loadable cell line; ``ragged`` as in ``read_calls``.

    With a cell-line holdout the files of other lines are not opened at all.
    """
    lines = parse_cell_lines(test_lines, keywords)
    chosen = []
    for (cell, _, _, status, reason), call, partner in _pairs(spark, folder, lambda cell: _wanted(cell, split, lines)):
        if status != "ok":
            warnings.warn(f"cell line {cell} skipped: {reason}", stacklevel=2)
        else:
            chosen.append((call, partner))
    return (
        _read_files(spark, [c for c, _ in chosen], "de", ragged),
        _read_files(spark, [d for _, d in chosen], "dir", ragged),
    )


def read_single(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One direction file; ``split`` is required only if a split is asked for.

    ``label`` stays text: validity is judged by ``valid_labels``.
    """
    header = header_of(spark, path)
    wanted = (*REQUIRED, "split") if split is not None else REQUIRED
    require_columns(header, wanted, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    frame = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    frame = frame.select(*[c for c in (*REQUIRED, *OPTIONAL) if c in header])
    return frame if split is None else frame.where(F.col("split") == split)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys of used examples; a missing or incomplete file excludes nothing.

    Any other error is raised: used rows must not slip in because a file can't be read.
    """
    schema = ", ".join(f"{c} string" for c in SAMPLE_KEYS)
    try:
        header = header_of(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"exclusion file {path} is not there, nothing is excluded", stacklevel=2)
        return spark.createDataFrame([], schema)
    if not require_columns(header, SAMPLE_KEYS, path, "skip"):
        return spark.createDataFrame([], schema)
    return read_examples(spark, path).select(*SAMPLE_KEYS).distinct()


def read_examples(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Accepted examples; quoted text may span lines. Parquet is split, such CSV is not."""
    if format == "parquet":
        return spark.read.parquet(path)
    header = header_of(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
