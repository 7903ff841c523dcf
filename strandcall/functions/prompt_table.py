"""Prompts whose mode is a column: templates as a table that rows are joined to.

Each template is cut into pieces of literal text and the placeholder behind it. A table has one
row for a mode with its pieces in order; a row of samples meets the pieces of its own
mode and folds them, so that one table holds rows of several modes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcall.functions import prompts as P

PIECE = "array<struct<literal:string,placeholder:string>>"
FIELDS = ("pert", "gene", "cell_type", "answer")


def _pieces(template: str) -> Column:
    each = [F.struct(F.lit(text).alias("literal"), F.lit(field).alias("placeholder")) for text, field in P.parts(template)]
    return F.array(*each).cast(PIECE)


def template_table(spark: SparkSession, modes: tuple[str, ...] = tuple(P.SYSTEM_TEMPLATES)) -> DataFrame:
    """(mode, tool, system_pieces, user_pieces): two rows for each mode, without and with the tool's wording."""
    rows = [
        F.struct(
            F.lit(mode).alias("mode"), F.lit(tool).alias("tool"),
            _pieces(P.system_template(mode, tool)).alias("system_pieces"), _pieces(P.user_template(mode)).alias("user_pieces"),
        )
        for mode in modes
        for tool in (False, True)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def piece_rows(templates: DataFrame, pieces: str) -> DataFrame:
    """(mode, tool, position, literal, placeholder): the templates as plain rows, to be stored or edited."""
    return templates.select("mode", "tool", F.posexplode(pieces).alias("position", "piece")).select("mode", "tool", "position", "piece.*")


def from_rows(rows: DataFrame, pieces: str) -> DataFrame:
    """Templates from plain rows: as many pieces of a mode as its template has."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "literal", "placeholder")))
    plain = F.transform(ordered, lambda p: F.struct(p["literal"].alias("literal"), p["placeholder"].alias("placeholder")))
    return rows.groupBy("mode", "tool").agg(plain.cast(PIECE).alias(pieces))


def folded(pieces: Column, value: Callable[[Column], Column]) -> Column:
    """The text of a row's pieces; a placeholder without a value makes the text missing, as in ``render``."""

    def add(text: Column, piece: Column) -> Column:
        field = piece["placeholder"]
        return F.concat(text, F.coalesce(piece["literal"], F.lit("")), F.when(field.isNull(), F.lit("")).otherwise(value(field)))

    return F.aggregate(pieces, F.lit(""), add)


def with_prompts(samples: DataFrame, templates: DataFrame, mode: str = "mode", tool: Column | None = None) -> DataFrame:
    """Add ``system``, ``user`` and ``problem`` to samples whose column ``mode`` names their template.

    ``problem`` names a mode that no template has; such rows have no prompts, and the others are not
    touched by them. A missing mode is a problem too. Samples have ``pert, gene, cell_type, solution``.
    """
    asked = samples.withColumn("_tool", F.lit(False) if tool is None else F.coalesce(tool, F.lit(False)))
    named = templates.select(F.col("mode").alias("_mode"), F.col("tool").alias("_with"), "system_pieces", "user_pieces")
    joined = asked.join(named, (F.col(mode) == F.col("_mode")) & (F.col("_tool") == F.col("_with")), "left")
    values = {"pert": F.col("pert"), "gene": F.col("gene"), "cell_type": F.col("cell_type"), "answer": F.col("solution")}

    def value(field: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for name in FIELDS:
            chosen = F.when(field == name, values[name]).otherwise(chosen)
        return chosen

    unknown = F.concat(F.lit("unknown prompt mode: "), F.coalesce(F.col(mode), F.lit("none")))
    return joined.select(
        *samples.columns,
        folded(F.col("system_pieces"), value).alias("system"),
        folded(F.col("user_pieces"), value).alias("user"),
        F.when(F.col("_mode").isNull(), unknown).alias("problem"),
    )
