"""Writers for examples, results and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.operators.curation import EXAMPLE_COLUMNS


def example_path(
    base: str,
    model: str,
    script: str,
    test_lines: str | None = "none",
    generator_checklist: bool = False,
    critic_checklist: bool = False,
    ratings: Sequence[str] = ("good",),
) -> str:
    """Folder of an example set: model, script, split, then prompt modes and threshold."""
    split_name = "default" if test_lines in (None, "none") else test_lines
    generator = "generator_lemmas" if generator_checklist else "default_generator_prompt"
    critic = "critic_lemmas" if critic_checklist else "default_prompt"
    name = f"{generator}_critic_{critic}_{','.join(ratings)}_critic_threshold"
    return f"{base.rstrip('/')}/{model}/{script}/{split_name}_split/{name}"


def write_examples(examples: DataFrame, path: str, format: str = "parquet") -> None:
    """Accepted examples in file layout; quotes are doubled in CSV."""
    writer = examples.select(*EXAMPLE_COLUMNS).write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines; missing answers are written as null."""
    results.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Text of ``(section, position, line)`` rows; part files follow the order."""
    ordered = report.orderBy("section", "position").select(F.col("line").alias("value"))
    ordered.write.mode("overwrite").text(path)
