"""Entry 2: from test samples and model responses to reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.functions.text import last_content, last_user_excerpt, with_answer
from strandcall.operators import metrics
from strandcall.operators.batching import assign_batches
from strandcall.operators.curation import attach_responses, failed_batches, with_failures
from strandcall.operators.ordering import number_copies
from strandcall.operators.sampling import RUN, repeated_samples
from strandcall.plans.reports import auroc_lines, class_report_lines, report_lines
from strandcall.session import stage
from strandcall.vocab import SAMPLE_KEYS

# Number and share of the AUROC subsets.
AUROC_RUNS = 3
AUROC_FRACTION = 0.20
# Text of a failed call in a result file.
ERROR_TEXT = "Error: call failed"


@dataclass(frozen=True)
class Evaluation:
    results: DataFrame
    counts: DataFrame
    levels: DataFrame
    classes: DataFrame
    statistics: DataFrame
    class_lines: DataFrame


def parse_results(responses: DataFrame) -> DataFrame:
    """Results with the parsed answer and its correctness; a failed call has no answer."""
    parsed = with_answer(responses)
    if "api_error" in parsed.columns:
        parsed = parsed.withColumn("extracted_answer", F.when(~metrics.failed(parsed), F.col("extracted_answer")))
    return metrics.with_correct(parsed)


def eval_requests(samples: DataFrame, size: int, seed: int) -> DataFrame:
    """Samples with ``sample_id`` and ``batch_id``, one row per call to make."""
    narrow = samples.select(*SAMPLE_KEYS, "label", "solution")
    return assign_batches(narrow, size, seed, SAMPLE_KEYS).withColumnRenamed("row_index", "sample_id")


def answered_samples(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their responses; one missing response fails its batch.

    Failure is decided on ids alone, before the one join that carries texts.
    """
    has = responses.select("sample_id", F.col("generated_text").isNotNull().alias("answered"))
    asked = attach_responses(requests.select("sample_id", "batch_id"), has, ["sample_id"])
    failed = failed_batches(asked.where(~F.coalesce("answered", F.lit(False))))
    flagged = with_failures(requests, failed)
    return attach_responses(flagged, responses, ["sample_id"])


def result_records(results: DataFrame) -> DataFrame:
    """Parsed results (with ``prompt``) in the layout of a result file."""
    error = metrics.failed(results)
    return results.select(
        F.when(error, last_user_excerpt(F.col("prompt"))).otherwise(last_content(F.col("prompt"))).alias("user_prompt"),
        *SAMPLE_KEYS,
        F.when(error, F.lit(ERROR_TEXT)).otherwise(F.col("generated_text")).alias("generated_text"),
        "extracted_answer",
        F.col("solution").alias("correct_solution"),
        "is_correct",
        error.alias("api_error"),
    )


def evaluate(responses: DataFrame) -> Evaluation:
    """Every report of one evaluation.

    Texts are parsed once; all reports are derived from the counted results,
    which are written down because several frames start from them.
    """
    results = parse_results(responses)
    counts = stage(metrics.eval_counts(results), "counts")
    return Evaluation(
        results=results,
        counts=counts,
        levels=metrics.accuracy_rollup(counts),
        classes=metrics.class_report(counts),
        statistics=report_lines(counts),
        class_lines=class_report_lines(counts),
    )


def auroc_runs(
    results: DataFrame,
    stage_name: str,
    keys: tuple[str, ...],
    seed: int,
    runs: int = AUROC_RUNS,
    fraction: float = AUROC_FRACTION,
    by_cell: bool = False,
) -> DataFrame:
    """AUROC of each run, overall or per cell line; every run is scored."""
    sampled = repeated_samples(results, runs, fraction, seed, keys, stage_name)
    by = (RUN, "cell_type") if by_cell else (RUN,)
    return metrics.auroc(metrics.score_rows(sampled, stage_name), by)


def auroc_report(
    responses: DataFrame, stage_name: str, keys: tuple[str, ...], seed: int, runs: int = AUROC_RUNS
) -> DataFrame:
    """Text lines of the summary over runs, from results parsed once and sampled once.

    Rows are drawn, not keys. Scores are counted per run and cell line; the
    overall figures come from the same counts.
    """
    narrow = with_answer(responses).select(*dict.fromkeys([*keys, "cell_type"]), "solution", "extracted_answer")
    results = stage(number_copies(narrow, keys), "results")
    sampled = repeated_samples(results, runs, AUROC_FRACTION, seed, [*keys, "occurrence"], stage_name)
    counts = stage(metrics.score_counts(metrics.score_rows(sampled, stage_name), (RUN, "cell_type")), "scores")
    overall = metrics.auroc_of_counts(counts, (RUN,))
    cells = metrics.auroc_of_counts(counts, (RUN, "cell_type"))
    by_cell = metrics.auroc_summary(cells, runs, ("cell_type",))
    return auroc_lines(metrics.auroc_summary(overall, runs), by_cell, overall, stage_name, runs, AUROC_FRACTION)
