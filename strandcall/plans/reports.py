"""Text reports: lines of formatted metrics with an order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcall.operators import metrics
from strandcall.operators.metrics import REPORT_LABELS

# Lines of the reports.
OVERALL_TITLE = "--- Overall Evaluation Summary ---"
EVALUATED_LINE = "Total Samples Evaluated: "
CORRECT_LINE = "Correct Predictions: "
ACCURACY_LINE = "Overall Accuracy: "
DISTRIBUTION_TITLE = "--- Predicted Answer Distribution (Model Output) ---"
CELL_TITLE = "--- Accuracy by Cell Type ---"
PERT_TITLE = "--- Accuracy by Perturbation ---"
AUROC_TITLE = "--- AUROC Evaluation Summary ---"
AUROC_KINDS = {
    "dir": (
        "Evaluation Type: Differentiating 'upregulated' vs 'downregulated'",
        "Method: Random percentage subset taken from base, THEN subset filtered for up/down.",
    ),
    "dif": (
        "Evaluation Type: Differentiating 'differentially expressed' (up/down) vs 'not differentially expressed'",
        "Method: Random percentage subset taken from base.",
    ),
}
AUROC_RUNS_LINE = "Number of AUROC runs (each with a fresh random subset): "
AUROC_SHARE_LINE = "Initial subset size per run: {share} of available base AUROC data"
AUROC_EACH = "Individual Overall AUROCs per run: ["
NO_AUROC = "No valid Overall AUROC scores calculated across any run."
AUROC_CELLS_TITLE = "Mean Per-Cell-Type AUROC across runs:"
NO_CELLS = "  No per-cell-type AUROC data available or calculated."
AUROC_END = "--- End of AUROC Evaluation ---"
NO_REPORT = "  Not enough data to generate classification report."
AVERAGES = ("accuracy", "macro avg", "weighted avg")


def two_decimals(part: Column, whole: Column, scale: int = 100) -> Column:
    """``scale * part / whole`` with two decimals, in whole numbers; 0 of nothing is 0.00."""
    cents = F.when(
        whole > 0, F.call_function("div", part * (200 * scale) + whole, whole * 2)
    ).otherwise(F.lit(0).cast("bigint"))
    units, rest = F.call_function("div", cents, F.lit(100)), cents % 100
    return F.concat(units.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 2, "0"))


def _line(section: int, position: Column, text: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), position.alias("position"), text.alias("line"))


def report_lines(results: DataFrame) -> DataFrame:
    """Overall, distribution, per cell line and per perturbation lines."""
    counts = results if "n" in results.columns else metrics.eval_counts(results)
    pct = two_decimals(F.col("correct"), F.col("evaluated"))
    share = two_decimals(F.col("n"), F.col("evaluated"))
    first, text = F.lit(""), F.col("line")

    levels = metrics.accuracy_rollup(counts)
    overall = levels.where(F.col("level") == "overall").select(
        F.inline(
            F.array(
                _line(1, F.lit("1"), F.lit(OVERALL_TITLE)),
                _line(1, F.lit("2"), F.concat(F.lit(EVALUATED_LINE), F.col("evaluated").cast("string"))),
                _line(1, F.lit("3"), F.concat(F.lit(CORRECT_LINE), F.col("correct").cast("string"))),
                _line(1, F.lit("4"), F.concat(F.lit(ACCURACY_LINE), pct, F.lit("%"))),
            )
        )
    )
    groups = levels.where(F.col("level") != "overall").select(
        F.when(F.col("level") == "cell_type", 3).otherwise(4).alias("section"),
        F.coalesce("group_key", F.lit("")).alias("position"),
        F.format_string("  %s: %s%% (%d/%d)", "group_key", pct, "correct", "evaluated").alias("line"),
    )
    answers = metrics.prediction_distribution(counts).select(
        F.lit(2).alias("section"),
        F.col("answer").alias("position"),
        F.format_string("  Predicted as '%s': %d times (%s%%)", "answer", "n", share).alias("line"),
    )
    titles = counts.sparkSession.range(1).select(
        F.inline(
            F.array(
                _line(2, first, F.lit(DISTRIBUTION_TITLE)),
                _line(3, first, F.lit(CELL_TITLE)),
                _line(4, first, F.lit(PERT_TITLE)),
            )
        )
    )
    return overall.unionByName(titles).unionByName(answers).unionByName(groups).select("section", "position", text)


def class_report_lines(results: DataFrame) -> DataFrame:
    """The class report as text: header, classes, accuracy, averages; columns are aligned.

    Accuracy has a single value. Without any row there is one line that says so.
    """
    width = max(map(len, (*REPORT_LABELS, *AVERAGES)))
    report = metrics.class_report(results)
    rows = report.drop("tp").unionByName(metrics.class_report_averages(report)).withColumn("all", F.max("support").over(Window.partitionBy()))
    numbers = [F.format_string("%9.2f", c) for c in ("precision", "recall", "f1")]
    blank = F.lit(" " * 9)
    single = F.col("label") == "accuracy"
    cells = [F.when(single, blank).otherwise(numbers[0]), F.when(single, blank).otherwise(numbers[1]), numbers[2]]
    row = F.concat_ws(" ", F.lpad("label", width, " "), *cells, F.format_string("%9d", "support"))
    lines = rows.where(F.col("all") > 0).select(
        F.lit(1).alias("section"), F.concat(F.lit("b"), F.lpad(F.col("position").cast("string"), 2, "0")).alias("position"), row.alias("line")
    )
    names = ("precision", "recall", "f1-score", "support")
    header = " ".join([" " * width, *(f"{n:>9}" for n in names)])
    some = report.agg((F.sum("support") > 0).alias("some"))
    fixed = F.array(_line(1, F.lit("a"), F.lit(header)), _line(1, F.lit("a1"), F.lit("")), _line(1, F.lit("b09"), F.lit("")))
    none = F.array(_line(1, F.lit("a"), F.lit(NO_REPORT)))
    return some.select(F.inline(F.when(F.col("some"), fixed).otherwise(none))).unionByName(lines)


def auroc_lines(overall: DataFrame, per_cell: DataFrame, per_run: DataFrame, stage: str, runs: int, fraction: float) -> DataFrame:
    """The AUROC report as text.

    ``overall`` and ``per_cell`` are summaries over runs, ``per_run`` has the value of
    each run; a run without a row or a value is shown as such.
    """

    def value(prefix: Column) -> Column:
        return F.concat(
            prefix,
            F.format_string(": %.4f (Std: %.4f, Valid Runs: %d/%d)", "mean_auroc", "std_auroc", "valid_runs", "runs"),
        )

    kind, method = AUROC_KINDS["dir" if stage == "dir" else "dif"]
    head = [AUROC_TITLE, kind, method, f"{AUROC_RUNS_LINE}{runs}", AUROC_SHARE_LINE.format(share=f"{fraction * 100:.0f}%"), ""]
    texts = [_line(1, F.lit(str(k)), F.lit(t)) for k, t in enumerate(head)]
    tail = [_line(3, F.lit("0"), F.lit("")), _line(3, F.lit("1"), F.lit(AUROC_CELLS_TITLE)), _line(5, F.lit("0"), F.lit("")), _line(5, F.lit("1"), F.lit(AUROC_END))]
    fixed = overall.sparkSession.range(1).select(F.inline(F.array(*texts, *tail)))

    shown = F.coalesce(F.format_string("%.4f", F.max("auroc")), F.lit("N/A"))
    numbers = per_run.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run"))
    values = numbers.join(per_run.select("run", "auroc"), "run", "left").groupBy("run").agg(
        F.concat(F.lit("'"), F.when(F.max("auroc").isNull(), F.lit("N/A")).otherwise(shown), F.lit("'")).alias("shown")
    )
    listed = values.agg(F.array_sort(F.collect_list(F.struct("run", "shown"))).alias("all"))  # a value for each run
    summary = overall.agg(F.max(F.struct("valid_runs", "mean_auroc", "std_auroc", "runs")).alias("s")).select("s.*", F.lit(1).alias("one"))
    both = summary.join(listed.withColumn("one", F.lit(1)), "one")  # one row each
    is_valid = F.coalesce(F.col("valid_runs") > 0, F.lit(False))
    mean = both.select(
        F.inline(
            F.when(
                is_valid,
                F.array(
                    _line(2, F.lit("0"), value(F.lit("Mean Overall AUROC across runs"))),
                    _line(2, F.lit("1"), F.concat(F.lit(AUROC_EACH), F.array_join("all.shown", ", "), F.lit("]"))),
                ),
            ).otherwise(F.array(_line(2, F.lit("0"), F.lit(NO_AUROC))))
        )
    )
    cells = per_cell.select(
        F.lit(4).alias("section"),
        F.coalesce("cell_type", F.lit("")).alias("position"),
        F.when(F.col("valid_runs") > 0, value(F.concat(F.lit("  "), F.col("cell_type"))))
        .otherwise(F.concat(F.lit("  "), F.col("cell_type"), F.lit(": Not calculable or no valid scores in any run.")))
        .alias("line"),
    )
    no_cells = per_cell.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(
        F.lit(4).alias("section"), F.lit("").alias("position"), F.lit(NO_CELLS).alias("line")
    )
    return fixed.unionByName(mean).unionByName(cells).unionByName(no_cells)
