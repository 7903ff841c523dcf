"""Accuracy, confusion, class report and AUROC over evaluation results.

Result rows have ``pert, gene, cell_type, solution, extracted_answer`` and, where
calls could fail, ``api_error``. Every metric starts with one grouped count. A
frame with a column ``n`` holds counted rows (see ``eval_counts``), so a full
report reads the results once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcall.functions.labels import UNRESOLVED, gold_binary, pred_score
from strandcall.operators.ranges import with_range
from strandcall.vocab import CLASSES, NONE_EXTRACTED, NONE_OTHER

REPORT_LABELS = (*CLASSES, NONE_EXTRACTED)


def is_correct(answer: Column, solution: Column) -> Column:
    return F.coalesce(answer == solution, F.lit(False))


def failed(df: DataFrame) -> Column:
    return F.coalesce(F.col("api_error"), F.lit(False)) if "api_error" in df.columns else F.lit(False)


def with_correct(df: DataFrame) -> DataFrame:
    right = is_correct(F.col("extracted_answer"), F.col("solution")) & ~failed(df)
    return df.withColumn("is_correct", right)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 6)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def tally(df: DataFrame, condition: Column | None = None) -> Column:
    """Number of (counted) rows that meet a condition."""
    weight = F.col("n") if "n" in df.columns else F.lit(1)
    kept = weight if condition is None else F.when(condition, weight).otherwise(F.lit(0))
    return F.coalesce(F.sum(kept), F.lit(0)).cast("bigint")


def eval_counts(results: DataFrame) -> DataFrame:
    """Results counted by everything the reports look at."""
    return results.groupBy(
        "cell_type", "pert", "solution", "extracted_answer", failed(results).alias("api_error")
    ).agg(F.count(F.lit(1)).alias("n"))


def accuracy_counts(results: DataFrame) -> DataFrame:
    """Correct, evaluated and total rows per cell line and perturbation."""
    return (
        with_correct(results)
        .groupBy("cell_type", "pert")
        .agg(
            tally(results, F.col("is_correct")).alias("correct"),
            tally(results, ~failed(results)).alias("evaluated"),
            tally(results).alias("total"),
        )
    )


def accuracy(results: DataFrame, by: str | None = None, count_errors: bool | None = None) -> DataFrame:
    """Correct, denominator and percent, overall or by one column.

    Failed calls count in the denominator of a breakdown but not in the overall
    one; ``count_errors`` overrides that.
    """
    in_total = by is not None if count_errors is None else count_errors
    whole = F.lit(True) if in_total else ~failed(results)
    return (
        with_correct(results)
        .groupBy(*([by] if by else []))
        .agg(tally(results, F.col("is_correct")).alias("correct"), tally(results, whole).alias("evaluated"))
        .withColumn("accuracy_pct", percent(F.col("correct"), F.col("evaluated")))
    )


def accuracy_rollup(results: DataFrame) -> DataFrame:
    """Overall, per cell line and per perturbation accuracy from one pass.

    The rows are counted per (cell line, perturbation) first, so that the
    grouping sets multiply that small table and not the results.
    """
    counts = accuracy_counts(results)
    sets = counts.groupingSets(
        [[], [F.col("cell_type")], [F.col("pert")]], F.col("cell_type"), F.col("pert")
    ).agg(
        F.grouping("cell_type").alias("no_cell"),
        F.grouping("pert").alias("no_pert"),
        F.sum("correct").alias("correct"),
        F.sum("evaluated").alias("evaluated"),
        F.sum("total").alias("total"),
    )
    level = (
        F.when((F.col("no_cell") == 1) & (F.col("no_pert") == 1), "overall")
        .when(F.col("no_cell") == 0, "cell_type")
        .otherwise("pert")
    )
    whole = F.when(F.col("level") == "overall", F.col("evaluated")).otherwise(F.col("total"))
    return (
        sets.withColumn("level", level)
        .withColumn("evaluated", whole)
        .select(
            "level",
            F.coalesce("cell_type", "pert").alias("group_key"),
            "correct",
            "evaluated",
            percent(F.col("correct"), F.col("evaluated")).alias("accuracy_pct"),
        )
    )


def _label_table(df: DataFrame, name: str, labels: tuple[str, ...]) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("position"), F.lit(v).alias(name)) for i, v in enumerate(labels)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def prediction_distribution(results: DataFrame) -> DataFrame:
    """Count and share of each parsed answer, classes without rows included.

    Failed calls land in the last bucket but not in the denominator.
    """
    answer = F.col("extracted_answer")
    other = ~F.coalesce(answer.isin(*CLASSES), F.lit(False))
    counts = results.agg(
        tally(results, ~failed(results)).alias("evaluated"),
        *[tally(results, answer == word).alias(word) for word in CLASSES],
        tally(results, other).alias(NONE_OTHER),
    )
    rows = [F.struct(F.lit(word).alias("answer"), F.col(f"`{word}`").alias("n")) for word in (*CLASSES, NONE_OTHER)]
    return counts.select(F.inline(F.array(*rows)), "evaluated").withColumn(
        "pct", percent(F.col("n"), F.col("evaluated"))
    )


def confusion(results: DataFrame) -> DataFrame:
    """Rows per gold and predicted class; unusable answers are ``none_extracted``."""
    predicted = F.when(F.col("extracted_answer").isin(*CLASSES), F.col("extracted_answer")).otherwise(NONE_EXTRACTED)
    return results.groupBy(F.col("solution"), predicted.alias("predicted")).agg(tally(results).alias("n"))


def class_report(results: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, in report order."""
    gold, predicted = F.col("solution"), F.col("predicted")

    def side(label: Column, is_gold: bool, hit: Column) -> Column:
        return F.struct(label.alias("label"), F.lit(is_gold).alias("is_gold"), hit.alias("hit"))

    both = F.array(side(gold, True, gold == predicted), side(predicted, False, F.lit(False)))
    sides = confusion(results).select("n", F.inline(both))
    counts = sides.groupBy("label").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("is_gold"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("is_gold"), F.col("n")).otherwise(0)).alias("called"),
    )
    full = _label_table(results, "label", REPORT_LABELS).join(counts, "label", "left").na.fill(0)
    tp, support, called = F.col("tp"), F.col("support"), F.col("called")
    return full.select(
        "position",
        "label",
        ratio(tp, called).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + called).alias("f1"),
        "support",
        "tp",
    )


def class_report_averages(report: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages over all report labels."""
    n = F.sum("support")
    sums = report.agg(
        n.alias("support"),
        ratio(F.sum("tp"), n).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(c) * F.col("support")), n).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )

    def line(position: int, label: str, precision: str, recall: str, f1: str) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(label).alias("label"),
            F.col(precision).alias("precision"),
            F.col(recall).alias("recall"),
            F.col(f1).alias("f1"),
            F.col("support").alias("support"),
        )

    return sums.select(
        F.inline(
            F.array(
                line(10, "accuracy", "accuracy", "accuracy", "accuracy"),
                line(11, "macro avg", "macro_precision", "macro_recall", "macro_f1"),
                line(12, "weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"),
            )
        )
    )


# --- AUROC ---------------------------------------------------------------------

def score_rows(results: DataFrame, stage: str) -> DataFrame:
    """Binary gold and score; rows without a binary gold are dropped."""
    return (
        results.withColumn("y", gold_binary(F.col("solution"), stage))
        .withColumn("score", pred_score(F.col("extracted_answer"), stage))
        .where(F.col("y") != UNRESOLVED)
    )


def score_counts(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Positives ``p`` and negatives ``n`` per group and score."""
    return scored.groupBy(*by, "score").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")
    )


def auroc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve of ``score`` against ``y``, ties counted half.

    Null when a group has a single class (or fewer than two rows).
    """
    return auroc_of_counts(score_counts(scored, by), by)


def auroc_of_counts(score_table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """AUROC from ``score_counts`` of these or of finer groups.

    The number of negatives below a score is a running total over ranges of scores
    plus a running total inside the range, so that different scores do not meet in one
    task. The ranges are cut at quantiles of the counted scores, found by a sketch in the same
    query, so that each holds about as many different scores as any other, wherever they lie.
    """
    counts = score_table.groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    whole = counts.where(F.col("p") + F.col("n") >= 0)  # all of them; with the columns that are counted anyway, so that one shuffle serves both
    bucketed = with_range(counts, "score", "bucket", whole)
    before = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*by, "bucket").orderBy("score").rowsBetween(*before)
    across = Window.partitionBy(*by).orderBy("bucket").rowsBetween(*before)
    p, n = F.col("p").cast("double"), F.col("n")
    inner = p * (F.coalesce(F.sum("n").over(within), F.lit(0)) + n / 2.0)
    per_bucket = (
        bucketed.withColumn("inner", inner)
        .groupBy(*by, "bucket")
        .agg(F.sum("inner").alias("inner"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    )
    wins = F.col("inner") + p * F.coalesce(F.sum("n").over(across), F.lit(0))
    positives, negatives = F.col("positives"), F.col("negatives")
    area = F.round(F.col("wins") / (positives.cast("double") * negatives), 6)
    return (
        per_bucket.withColumn("wins", wins)
        .groupBy(*by)
        .agg(
            F.sum("wins").alias("wins"),
            F.coalesce(F.sum("p"), F.lit(0)).alias("positives"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"),
        )
        .select(*by, F.when((positives > 0) & (negatives > 0), area).alias("auroc"), "positives", "negatives")
    )


def auroc_summary(per_run: DataFrame, runs: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation over runs; runs without a value are left out.

    ``runs`` is the number of runs made: one that drew no row of a group is
    missing from ``per_run`` but still counts.
    """
    return per_run.groupBy(*by).agg(
        F.round(F.avg("auroc"), 6).alias("mean_auroc"),
        F.round(F.stddev_pop("auroc"), 6).alias("std_auroc"),
        F.count("auroc").alias("valid_runs"),
        F.lit(runs).cast("bigint").alias("runs"),
    )
