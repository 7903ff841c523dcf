import random

import pytest
from pyspark.sql import functions as F

from strandcall.operators import metrics as M
from strandcall.plans.reports import auroc_lines, class_report_lines, report_lines, two_decimals
from strandcall.vocab import DOWN, UNCHANGED, UP

SCHEMA = "cell_type string, pert string, solution string, extracted_answer string, api_error boolean"
DATA = [
    ("k", "A", UP, UP, False),
    ("k", "A", UP, DOWN, False),
    ("k", "B", DOWN, DOWN, None),
    ("h", "B", DOWN, None, False),
    ("h", "B", UNCHANGED, UNCHANGED, False),
    ("h", "C", UNCHANGED, UP, False),
    ("h", "C", UP, None, True),
    ("h", "C", UP, None, True),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(DATA, SCHEMA)


@pytest.fixture(scope="module", params=["rows", "counted"])
def source(request, results):
    return results if request.param == "rows" else M.eval_counts(results)


def test_accuracy(source, rows):
    assert rows(M.accuracy(source)) == [(3, 6, 50.0)]
    assert rows(M.accuracy(source, count_errors=True)) == [(3, 8, 37.5)]
    assert rows(M.accuracy(source, "cell_type")) == [("h", 1, 5, 20.0), ("k", 2, 3, 66.666667)]
    assert rows(M.accuracy(source, "pert")) == [("A", 1, 2, 50.0), ("B", 2, 3, 66.666667), ("C", 0, 3, 0.0)]


def test_accuracy_of_nothing(source, rows):
    assert rows(M.accuracy(source.where(F.lit(False)))) == [(0, 0, 0.0)]


def test_rollup_agrees_with_single_groupings(source, rows):
    levels = M.accuracy_rollup(source)
    for level, by in (("overall", None), ("cell_type", "cell_type"), ("pert", "pert")):
        part = rows(levels.where(F.col("level") == level).drop("level"))
        single = rows(M.accuracy(source, by))
        assert [r[1:] for r in part] == [r[-3:] for r in single]


def test_distribution(source, rows):
    assert rows(M.prediction_distribution(source)) == sorted(
        [(UP, 2, 6, 33.333333), (DOWN, 2, 6, 33.333333), (UNCHANGED, 1, 6, 16.666667), ("None/Other", 3, 6, 50.0)],
        key=repr,
    )


def test_confusion_and_report(source, rows):
    assert rows(M.confusion(source)) == sorted(
        [
            (UP, UP, 1),
            (UP, DOWN, 1),
            (UP, "none_extracted", 2),
            (DOWN, DOWN, 1),
            (DOWN, "none_extracted", 1),
            (UNCHANGED, UNCHANGED, 1),
            (UNCHANGED, UP, 1),
        ],
        key=repr,
    )
    report = M.class_report(source)
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in report.collect()}
    assert got == {
        UP: (0.5, 0.25, pytest.approx(1 / 3), 4),
        DOWN: (0.5, 0.5, 0.5, 2),
        UNCHANGED: (1.0, 0.5, pytest.approx(2 / 3), 2),
        "none_extracted": (0.0, 0.0, 0.0, 0),
    }
    averages = {r.label: r for r in M.class_report_averages(report).collect()}
    assert averages["accuracy"].f1 == 3 / 8
    assert averages["macro avg"].precision == 0.5
    assert averages["macro avg"].recall == 0.3125
    assert averages["weighted avg"].recall == 3 / 8
    assert averages["weighted avg"].precision == pytest.approx((0.5 * 4 + 0.5 * 2 + 1.0 * 2) / 8)
    assert {r.support for r in averages.values()} == {8}


def test_report_text(source):
    lines = [r.line for r in report_lines(source).orderBy("section", "position").collect()]
    assert lines[:4] == [
        "--- Overall Evaluation Summary ---",
        "Total Samples Evaluated: 6",
        "Correct Predictions: 3",
        "Overall Accuracy: 50.00%",
    ]
    assert "  Predicted as 'None/Other': 3 times (50.00%)" in lines
    assert lines[lines.index("--- Accuracy by Cell Type ---") + 1 :][:2] == ["  h: 20.00% (1/5)", "  k: 66.67% (2/3)"]
    assert lines[-1] == "  C: 0.00% (0/3)"
    text = [r.line for r in class_report_lines(source).orderBy("position").collect()]
    assert text[0].split() == ["precision", "recall", "f1-score", "support"] and text[1] == ""
    assert text[2].split() == ["upregulated", "0.50", "0.25", "0.33", "4"]
    assert text[6] == "" and text[7].split()[0] == "accuracy" and len(text[7].split()) == 3
    assert text[-1].split()[:2] == ["weighted", "avg"] and text[-1].split()[-1] == "8"
    assert {len(t) for t in text if t} == {len(text[0])}


def test_two_decimals(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (0, 5), (5, 5), (1, 0), (1, 800)], "a bigint, b bigint")
    got = [r[0] for r in df.select(two_decimals(F.col("a"), F.col("b"))).collect()]
    assert got == ["33.33", "66.67", "0.00", "100.00", "0.00", "0.13"]


def brute_auroc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def scores(kind, rng):
    return {
        "ties": lambda: rng.choice([0.0, 0.5, 1.0]),
        "continuous": rng.random,
        "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
        "narrow": lambda: 0.5 + rng.random() * 1e-9,
        "constant": lambda: 0.5,
    }[kind]


@pytest.mark.parametrize("kind", ["ties", "continuous", "wide", "narrow", "constant"])
def test_auroc(spark, kind):
    rng = random.Random(kind)
    draw = scores(kind, rng)
    data = [(rng.choice("abc"), rng.choice([0, 1]), draw()) for _ in range(300)] + [("single", 1, 0.5)]
    df = spark.createDataFrame(data, "cell_type string, y int, score double")
    overall = M.auroc(df).first().auroc
    assert overall == pytest.approx(brute_auroc([r[1:] for r in data]), abs=1e-6)
    for row in M.auroc(df, ("cell_type",)).collect():
        want = brute_auroc([r[1:] for r in data if r[0] == row.cell_type])
        assert row.auroc == (None if want is None else pytest.approx(want, abs=1e-6))
    inverted = M.auroc(df.withColumn("score", -F.col("score"))).first().auroc
    assert inverted == pytest.approx(1 - overall, abs=2e-6)


def test_auroc_of_nothing(spark, rows):
    empty = spark.createDataFrame([], "y int, score double")
    assert rows(M.auroc(empty)) == [(None, 0, 0)]


def test_score_rows_drop_unusable_gold(results):
    assert M.score_rows(results, "dif").count() == 8
    assert M.score_rows(results, "dir").count() == 6


def test_summary_leaves_out_invalid_runs(spark, rows):
    runs = spark.createDataFrame(
        [(1, "k", 0.5), (2, "k", 0.7), (3, "k", None), (1, "h", None)], "run int, cell_type string, auroc double"
    )
    assert rows(M.auroc_summary(runs, 3, ("cell_type",))) == [("h", None, None, 0, 3), ("k", 0.6, 0.1, 2, 3)]
    overall = M.auroc_summary(runs.where("cell_type = 'k'"), 3)
    by_cell = M.auroc_summary(runs, 3, ("cell_type",))
    report = auroc_lines(overall, by_cell, runs.where("cell_type = 'k'"), "dir", 3, 0.2)
    lines = [r.line for r in report.orderBy("section", "position").collect()]
    assert lines[0] == "--- AUROC Evaluation Summary ---"
    assert lines[3:6] == [
        "Number of AUROC runs (each with a fresh random subset): 3",
        "Initial subset size per run: 20% of available base AUROC data",
        "",
    ]
    assert lines[6] == "Mean Overall AUROC across runs: 0.6000 (Std: 0.1000, Valid Runs: 2/3)"
    assert lines[7] == "Individual Overall AUROCs per run: ['0.5000', '0.7000', 'N/A']"
    assert lines[10] == "  h: Not calculable or no valid scores in any run."
    assert lines[-1] == "--- End of AUROC Evaluation ---"
    none = auroc_lines(M.auroc_summary(runs.limit(0), 3), by_cell.limit(0), runs.limit(0), "dif", 3, 0.2)
    lines = [r.line for r in none.orderBy("section", "position").collect()]
    assert "No valid Overall AUROC scores calculated across any run." in lines
    assert "  No per-cell-type AUROC data available or calculated." in lines
