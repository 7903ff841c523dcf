from pyspark.sql import functions as F

from strandcall.functions.labels import gold_binary, gold_trinary, label_text, pred_score, raw_label, repair_label
from strandcall.vocab import DOWN, UNCHANGED, UP


def test_raw_and_repaired_label(spark):
    cases = [
        (0.0, 1.0, 0, 0),
        (0.0, None, 0, 0),
        (1.0, 0.0, 1, 1),
        (1.0, 1.0, 2, 2),
        (1.0, None, -1, 0),
        (1.0, 3.0, -1, 0),
        (2.0, 1.0, -1, 0),
        (None, 1.0, -1, 0),
        (float("nan"), 0.0, -1, 0),
    ]
    df = spark.createDataFrame(cases, "is_de double, direction double, raw int, fixed int")
    raw = raw_label(F.col("is_de"), F.col("direction"))
    bad = df.where((raw != F.col("raw")) | (repair_label(raw) != F.col("fixed")))
    assert bad.count() == 0


def test_label_text(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (7,)], "label int")
    got = df.select(label_text(F.col("label")), label_text(F.col("label"), "binary")).collect()
    assert [tuple(r) for r in got] == [(UNCHANGED, "down"), (DOWN, "up"), (UP, None), (None, None)]


def test_scores(spark):
    df = spark.createDataFrame([(UP,), (DOWN,), (UNCHANGED,), ("other",), (None,)], "a string")
    a = F.col("a")
    got = df.select(
        gold_binary(a, "dif"),
        gold_binary(a, "dir"),
        gold_trinary(a),
        pred_score(a, "dif"),
        pred_score(a, "dir"),
        pred_score(a, "trinary"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (1, 1, 1, 1.0, 1.0, 1.0),
        (1, 0, 0, 1.0, 0.0, 0.0),
        (0, -1, 2, 0.0, 0.5, 2.0),
        (-1, -1, -1, 0.5, 0.5, 0.5),
        (-1, -1, -1, 0.5, 0.5, 0.5),
    ]
