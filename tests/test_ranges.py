"""Even ranges of scores, and numbers inside a frequent key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandcall.operators import metrics, ranges
from strandcall.operators.ordering import number_copies


@pytest.mark.parametrize(
    "score", ["5000 + rand(1)", "exp(40 * rand(1))", "-1e9 + rand(1) * 1e-3", "if(id % 2 = 0, 7e5 + rand(1), rand(2))"]
)
def test_ranges_are_even(spark, score):
    """200,000 scores in any band: no range has more than twice the mean, and their order is that of the scores."""
    df = spark.range(200_000).selectExpr("id", f"{score} score")
    placed = ranges.with_range(df, "score", "part").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("a"), F.max("score").alias("b"))
    found = placed.orderBy("part").collect()
    assert len(found) > ranges.RANGES * 0.9
    assert max(r.n for r in found) < 2 * 200_000 / len(found)
    assert all(x.b < y.a for x, y in zip(found, found[1:]))


def test_odd_scores(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),), (1.0,), (float("inf"),), (1.0,)], "score double")
    found = {repr(r.score): r.part for r in ranges.with_range(rows, "score", "part").collect()}
    assert found["None"] == 0 and found["-inf"] <= found["1.0"] <= found["inf"] <= found["nan"]
    assert ranges.with_range(rows.limit(0), "score", "part").collect() == []


def test_auroc_of_a_narrow_band(spark):
    """Against the definition by pairs, on scores that no fixed buckets tell apart."""
    rows = [(i, 1 if i * 37 % 11 < 5 else 0, 5000 + (i * 7919 % 1009) / 1e5) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, y int, score double")
    positive, negative = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in positive for n in negative) / len(positive) / len(negative)
    assert metrics.auroc(df).first().auroc == pytest.approx(want, abs=1e-6)


def test_one_shuffle_serves_counts_and_ranges(spark):
    df = spark.range(100_000).selectExpr("int(id % 2) y", "5000 + rand(1) score")
    counted = metrics.auroc(df)
    counted.collect()
    plan = counted._jdf.queryExecution().toString()
    assert "Subquery" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_frequent_key_is_numbered_in_many_tasks(spark):
    """Half of all rows share a key: its ranges are many, and numbers run through in the order of the other columns."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        df = spark.range(20_000).selectExpr("if(id % 2 = 0, null, concat('k', id % 50)) key", "int(id * 7919 % 6007) v")
        found = number_copies(df, ["key"])
        order = Window.partitionBy("key").orderBy("v", "occurrence")
        assert found.withColumn("want", F.row_number().over(order) - 1).where("want <> occurrence").count() == 0
        assert found.count() == 20_000 and found.where("key is null").agg(F.countDistinct("occurrence")).first()[0] == 10_000
        spread = df.repartitionByRange("key", "v").groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("key").isNull()).alias("n")).collect()
        assert sum(r.n > 0 for r in spread) >= 3 and max(r.n for r in spread) < 6000
    finally:
        spark.conf.set(name, before)


NUMBERED = "if(id % 2 = 0, null, concat('k', id % 50)) key", "int(id % 7) other", "int(id * 7919 % 601) v"


def test_keys_without_frequent_ones_are_numbered_behind_one_shuffle(spark):
    found = number_copies(spark.range(4000).selectExpr(*NUMBERED), ["key", "other"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("Initial Plan")[0].count("Exchange ") == 1


@pytest.mark.parametrize("keys", [["key"], ["key", "other"], ["key", "other", "v"]])
@pytest.mark.parametrize("most", [1, 100, 4000])
def test_frequent_and_other_keys_are_numbered_alike(spark, rows, keys, most):
    """Buckets of over 100 rows hold the null key only, those of over one row all keys, of over 4000 none; null keys and equal rows are numbered as well."""
    df = spark.range(4000).selectExpr(*NUMBERED)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy("key", "other", "v")) - 1
    found = number_copies(df, keys, most=most)
    assert found.columns == [*df.columns, "occurrence"] and found.schema["occurrence"].dataType.simpleString() == "bigint"
    assert rows(found) == rows(df.withColumn("occurrence", plain))
