import pytest
from pyspark.sql import functions as F

from strandcall.operators import splits as S


@pytest.fixture(scope="module")
def calls(spark):
    data = [
        ("a", "HepG2", "train", True),
        ("b", "HepG2", "test", True),
        ("c", "K562", None, True),
        ("d", "Jurkat", None, False),
        ("e", "K562", "test", True),
    ]
    return spark.createDataFrame(data, "pert string, cell_type string, split string, has_split boolean")


def perts(df):
    return "".join(sorted(r.pert for r in df.select("pert").collect()))


def test_parse_cell_lines():
    assert S.parse_cell_lines(" HepG2, ,jurkat,") == ["hepg2", "jurkat"]
    for off in (None, "", "none", "None", "DEFAULT", " , "):
        assert S.parse_cell_lines(off) == []
    assert S.parse_cell_lines("default", keywords=("none",)) == ["default"]


def test_row_split(calls):
    assert perts(S.filter_split(calls, "train")) == "ad"
    assert perts(S.filter_split(calls, "test")) == "bde"
    assert perts(S.filter_split(calls, None)) == "abcde"
    assert perts(S.filter_split(calls.drop("has_split"), "test")) == "be"
    with pytest.warns(UserWarning):
        assert perts(S.filter_split(calls.drop("split", "has_split"), "test")) == "abcde"


def test_holdout(calls):
    lines = "HEPG2, jurkat"
    assert perts(S.filter_holdout(calls, "test", lines)) == "abd"
    assert perts(S.filter_holdout(calls, "train", lines)) == "ce"
    assert perts(S.filter_holdout(calls, None, lines)) == "abcde"
    with pytest.warns(UserWarning):
        assert perts(S.filter_holdout(calls, "valid", lines)) == ""
    assert perts(S.filter_holdout(calls, "test", "none")) == "bde"
    assert perts(S.filter_holdout(calls, "test", " , ")) == "bde"


def test_holdout_cells(calls, rows):
    assert rows(S.holdout_cells(calls, "hepg2,absent")) == [("hepg2", "test"), ("jurkat", "train"), ("k562", "train")]
    assert {r[1] for r in rows(S.holdout_cells(calls, "none"))} == {"train"}


def test_split_filter_reaches_the_scan(spark, tmp_path, calls):
    calls.drop("has_split").write.parquet(str(tmp_path / "calls"))
    df = S.filter_split(spark.read.parquet(str(tmp_path / "calls")), "test")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(split,test)" in plan


def test_require_rows(calls):
    assert S.require_rows(calls, "x") is calls
    with pytest.raises(ValueError, match="nothing left"):
        S.require_rows(calls.where(F.lit(False)), "nothing left")


def test_holdout_by_a_table_of_lines(spark, calls):
    lines = spark.createDataFrame([("hepg2",), ("HEPG2",), (None,), ("absent",)], "line string")
    none = lines.where("false")
    odd = calls.unionByName(calls.limit(1).withColumn("pert", F.lit("n")).withColumn("cell_type", F.lit(None).cast("string")))
    for df in (calls, odd):
        assert perts(S.holdout_by_lines(df, "test", lines)) == "ab"
        assert perts(S.holdout_by_lines(df, "train", lines)) == "cde"
        assert perts(S.holdout_by_lines(df, "train", none)) == "abcde"
        assert perts(S.holdout_by_lines(df, "test", none)) == ""
    assert S.holdout_by_lines(odd, None, lines).count() == 6
    with pytest.warns(UserWarning, match="unknown"):
        assert S.holdout_by_lines(calls, "dev", lines).count() == 0


@pytest.mark.parametrize("part", ["train", "test"])
def test_folders_of_held_out_lines_stay_closed(spark, calls, tmp_path, part):
    calls.write.partitionBy("cell_type").parquet(str(tmp_path / "calls"))
    stored = spark.read.parquet(str(tmp_path / "calls"))
    lines = spark.createDataFrame([("k562",)], "line string")
    found = S.holdout_by_lines(stored, part, lines)
    assert "".join(sorted(r.pert for r in found.collect())) == ("ce" if part == "test" else "abd")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "dynamicpruning" in plan and "SubqueryBroadcast" in plan
