"""Every query on odd and on empty tables, and against its SQL."""

import glob
import os

import corpus_pipeline
import pytest

from strandcall.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def read(path):
    return f"{path}/*.parquet" if os.path.isdir(path) else path


def duck_rows(folder, sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{read(path)}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr), sorted(names)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr), names


OF_VECTORS = ("op12_bidiagonal_whitening", "op13_anchor_lists")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(OF_VECTORS)))
def test_odd_rows_are_all_answered(spark, odd_dir, odd_docs, odd_pages, name):
    found = QUERIES[name](spark, odd_dir).collect()
    assert len(found) == (odd_pages if name in ("op2_host_paths", "op8_url_bloom") else odd_docs).count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    df = QUERIES[name](spark, empty_dir)
    assert df.columns and df.collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("where", ["given", "odd"])
def test_sql_agrees(spark, odd_dir, name, where):
    folder = SF_DIR if where == "given" else odd_dir
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(folder, ORACLES[name])


@pytest.mark.parametrize("name", ["op5_scaled_sketch", "op6_phrase_index", "op8_url_bloom"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "CartesianProduct", "NestedLoop"))


def test_pipeline_on_odd_and_empty_tables(spark, odd_dir, empty_dir, odd_docs):
    found = corpus_pipeline.run(spark, odd_dir)
    assert found.columns == [*odd_docs.columns, "copy"]
    assert found.count() > 0
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_stages_keep_the_columns(spark, odd_dir, odd_docs):
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, odd_docs, odd_dir).columns == odd_docs.columns
