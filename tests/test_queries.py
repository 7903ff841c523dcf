"""Every query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry_points
from strandcall.catalog.oracles import ORACLES
from strandcall.catalog.queries import REGISTRY as QUERIES
from tests.conftest import SF_DIR


def normal(value):
    return round(value, 6) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["cell_type", "label", "n"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr([normal(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([normal(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert len(want) > 0
    assert got == want
