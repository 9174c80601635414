"""Every registered query on the smallest tables, next to its SQL."""

import pytest

import __spark_entry__ as entry_module
from check import duck, rows_of

SF = "/root/testdata/sf0.001"
ORACLE = entry_module.oracle_sql()
QUERIES = entry_module.queries()


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    mine = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert mine
        return
    cur = duck(SF).execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, mine) == rows_of(columns, cur.fetchall())
