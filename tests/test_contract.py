import duckdb
import pytest

import __spark_entry__ as contract
from check import canonical
from workload.fixtures import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(contract.queries()) & set(contract.oracle_sql())))
def test_query_equals_sql(spark, db, name):
    got = contract.queries()[name](spark, SMALL).toPandas()
    want = db.execute(contract.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert canonical(got) == canonical(want)
