"""Every query with a SQL twin gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from adlattice import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TWINS = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def table(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf_dir, duck, name):
    own, twin = catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(TWINS[name]).df()
    assert sorted(own.columns) == sorted(twin.columns)
    for c in own.columns:  # nullable integers come as floats on one side
        if own[c].dtype.kind in "if" and twin[c].dtype.kind in "if":
            own[c], twin[c] = own[c].astype(float), twin[c].astype(float)
    assert table(own) == table(twin)


def test_entry_and_registry(spark):
    assert len(__spark_entry__.entry(spark).columns) > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
