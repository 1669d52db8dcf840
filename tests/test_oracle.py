"""Every registered query that has DuckDB SQL agrees with it (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from emporia.plans.catalog import ANALYSES
from tests.conftest import SF0001

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    yield con
    con.close()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_analysis_has_oracle():
    assert set(ANALYSES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert len(ANALYSES) == 46


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF0001)
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["person_id", "order_amount", "orders", "rank"]
    assert df.count() == 100
