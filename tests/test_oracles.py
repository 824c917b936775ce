"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from sylvane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    def value(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    assert canonical(catalog.QUERIES[name](spark, SF).toPandas()) == canonical(duck.execute(catalog.ORACLES[name]).df())
