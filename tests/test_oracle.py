"""Every registered key against its DuckDB oracle (row count, columns, values)."""

import hashlib
import json
import math

import duckdb
import pytest

from riskframe.plans import all_queries
from riskframe.plans.registry import REGISTRY, oracle_sql_map, query_map
from riskframe.sources.fixtures import TABLES

SMALL = "/root/testdata/sf0.001"

all_queries.load()
SQL = oracle_sql_map()
KEYS = sorted(SQL)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_key_has_a_query():
    assert set(SQL) <= set(REGISTRY)
    assert len(REGISTRY) >= 100


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = query_map()[key](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.execute(SQL[key])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _digest(df.columns, rows) == _digest(dcols, drows)
