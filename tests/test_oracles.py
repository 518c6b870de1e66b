"""Every query with an SQL form gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import brindle.queries_model  # noqa: F401
from brindle.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(tuple(r[c] for c in names) for r in got.collect()) == rows(want.fetchall())
