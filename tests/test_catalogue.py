import os

import duckdb
import pytest

from clausewright.plans import documents, endpoints, review, texts  # noqa: F401
from clausewright.plans.catalogue import FLAGSHIP, ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        p = f"{DIR}/{t}"
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def shown(rows):
    return sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = con.sql(ORACLES[name]).select(*[f'"{c}"' for c in cols]).fetchall()
    assert shown(map(tuple, got.select(*cols).collect())) == shown(want)


def test_entry():
    assert FLAGSHIP in QUERIES
