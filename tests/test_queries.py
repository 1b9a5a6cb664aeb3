"""Every query against its SQL, on the smallest of the given tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from benchset import oracles, registry

ORACLES = oracles.oracle_sql()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    names, kinds = [c[0] for c in result.description], [str(c[1]) for c in result.description]
    assert {n: KINDS[k] for n, k in df.dtypes} == dict(zip(names, kinds))
    assert canonical(got, df.columns) == canonical(result.fetchall(), names)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_names_agree():
    assert set(ORACLES) == set(registry.QUERIES) <= set(contract.queries())
