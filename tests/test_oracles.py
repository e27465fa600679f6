"""Every registered query of the matching engine against its DuckDB SQL."""

import glob
import math
import os

import duckdb
import pytest

from twinweave.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and math.isnan(value) else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = rows(catalogue.QUERIES[name](spark, sf).toPandas())
    want = rows(duck.execute(catalogue.ORACLES[name]).df())
    assert got == want
    assert got[1]
