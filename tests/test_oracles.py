"""The registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"pipeline"}
NAMES = [n for n in entry.oracle_sql() if n not in SLOW]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(pdf):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v.tolist() if hasattr(v, "tolist") else v
    return sorted(str([plain(v) for v in r]) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, DIR).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())
