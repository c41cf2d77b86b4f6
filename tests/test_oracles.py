"""Every registered query with an oracle equals it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from walkloom.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(x):
        if x is None or x != x:
            return "null"
        return str(x) if isinstance(x, (bool, str)) or not hasattr(x, "__float__") else f"{float(x):.6g}"

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, D).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
