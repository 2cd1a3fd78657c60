import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Compare a query with its SQL: column names and rows, whatever their order."""
    from collections import Counter
    from decimal import Decimal

    def plain(row):
        return tuple(repr(round(float(v), 6) + 0.0) if isinstance(v, (float, Decimal)) else repr(v) for v in row)

    def check(query, sql):
        got = query(spark, sf_dir)
        cols = sorted(got.columns)
        want = duck.sql(sql)
        assert sorted(want.columns) == cols
        a = Counter(plain(tuple(r[c] for c in cols)) for r in got.collect())
        b = Counter(plain(r) for r in want.select(", ".join(f'"{c}"' for c in cols)).fetchall())
        assert a == b, (list((a - b))[:3], list((b - a))[:3])

    return check
