import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # Spark's Python workers too

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def same(con, sql: str, df) -> None:
    """Equal columns and equal bags of rows."""
    import datetime
    import decimal

    def plain(v):
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        if isinstance(v, decimal.Decimal):
            return float(v)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None)
        return v

    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = sorted((repr([plain(row[names.index(n)]) for n in sorted(names)]) for row in cursor.fetchall()))
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr([plain(row[n]) for n in sorted(names)]) for row in df.collect())
    assert got == want
