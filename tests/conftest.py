from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def folder():
    return str(DATA)


def rows_of(frame, columns):
    return sorted(tuple(repr(v) for v in r) for r in frame.select(*columns).collect())


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, folder):
    def compare(query, sql):
        got = query(spark, folder)
        columns = sorted(got.columns)
        wanted = duck.sql(sql)
        assert sorted(wanted.columns) == columns
        expected = sorted(tuple(repr(v) for v in r) for r in wanted.select(*[f'"{c}"' for c in columns]).fetchall())
        assert rows_of(got, columns) == expected

    return compare
