"""One session for all tests, and DuckDB over the same small tables."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF_DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(frame) -> list[tuple]:
    """Rows as text in a fixed order, columns by name."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        return f"{x:.6f}".replace("-0.000000", "0.000000") if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))
