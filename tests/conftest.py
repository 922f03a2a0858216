from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df) -> list[tuple]:
    """Rows of a Spark or DuckDB result as sorted tuples of text, columns by name."""
    if hasattr(df, "collect"):
        names, data = df.columns, [tuple(r) for r in df.collect()]
    else:
        names, data = [x[0] for x in df.description], df.fetchall()
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: "~" if v is None or v != v else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return [tuple(sorted(names))] + sorted(tuple(text(r[i]) for i in order) for r in data)
