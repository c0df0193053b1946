import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def cells(rows):
    """Rows in a form that sorts and compares whatever engine they come from."""
    import datetime
    import decimal

    def cell(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float, decimal.Decimal)):
            return f"{float(x):.6f}"
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None).isoformat()
        return str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


def same(df, sql, sf_dir=None, **views):
    """Whether ``df`` has the rows of ``sql`` over the tables of ``sf_dir`` or the given pandas or Arrow tables."""
    import duckdb

    c = duckdb.connect()
    for t in TABLES if sf_dir else ():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, v in views.items():
        c.register(name, v)
    want = c.execute(sql)
    names = sorted(d[0] for d in want.description)
    place = [[d[0] for d in want.description].index(n) for n in names]
    rows = [[r[i] for i in place] for r in want.fetchall()]
    assert sorted(df.columns) == names
    got = [[r[n] for n in names] for r in df.collect()]
    assert cells(got) == cells(rows)
    return got
