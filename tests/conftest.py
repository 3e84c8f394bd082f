import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for f in Path(SMALL).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return db


def normal(frame):
    """Rows as sorted tuples of strings, columns by name."""
    frame = frame[sorted(frame.columns)]
    one = lambda v: "~" if v is None or v is pd.NA or v != v else str(bool(v)) if type(v).__name__ in ("bool", "bool_") else repr(float(v) + 0.0) if type(v).__name__.startswith("float") else str(v)
    return sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False))
