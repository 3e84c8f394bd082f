"""Each query with SQL gives the rows that DuckDB gives; each without gives a stable schema and rows."""

import pytest

from quarry.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import SMALL, normal


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def _against_sql(spark, name, folder, **tables):
    """The query's rows and its SQL's over tables (lists of rows and a schema) that are put into ``folder``."""
    import duckdb

    db = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.parquet(f"file://{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return normal(QUERIES[name](spark, f"file://{folder}").toPandas()), normal(db.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("start, n", [(0, 70_000), (65_000, 1_000), (70_000, 10), (0, 0)])
def test_event_root_beyond_the_places_of_its_tree(spark, tmp_path, start, n):
    events = spark.range(start, start + n).selectExpr("id AS event_id", "CASE WHEN id % 10 = 3 THEN NULL ELSE concat('kind', id % 7) END AS event_type", "CASE WHEN id % 11 = 5 THEN NULL ELSE id % 100 END AS user_id")
    got, want = _against_sql(spark, "event_tree_root", tmp_path, events=events)
    assert got == want and len(got) == 1


@pytest.mark.parametrize("n", [0, 1, 16_384, 16_385, 33_007, 49_152])
def test_content_roots_beyond_one_tree(spark, tmp_path, n):
    documents = spark.range(n).selectExpr("id * 3 AS doc_id", "CASE WHEN id % 5 = 1 OR id div 64 = 2 THEN NULL ELSE concat('text ', id) END AS text")
    got, want = _against_sql(spark, "content_root", tmp_path, documents=documents)
    assert got == want and len(got) == max(1, -(-n // 16_384))
