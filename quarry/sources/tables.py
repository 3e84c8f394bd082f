"""Reading and writing: tables of a folder, SQLite files, typed attributes, JSON lines, virtual datasets."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in names}


def external(spark: SparkSession, links: DataFrame, name: str) -> DataFrame:
    """The table that a link (name, folder, target) leads to, in another folder; a missing name is a KeyError, several are a ValueError."""
    found = links.where(F.col("name") == name).select("folder", "target").limit(2).collect()
    if not found:
        raise KeyError(name)
    if len(found) > 1:
        raise ValueError(f"several links of name {name}")
    return table(spark, found[0]["folder"], found[0]["target"])


def virtual(parts: list[tuple[DataFrame, int]], index: str) -> DataFrame:
    """One dataset out of several, each shifted along ``index``: composed at plan time, nothing is copied."""
    out = None
    for df, shift in parts:
        moved = df.withColumn(index, F.col(index) + F.lit(shift))
        out = moved if out is None else out.unionByName(moved)
    return out


def merged(blocks: list[DataFrame], name: str = "name") -> DataFrame:
    """Metadata blocks as one table sorted by name; a name in two blocks is an error when the rows are read."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    n = out.groupBy(name).agg(F.count("*").alias("__n"))
    return out.join(n, name).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate "), name))).otherwise(F.col("__n"))).where("__n = 1").drop("__n").orderBy(name)


def metadata(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """dataset, column, type: what the tables' schemas say; no data are read."""
    rows = [(n, f.name, f.dataType.simpleString()) for n in names for f in table(spark, folder, n).schema]
    return spark.createDataFrame(rows, "dataset string, column string, type string")


def read_sqlite(spark: SparkSession, path: str, name: str, schema: str, columns: list[str], where: str = "1=1", parts: int = 4, key: str = "rowid") -> DataFrame:
    """Rows of an SQLite table, each task reading a range of the key; the filter goes into the SELECT.

    The file must be readable where tasks run. ``columns`` are the table's columns in the order of ``schema``.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"SELECT coalesce(min({key}), 0), coalesce(max({key}), -1) FROM {name} WHERE {where}").fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    bounds = [(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
    wanted = spark.createDataFrame(bounds or [(0, 0)], "low long, high long").repartition(max(1, len(bounds)))

    def task(batches):
        import pandas as pd

        for pdf in batches:
            for low, high in zip(pdf["low"].tolist(), pdf["high"].tolist(), strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(f"SELECT {', '.join(columns)} FROM {name} WHERE ({where}) AND {key} >= ? AND {key} < ?", (low, high)).fetchall()
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return wanted.mapInPandas(task, schema)


def sqlite_counts(path: str, names: list[str]) -> dict[str, int]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return {n: db.execute(f"SELECT count(*) FROM {n}").fetchone()[0] for n in names}


def json_lines(rows: DataFrame) -> DataFrame:
    """line: each active row as JSON."""
    return rows.where(~F.col("deleted")).drop("deleted").select(F.to_json(F.struct("*")).alias("line"))


def snapshot(rows: DataFrame, folder: str, version: int) -> str:
    """Writes a version to a folder of its own; a version that is there is an error."""
    path = f"{folder.rstrip('/')}/version={version}"
    rows.write.mode("error").parquet(path)
    return path


def restored(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a snapshot folder, the latest by default."""
    rows = spark.read.parquet(folder)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version).drop("version")


def replayed(base: DataFrame, log: DataFrame) -> DataFrame:
    """The base (id, value) with a change log (seq, op, id, value) applied: the last change of each id counts; op "delete" takes the row away."""
    changes = log.groupBy("id").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    new = changes.where("last.op <> 'delete'").select("id", F.col("last.value").alias("value"))
    return base.join(changes, "id", "left_anti").select("id", "value").unionByName(new)
