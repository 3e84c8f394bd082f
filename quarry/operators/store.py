"""Tables that are changed: appended generations of changes, of which the last of each key counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class ChangeTable:
    """A table in ``folder`` under ``keys``. Every change is one append, in a generation of its own; of a key that a generation has twice, the largest row counts."""

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]

    def _generations(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = files.listStatus(path) if files.exists(path) else []
        return sorted(int(f.getPath().getName().removeprefix("generation=")) for f in found if f.getPath().getName().startswith("generation="))

    def _append(self, rows: DataFrame, op: str) -> None:
        n = ([-1, *self._generations()])[-1] + 1
        names = [c.split()[0] for c in self.schema.split(", ")]
        columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in self.schema.split(", "))]
        rows.select(*columns).select(*names, F.lit(op).alias("op")).write.mode("error").parquet(f"{self.folder}/generation={n}")

    def save(self, rows: DataFrame) -> None:
        """Adds rows, or puts them in the place of those with their keys."""
        self._append(rows, "save")

    def remove(self, keys: DataFrame) -> None:
        """Takes keys away; one that isn't there is no error."""
        self._append(keys, "remove")

    def rows(self) -> DataFrame:
        """The rows as they are after all changes: one aggregation by key."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        if not self._generations():
            return self.spark.createDataFrame([], self.schema)
        every = self.spark.read.schema(f"{self.schema}, op string, generation int").parquet(self.folder)
        last = every.groupBy(*self.keys).agg(F.max(F.struct("generation", "op", *(c for c in names if c not in self.keys))).alias("last"))
        return last.where("last.op = 'save'").select(*(c if c in self.keys else F.col(f"last.{c}").alias(c) for c in names))

    def compact(self) -> None:
        """Writes the rows as one generation and forgets those before it."""
        old = self._generations()
        self.save(self.rows())
        for n in old:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/generation={n}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def graph_tables(spark: SparkSession, folder: str) -> dict[str, ChangeTable]:
    """entities, relations and aliases of a graph under one folder."""
    folder = folder.rstrip("/")
    return {
        "entities": ChangeTable(spark, f"{folder}/entities", "id long, name string, entity_type string", ("id",)),
        "relations": ChangeTable(spark, f"{folder}/relations", "src long, tgt long, relation string, weight double", ("src", "tgt", "relation")),
        "aliases": ChangeTable(spark, f"{folder}/aliases", "alias string, id long", ("alias",)),
    }


def accessed(memories: ChangeTable, hits: DataFrame) -> None:
    """Counts accesses (id, ts) of memories (id, access, last_ts and others): hits are summed up, so that an id's many hits are one change."""
    per = hits.groupBy("id").agg(F.count("*").alias("more"), F.max("ts").alias("latest"))
    now = memories.rows().join(per, "id").withColumns({"access": F.col("access") + F.col("more"), "last_ts": F.greatest("last_ts", "latest")})
    memories.save(now.drop("more", "latest"))
