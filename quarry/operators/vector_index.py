"""A stored vector index: inverted lists with product codes, kept in a folder, searched without losing a neighbour.

Centroids and codebooks are fitted to a bounded sample (the first rows by a hash of the id). Every row is assigned to
its nearest list, and to ``copies - 1`` more by the AIR score; its code and the length of what the code leaves out are kept. Lists are
partitions of the stored table, so a search reads those it probes.

A search probes the nearest lists first. Their k-th best cosine is a bar; lists whose bound (the angle to the
centroid less the list's widest angle) reaches the bar are read as well. Within lists, codes choose candidates, whose k-th exact
cosine is the bar for approximate score plus left-out length. So results are exact: what is clustered is read in part, what has no structure in whole.

Deleted ids are tombstones until ``compact``; ``insert`` adds rows to the lists that are there.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vector as V
from quarry.operators.keyword import top
from quarry.sources.shared import shared_dir

SAMPLE = 16_384
MOST_LISTS = 1024
SCHEMA = "id long, embedding array<double>, list int, first boolean, code binary, left double, angle double"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def matrix(column) -> np.ndarray:
    """Rows of a list column of one length, without a Python object for each number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(axis=1) / 2 - x[a : a + 4096] @ c.T).argmin(axis=1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def air_score(v: np.ndarray, centres: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """0.7 x cosine with the centroid + 0.3 x cosine of the residual with the direction."""
    cos = _unit(v) @ _unit(centres).T
    rest = v[:, None, :] - centres[None]
    along = np.einsum("ncd,nd->nc", rest, _unit(direction)) / np.maximum(np.linalg.norm(rest, axis=2), 1e-12)
    return 0.7 * cos + 0.3 * along


@dataclass
class Fitted:
    """What is fitted: bounded by MOST_LISTS x dimension and 256 x dimension."""

    centres: np.ndarray  # unit vectors
    books: np.ndarray  # parts x words x width
    copies: int

    def encoded(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what they leave out) of unit vectors' residuals."""
        rest = x - self.centres[near]
        parts = np.split(rest, len(self.books), axis=1)
        codes = np.stack([_nearest(p, b) for p, b in zip(parts, self.books, strict=True)], axis=1)
        left = sum(((p - b[c]) ** 2).sum(axis=1) for p, b, c in zip(parts, self.books, codes.T, strict=True))
        return codes.astype(np.uint8), np.sqrt(left)

    def rows(self, df: DataFrame) -> DataFrame:
        """The rows (id, embedding) with their lists and codes; zero vectors are left out."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def task(batches):
            fit = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                raw = matrix(batch.column(1))
                x = _unit(raw)
                score = x @ fit.centres.T
                near = score.argmax(axis=1)
                lists = [near]
                if fit.copies > 1:
                    more = air_score(x, fit.centres, x)
                    more[np.arange(len(x)), near] = -np.inf
                    lists += list(np.argsort(-more, axis=1, kind="stable")[:, : min(fit.copies, len(fit.centres)) - 1].T)
                for n, at in enumerate(lists):
                    codes, left = fit.encoded(x, at)
                    angle = np.arccos(np.clip(score[np.arange(len(x)), at], -1, 1))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array([n == 0] * len(x)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.array(angle)],
                        names=[c.split()[0] for c in SCHEMA.split(", ")],
                    )

        kept = df.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.exists("embedding", lambda v: v != 0))
        return kept.mapInArrow(task, SCHEMA)


def fit(rows: DataFrame, lists: int, copies: int = 1, parts: int = 8, words: int = 64) -> Fitted:
    taken = rows.where(F.exists("embedding", lambda v: v != 0)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.col("embedding").cast("array<double>")).toArrow()
    x = _unit(matrix(taken["embedding"]))
    centres = _unit(_kmeans(x, min(lists, MOST_LISTS), 15))
    rest = x - centres[(x @ centres.T).argmax(axis=1)]
    parts = next(p for p in range(min(parts, x.shape[1]), 0, -1) if x.shape[1] % p == 0)
    books = [_kmeans(np.ascontiguousarray(p), min(words, len(p)), 10) for p in np.split(rest[:4096], parts, axis=1)]
    return Fitted(centres, np.stack(books), copies)


@dataclass
class VectorIndex:
    """An index in ``folder``: rows, one table a generation of inserts; tombstones; lists; what was fitted."""

    spark: SparkSession
    folder: str
    fitted: Fitted
    generation: int = 0
    found: dict = field(default_factory=dict)

    @classmethod
    def build(cls, rows: DataFrame, folder: str, lists: int = 16, copies: int = 1) -> VectorIndex:
        index = cls(rows.sparkSession, folder.rstrip("/"), fit(rows, lists, copies))
        f = index.fitted
        meta = json.dumps({"centres": f.centres.tolist(), "books": f.books.tolist(), "copies": f.copies})
        index.spark.createDataFrame([(meta,)], "fitted string").coalesce(1).write.mode("error").parquet(f"{index.folder}/fitted")
        index._add(rows)
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        folder = folder.rstrip("/")
        meta = json.loads(spark.read.parquet(f"{folder}/fitted").first()["fitted"])
        return cls(spark, folder, Fitted(np.array(meta["centres"]), np.array(meta["books"]), meta["copies"]))

    def _add(self, rows: DataFrame) -> None:
        made = self.fitted.rows(rows).withColumn("place", F.col("list"))
        made.repartition("place", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("place").mode("append").parquet(f"{self.folder}/rows")
        self.found.clear()

    def insert(self, rows: DataFrame) -> None:
        """Adds rows (id, embedding) with new ids."""
        self._add(rows)

    def delete(self, ids: DataFrame) -> None:
        """Takes ids (id) away; a deleted id must not be inserted again before ``compact``."""
        ids.select(F.col("id").cast("long").alias("id")).write.mode("append").parquet(f"{self.folder}/deleted")
        self.found.clear()

    def deleted(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deleted")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "id long")
        return self.spark.read.schema("id long").parquet(f"{self.folder}/deleted").distinct()

    def stored(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", place int").parquet(f"{self.folder}/rows")

    def active(self) -> DataFrame:
        """The rows that aren't deleted; each id as often as it has lists."""
        return self.stored().join(self.deleted(), "id", "left_anti")

    def compact(self, folder: str) -> VectorIndex:
        """The index without what was deleted, in another folder."""
        self.spark.read.parquet(f"{self.folder}/fitted").write.mode("error").parquet(f"{folder.rstrip('/')}/fitted")
        self.active().repartition("place", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("place").parquet(f"{folder.rstrip('/')}/rows")
        return VectorIndex.open(self.spark, folder)

    def lists(self) -> list[dict]:
        """list, n, widest (angle of a row whose first list it is) of each list: MOST_LISTS rows; read once."""
        if "lists" not in self.found:
            per = self.active().groupBy(F.col("place").alias("list")).agg(F.count("*").alias("n"), F.max(F.when(F.col("first"), F.col("angle"))).alias("widest"))
            self.found["lists"] = [r.asDict() for r in per.collect()]
        return self.found["lists"]

    def stats(self) -> DataFrame:
        """active and deleted ids, lists with rows, dimension."""
        active = self.active().where("first").agg(F.count("*").alias("active"))
        gone = self.stored().where("first").join(self.deleted(), "id", "left_semi").agg(F.count("*").alias("deleted"))
        return active.join(gone, F.lit(True)).withColumns({"lists": F.lit(len(self.lists())), "dimension": F.lit(self.fitted.centres.shape[1])})

    def offsets(self) -> DataFrame:
        """list, start, n: where each list's rows begin if lists are laid end to end."""
        sizes = {r["list"]: r["n"] for r in self.lists()}
        n = [sizes.get(k, 0) for k in range(len(self.fitted.centres))]
        return self.spark.createDataFrame([(k, sum(n[:k]), n[k]) for k in range(len(n))], "list int, start long, n long")

    def balance(self) -> DataFrame:
        """largest, mean and whether the largest list is at most three times the mean."""
        return self.offsets().agg(F.max("n").alias("largest"), F.avg("n").alias("mean")).withColumn("balanced", F.col("largest") <= 3 * F.col("mean"))

    def search(self, query: list[float], k: int, probes: int = 4, codes: bool = False, candidates: int = 100) -> DataFrame:
        """id, score of the k rows with the largest cosine, ties to the smaller id; exactly."""
        q = _unit(np.array(query, float)[None])[0]
        if not np.array(query).any() or not self.lists():
            return self.spark.createDataFrame([], "id long, score double")
        angle = np.arccos(np.clip(self.fitted.centres @ q, -1, 1))
        known = sorted(self.lists(), key=lambda r: angle[r["list"]])
        near, far = known[:probes], known[probes:]
        bar = self._bar(self._candidates([r["list"] for r in near], q, candidates) if codes else self._inside([r["list"] for r in near]), query, k)
        wide = [r["list"] for r in far if r["widest"] is not None and np.cos(max(0.0, angle[r["list"]] - r["widest"])) >= bar - 1e-9]
        rows = self._inside([r["list"] for r in near] + wide)
        if codes:
            rows = self._approximate(rows, q).where(F.col("rough") + F.col("left") >= bar - 1e-9)
        return self._best(rows, query, k)

    def _inside(self, lists: list[int]) -> DataFrame:
        rows = self.active().where(F.col("place").isin(lists))
        return rows.dropDuplicates(["id"]) if self.fitted.copies > 1 else rows

    def _approximate(self, rows: DataFrame, q: np.ndarray) -> DataFrame:
        """The rows with the approximate cosine of their codes, from the query's distance table."""
        f = self.fitted
        table = np.einsum("pwd,pd->pw", f.books, q.reshape(len(f.books), -1))
        shared = self.spark.sparkContext.broadcast((table, f.centres @ q))

        def task(batches):
            table, base = shared.value
            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    rough = table[np.arange(len(table)), codes].sum(axis=1) + base[batch.column(3).to_numpy()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rough), batch.column(4)], names=["id", "embedding", "rough", "left"])

        return rows.select("id", "embedding", "code", "list", "left").mapInArrow(task, "id long, embedding array<double>, rough double, left double")

    def _candidates(self, lists: list[int], q: np.ndarray, candidates: int) -> DataFrame:
        return self._approximate(self._inside(lists), q).orderBy(F.desc("rough"), "id").limit(candidates)

    def _best(self, rows: DataFrame, query: list[float], k: int) -> DataFrame:
        q = F.array(*(F.lit(float(x)) for x in query))
        return top(rows.select("id", V.cosine(F.col("embedding"), q).alias("score")), k)

    def _bar(self, rows: DataFrame, query: list[float], k: int) -> float:
        best = self._best(rows, query, k).collect()
        return best[-1]["score"] if len(best) == k else -1.0


def kept_index(rows: DataFrame, lists: int = 16, copies: int = 1) -> VectorIndex:
    """The index of the rows, built once for a session's shared folder and the files the rows come from, then opened."""
    spark = rows.sparkSession
    about = json.dumps([sorted(rows.inputFiles()), rows.columns, lists, copies])
    folder = f"{shared_dir(spark).rstrip('/')}/vectors-{spark.sparkContext.applicationId}-{hashlib.sha256(about.encode()).hexdigest()[:16]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path(f"{folder}/rows/_SUCCESS")):
        return VectorIndex.open(spark, folder)
    files.delete(path(folder), True)  # what a build that failed has left
    return VectorIndex.build(rows, folder, lists, copies)
