"""A stored keyword index: postings by term, the best impact of each block of rows, and exact top-k that leaves blocks out.

Postings (term, id, tf, dl) are partitioned by a hash of the term, so a query reads the partitions of its words. Rows fall into blocks by id; of each
(term, block) the largest impact (the part of BM25 without idf) is kept. A block's bound is the sum over the query's terms of
weight x idf x largest impact. The blocks with the largest bounds are scored first; their k-th score is a bar, and only blocks whose bound reaches it are read
besides. Results are those of scoring every row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.keyword import B, K1, query_terms, top

BUCKETS = 64
#: Rows of a block by id, and blocks that are scored first for each wanted row.
BLOCK, FIRST = 256, 2


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _impact(average: float) -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))


@dataclass
class KeywordIndex:
    """An index in ``folder``: postings, blocks, terms, one row of statistics."""

    spark: SparkSession
    folder: str
    count: int
    average: float

    @classmethod
    def build(cls, docs: DataFrame, folder: str) -> KeywordIndex:
        """Indexes rows (id, text); ids are longs."""
        spark, folder = docs.sparkSession, folder.rstrip("/")
        words = docs.select("id", tokens(F.col("text")).alias("words")).select("id", "words", F.size("words").alias("dl"))
        one = words.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).first()
        index = cls(spark, folder, one["n"], one["avgdl"] or 1.0)
        postings = words.select("id", "dl", F.explode("words").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        postings = postings.select("term", "id", "tf", "dl", F.floor(F.col("id") / BLOCK).alias("block"), _bucket(F.col("term")).alias("bucket"))
        postings.repartition("bucket", "term").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{folder}/postings")
        stored = spark.read.parquet(f"{folder}/postings")
        blocks = stored.groupBy("term", "block", "bucket").agg(F.max(_impact(index.average)).alias("impact"), F.count("*").alias("n"))
        blocks.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/blocks")
        stats = json.dumps({"count": index.count, "average": index.average})
        spark.createDataFrame([(stats,)], "stats string").coalesce(1).write.parquet(f"{folder}/stats")
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> KeywordIndex:
        folder = folder.rstrip("/")
        stats = json.loads(spark.read.parquet(f"{folder}/stats").first()["stats"])
        return cls(spark, folder, stats["count"], stats["average"])

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of a query's terms: their partitions, and their row groups by the sorted term."""
        spark = self.spark
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
        return spark.read.parquet(f"{self.folder}/{name}").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def search(self, query: str, k: int, read: list | None = None) -> DataFrame:
        """id, score of the k best rows, ties to the smaller id. ``read`` gets the numbers of blocks with a term and of those scored."""
        weights = query_terms(query)
        nothing = self.spark.createDataFrame([], "id long, score double")
        if not weights or not self.count:
            return nothing
        blocks = self._of("blocks", sorted(weights))
        found = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # the query's terms
        if not found:
            return nothing
        factor = F.lit(0.0)
        for term, df in found.items():
            idf = F.log(F.lit((self.count - df + 0.5) / (df + 0.5) + 1))
            factor = F.when(F.col("term") == term, idf * weights[term]).otherwise(factor)
        bounds = blocks.groupBy("block").agg(F.sum(factor * F.col("impact")).alias("bound"))
        postings = self._of("postings", sorted(found))

        def scored(some: DataFrame) -> DataFrame:
            return postings.join(some.select("block"), "block", "left_semi").groupBy("id").agg(F.sum(factor * _impact(self.average)).alias("score"))

        first = top(scored(bounds.orderBy(F.desc("bound"), "block").limit(FIRST * k)), k).collect()
        bar = first[-1]["score"] - 1e-9 if len(first) == k else 0.0
        rest = bounds.where(F.col("bound") >= bar)
        if read is not None:
            read += [bounds.count(), rest.count()]
        return top(scored(rest), k)
