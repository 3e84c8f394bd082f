"""Vector top-k: exact, for one query or many, and the choice between this and the stored index (``vector_index``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vector as V
from quarry.operators.keyword import top
from quarry.operators.vector_index import kept_index, matrix

#: Queries that go to all tasks at once, and rows that queries are streamed past.
QUERY_BLOCK, ROW_BLOCK = 4096, 8192


def scored(rows: DataFrame, query: list[float], measure: str = "cosine") -> DataFrame:
    """id, score of each row (id, embedding); empty for a zero query with cosine."""
    q = F.array(*(F.lit(float(x)) for x in query))
    if measure == "cosine" and not any(query):
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    score = {"cosine": V.cosine, "dot": V.dot, "l2": V.l2}[measure](F.col("embedding"), q)
    return rows.select("id", score.alias("score"))


def flat_topk(rows: DataFrame, query: list[float], k: int, measure: str = "cosine") -> DataFrame:
    """Exact search: one narrow pass, each task keeps k rows."""
    found = scored(rows, query, measure)
    return found.orderBy("score", "id").limit(k) if measure == "l2" else top(found, k)


def vector_of(rows: DataFrame, key: int) -> list[float]:
    found = rows.where(F.col("id") == key).select("embedding").limit(1).collect()
    return [float(x) for x in found[0][0]] if found else []


def multi_topk(rows: DataFrame, queries: DataFrame, k: int, earlier: bool = False) -> DataFrame:
    """query_id, rank, id, score for each row of ``queries`` (id, embedding), by matrix products over Arrow batches; with ``earlier`` only among rows of smaller ids.

    Up to QUERY_BLOCK queries (counted) go to all tasks, in one scan of the rows. More are streamed past blocks of ROW_BLOCK rows: queries are copied to the
    blocks, rows are not. Each batch or block gives k rows for a query at most.
    """
    session = rows.sparkSession
    asked = queries.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = rows.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query_id long, id long, score double"

    def best(ids, x, own, y):
        """The k best of the rows (own, y) for each query (ids, x)."""
        if not len(ids) or not len(own):
            return pa.RecordBatch.from_pydict({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        both = np.sqrt((x**2).sum(axis=1))[:, None] * np.sqrt((y**2).sum(axis=1))[None, :]
        score = np.divide(x @ y.T, both, out=np.zeros_like(both), where=both > 0)
        if earlier:
            score[own[None, :] >= ids[:, None]] = -np.inf
        order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
        n = order.shape[1]
        query, hit, value = np.repeat(ids, n), own[order].ravel(), np.take_along_axis(score, order, 1).ravel()
        real = value > -np.inf
        return pa.RecordBatch.from_pydict({"query_id": query[real], "id": hit[real], "score": value[real]})

    if asked.count() <= QUERY_BLOCK:
        table = asked.toArrow()
        shared = session.sparkContext.broadcast((table["id"].to_numpy(), matrix(table["embedding"])))  # QUERY_BLOCK rows

        def task(batches):
            for batch in batches:
                if batch.num_rows:
                    yield best(*shared.value, batch.column(0).to_numpy(), matrix(batch.column(1)))

        scored = found.mapInArrow(task, schema)
    else:
        blocks = max(1, -(-found.count() // ROW_BLOCK))
        own = found.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "id", "embedding")
        copied = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "id", "embedding")

        def streamed(batches):
            now, ids, held = None, [], []
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
                cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                    part, (block, kind) = batch.slice(a, b - a), keys[a].tolist()
                    if block != now:
                        now, ids, held = block, [], []
                    if kind == 0:
                        ids.append(part.column(2).to_numpy())
                        held.append(matrix(part.column(3)))
                    elif held:
                        yield best(part.column(2).to_numpy(), matrix(part.column(3)), np.concatenate(ids), np.concatenate(held))

        scored = own.unionByName(copied).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(streamed, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def distances(rows: DataFrame, queries: DataFrame, measure: str = "l2") -> DataFrame:
    """query_id, id, distance of every row to each of a stated set of queries: QUERY_BLOCK at most, else ValueError."""
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    if q.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        raise ValueError(f"a distance matrix takes {QUERY_BLOCK} queries at most")
    fn = {"cosine": V.cosine, "dot": V.dot, "l2": V.l2}[measure]
    return rows.join(F.broadcast(q), F.lit(True)).select("query_id", "id", fn(F.col("embedding"), F.col("query")).alias("distance"))


def choose_strategy(count: int) -> str:
    """Which search suits a number of rows: all rows as they are, by norms made once, or the stored index with codes."""
    return "flat" if count < 10_000 else "prenormalised" if count <= 100_000 else "ivfpq"


def with_norms(rows: DataFrame) -> DataFrame:
    """The rows (id, embedding) with their length, to be stored."""
    return rows.select("id", "embedding", V.norm(F.col("embedding")).alias("norm"))


def prenormalised_topk(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """Exact cosine search over rows that have their ``norm``."""
    length = float(np.sqrt(np.square(np.array(query, float)).sum()))
    if not length:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.when(F.col("norm") > 0, V.dot(F.col("embedding"), q) / (F.col("norm") * length)).otherwise(0.0)
    return top(rows.select("id", score.alias("score")), k)


def search(rows: DataFrame, query: list[float], k: int, strategy: str | None = None) -> DataFrame:
    """id, score by the strategy that suits the number of rows, or by the one named."""
    strategy = strategy or choose_strategy(rows.count())
    if strategy == "flat":
        return flat_topk(rows, query, k)
    if strategy == "prenormalised":
        return prenormalised_topk(with_norms(rows), query, k)
    return kept_index(rows).search(query, k, codes=True)
