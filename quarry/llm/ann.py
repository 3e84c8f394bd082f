"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Vectors are scaled to length one. Coarse centroids (spherical k-means) and the
codebooks of their residuals are fitted to a bounded sample: the first valid vectors
by a hash of their id, SAMPLE of them, or PER_CELL for each cell where that is more (SAMPLE_BYTES at most). There are about as many cells as the square root of
the rows, CELLS at most; above FLAT they are fitted in two levels, groups first. Every row is indexed: assigned to its nearest
centroid's cell (of the nearest group) and coded, and the length of what the code leaves out is kept. A query's asymmetric distance table holds its products with all codewords; a
vector's approximate score is the centroid's product plus one table entry for
each part of its code.

Reranking has no fixed size. A query knows a bar, the k-th best exact score so far: first among BARS rows of the sample, then
of the best approximate scores of a unit. Every row of the probed cells whose approximate score plus ``margin`` times its left-out length
reaches the bar is scored exactly, in double precision, from the original vectors (ties to the smaller id). ``margin`` is found on the sample, by brute force: what nearly all true neighbours need.

How many cells a query probes is found there too: for queries grouped by their bar, so that lonely ones get more cells, the number of
cells needed to hold ``target`` of the true neighbours. Vectors without structure need a large share;
clustered ones a small one. A query goes on to further cells until its cells hold k rows beside its own.

Cells are dealt to units of work of about ``unit_rows`` rows, which grows with the square root of the rows; small cells share a unit, a larger cell (one
common vector may be a third of all rows) is cut into several by a hash of the id. Queries go to the units of
their cells and stream past them; only a unit that over QUERIES queries ask is copied. So a task's memory is bounded, and each
(query, unit) gives ``k`` rows at most.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, neither do rows without id. A query id that is repeated is one query
(its first vector in order). An empty table gives an empty result; with fewer than k candidates
all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common

SAMPLE, PER_CELL = 16_384, 8
CELLS, FLAT = 32_768, 1024
#: Bytes of the sample in double precision, and products of queries and centroids that a task holds, at most.
SAMPLE_BYTES, PRODUCTS = 1 << 28, 1 << 21
UNIT = (1024, 32_768)
QUERIES = 16_384
BARS = 4096
#: Sampled queries that the calibration asks, and the groups they fall into by their bar.
ASKED, BANDS = 512, 8
TARGET = 0.98


@dataclass
class Index:
    """What is fitted: bounded by CELLS x dimension, 256 x dimension and BARS x dimension."""

    centroids: np.ndarray  # cells x dimension, groups one after another
    groups: np.ndarray  # groups x dimension
    begin: np.ndarray  # where each group's cells begin, and the end
    codebooks: np.ndarray  # parts x words x part dimension
    edges: np.ndarray  # bars that part the bands
    probes: np.ndarray  # cells for each band
    margin: float
    bars: np.ndarray  # vectors of the sample, and their ids
    bar_ids: np.ndarray


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    vectors = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=1e-300))
    vectors = np.ldexp(vectors, -exponent[:, None])
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine in double precision; equal rows get equal values wherever they stand."""
    q, v = query.astype(np.float64), vectors.astype(np.float64)
    _, e = np.frexp(np.abs(v).max(axis=1, initial=1e-300))
    v = np.ldexp(v, -e[:, None])
    _, e = np.frexp(np.abs(q).max())
    q = np.ldexp(q, -e)
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def _kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres, spherical)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        alive = count > 0
        centres[alive] = sums[alive] / count[alive, None]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    bias = 0 if spherical else (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ centres.T - bias).argmax(axis=1)
    return out


def _cells_of(x: np.ndarray, groups: np.ndarray, begin: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cell of each unit vector: the nearest of its nearest group's."""
    if len(groups) == 1:
        return _nearest(x, centroids, True)
    group = _nearest(x, groups, True)
    out = np.empty(len(x), np.int64)
    for g in np.unique(group).tolist():
        at = np.flatnonzero(group == g)
        out[at] = begin[g] + _nearest(x[at], centroids[begin[g] : begin[g + 1]], True)
    return out


def _centroids(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, where their cells begin, centroids)."""
    if cells <= FLAT:
        return np.zeros((1, sample.shape[1])), np.array([0, cells]), _kmeans(sample, cells, 10, True)
    groups = _kmeans(sample, int(np.sqrt(cells)), 10, True)
    group = _nearest(sample, groups, True)
    alive = np.unique(group)
    groups, parts = groups[alive], [sample[group == g] for g in alive.tolist()]
    found = [_kmeans(p, max(1, len(p) * cells // len(sample)), 6, True) for p in parts]
    return groups, np.cumsum([0, *map(len, found)]), np.concatenate(found)


def cells_for(count: int, sample: int) -> int:
    return int(np.clip(np.sqrt(count), 1, min(CELLS, max(1, sample // PER_CELL))))


def fit(sample: np.ndarray, ids: np.ndarray, count: int, target: float = TARGET, k: int = 5) -> Index:
    """Fits the index for ``count`` rows to a sample of unit vectors and their ids."""
    dimension = sample.shape[1]
    groups, begin, centroids = _centroids(sample, cells_for(count, len(sample)))
    near = _cells_of(sample, groups, begin, centroids)
    residual = sample - centroids[near]
    width = next(w for w in (4, 2, 1) if dimension % w == 0)
    words = min(256, len(sample))
    few = residual[:4096]
    codebooks = np.stack([_kmeans(np.ascontiguousarray(few[:, a : a + width]), min(words, len(few)), 6, False) for a in range(0, dimension, width)])
    index = Index(centroids, groups, begin, codebooks, np.zeros(0), np.ones(1, np.int64), 1.0, sample[:BARS].astype(np.float32), ids[:BARS])
    some = sample[:SAMPLE]
    asked = np.arange(0, len(some), max(1, len(some) // ASKED))
    scores = some[asked] @ some.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(some) - 1))]
    needed = np.zeros(len(asked))  # cells before that of the furthest neighbour
    for i, q in enumerate(asked.tolist()):
        products = centroids @ some[q]
        needed[i] = (products > products[near[best[i]]].min()).sum()
    bar = bars_of(index, some[asked], ids[asked], k)
    index.edges = np.quantile(bar, np.arange(1, BANDS) / BANDS)
    band = np.searchsorted(index.edges, bar, side="right")
    index.probes = np.array([int(np.ceil(np.quantile(needed[band == b], target))) + 2 if (band == b).any() else len(centroids) for b in range(BANDS)])
    # What the codes leave out, of true neighbours and of the vectors themselves, as a share of its length.
    at = np.concatenate([best.ravel(), asked])
    by = np.concatenate([np.repeat(asked, best.shape[1]), asked])
    cell, codes, left = encode(index, some[at])
    coded = np.concatenate([codebooks[p][codes[:, p].astype(np.int64)] for p in range(len(codebooks))], axis=1)
    exact, rough = (some[at] * some[by]).sum(axis=1), ((centroids[cell] + coded) * some[by]).sum(axis=1)
    share = (exact - rough) / np.maximum(left, 1e-6)
    index.margin = float(min(1.0, max(0.05, 1.1 * np.quantile(share, 0.998))))
    return index


def bars_of(index: Index, queries: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query (unit vectors) a score that its k-th neighbour reaches at least; -2 if the sample has too few rows."""
    if len(index.bars) <= k + 1:
        return np.full(len(queries), -2.0)
    scores = queries.astype(np.float32) @ index.bars.T
    scores[ids[:, None] == index.bar_ids[None, :]] = -2
    return np.partition(scores, len(index.bars) - k, axis=1)[:, len(index.bars) - k].astype(np.float64) - 1e-5


def encode(index: Index, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, codes: rows x parts, length of what the code leaves out) of unit vectors."""
    cell = _cells_of(vectors, index.groups, index.begin, index.centroids)
    residual = vectors - index.centroids[cell]
    width = index.codebooks.shape[2]
    codes, left = [], np.zeros(len(vectors))
    for p, book in enumerate(index.codebooks):
        part = residual[:, p * width : (p + 1) * width]
        codes.append(_nearest(part, book, False))
        left += ((part - book[codes[-1]]) ** 2).sum(axis=1)
    return cell, np.column_stack(codes).astype(np.uint8), np.sqrt(left)


def valid(embeddings: DataFrame, size: int | None = None) -> DataFrame:
    """vec_id and vector (array of float or double) of the rows that take part: those of ``size`` components, or of the usual number."""
    kind = embeddings.schema["embedding"].dataType
    vector = F.col("embedding") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    if size is None:
        usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        size = usual[0]["n"] if usual else 0
    return rows.where(F.size("vector") == size)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def places(sizes: dict[int, int], unit_rows: int) -> tuple[dict[int, int], dict[int, int]]:
    """(first unit, number of units) of each cell: small cells share a unit, a large one has several of its own."""
    first, parts, free, held = {}, {}, 0, 0
    for cell in sorted(sizes):
        if sizes[cell] > unit_rows:
            free += held > 0
            first[cell], parts[cell], held = free, -(-sizes[cell] // unit_rows), 0
            free += parts[cell]
        else:
            if held and held + sizes[cell] > unit_rows:
                free, held = free + 1, 0
            first[cell], parts[cell], held = free, 1, held + sizes[cell]
    return first, parts


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` (vec_id, embedding) the k nearest found among ``embeddings``, its own id left out."""
    session = embeddings.sparkSession
    spark = common.prepare(session).sparkContext
    rows = valid(embeddings)
    count = rows.count()
    if not count:
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = f"array<{rows.schema['vector'].dataType.elementType.simpleString()}>"
    wanted = max(sample, PER_CELL * min(CELLS, int(np.sqrt(count)))) if count > FLAT**2 else sample
    wanted = max(1, min(wanted, SAMPLE_BYTES // (8 * len(rows.select("vector").first()["vector"]))))
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(wanted).toArrow()
    index = fit(unit(_matrix(taken["vector"])), taken["vec_id"].to_numpy(), count, target, k)
    asked = valid(queries, index.centroids.shape[1]).groupBy("vec_id").agg(F.min(F.col("vector").cast(kind)).alias("vector"), F.count("*").alias("copies"))
    shared = spark.broadcast(index)

    def code():
        def work(batch):
            cell, codes, left = encode(shared.value, unit(_matrix(batch.column(1))))
            return {"vec_id": batch.column(0), "vector": batch.column(1), "cell": pa.array(cell, pa.int32()), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "left": pa.array(left, pa.float32())}

        return work

    coded = common.written(_map(rows, code, f"vec_id long, vector {kind}, cell int, code binary, left float"), "ann-index")
    sizes = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # CELLS rows at most
    first, parts = places(sizes, int(np.clip(2 * np.sqrt(count), *UNIT)))
    place = session.createDataFrame([(c, first[c], parts[c]) for c in sizes], "cell int, first int, parts int")

    def probe():
        ix = shared.value
        held = np.array([sizes.get(c, 0) for c in range(len(ix.centroids))])

        def work(batch):
            vectors, ids = unit(_matrix(batch.column(1))), batch.column(0).to_numpy()
            bar = bars_of(ix, vectors, ids, k)
            probes = ix.probes[np.searchsorted(ix.edges, bar, side="right")]
            wanted = k + batch.column(2).to_numpy()
            out: list[tuple] = []
            step = max(1, PRODUCTS // len(ix.centroids))
            for low in range(0, len(ids), step):
                order = np.argsort(-(vectors[low : low + step] @ ix.centroids.T), axis=1, kind="stable")
                enough = (np.cumsum(held[order], axis=1) < wanted[low : low + step, None]).sum(axis=1) + 1
                for i, n in enumerate(np.maximum(probes[low : low + step], enough).tolist()):
                    by_unit: dict[int, list[int]] = {}
                    for c in order[i, :n].tolist():
                        for u in range(first.get(c, 0), first.get(c, 0) + parts.get(c, 0)):
                            by_unit.setdefault(u, []).append(c)
                    out += [(u, low + i, cs) for u, cs in by_unit.items()]
            u, i, cs = zip(*out, strict=True) if out else ((), (), ())
            at = np.array(i, np.int64)
            return {"unit": pa.array(u, pa.int32()), "vec_id": pa.array(ids[at]), "vector": batch.column(1).take(pa.array(at)), "bar": pa.array(bar[at]), "cells": pa.array(cs, pa.list_(pa.int32()))}

        return work

    probes = common.written(_map(asked, probe, f"unit int, vec_id long, vector {kind}, bar double, cells array<int>"), "ann-probes")
    copies = probes.groupBy("unit").count().where(F.col("count") > QUERIES).select("unit", F.ceil(F.col("count") / QUERIES).cast("int").alias("copies"))
    units = (
        coded.join(F.broadcast(place), "cell")  # CELLS rows at most
        .withColumn("unit", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        .join(copies, "unit", "left")
        .select("unit", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("kind"), "vec_id", "vector", "cell", "code", "left", F.lit(None).cast("double").alias("bar"), F.lit(None).cast("array<int>").alias("cells"))
    )
    asking = probes.join(copies, "unit", "left").select(
        "unit", F.pmod(F.xxhash64("vec_id"), F.coalesce("copies", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("kind"), "vec_id", "vector",
        F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("left"), "bar", "cells",
    )
    dealt = units.unionByName(asking).repartition("unit", "part").sortWithinPartitions("unit", "part", "kind", "cell", "vec_id")

    def match(batches):
        """Rows of a unit come first and are held; its queries stream past them."""
        now, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if now != tuple(keys[a, :2]):
                    now, held, ready = tuple(keys[a, :2]), [], None
                if keys[a, 2] == 0:
                    held.append(part)
                elif held:
                    ready = ready or Rows(shared.value, pa.Table.from_batches(held))
                    yield ready.nearest(part, k)

    found = dealt.mapInArrow(match, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Rows:
    """The rows of a unit, in order of cell and id."""

    def __init__(self, index: Index, table: pa.Table):
        self.index = index
        self.ids, cell = table["vec_id"].to_numpy(), table["cell"].to_numpy()
        self.vectors, self.left = _matrix(table["vector"]), table["left"].to_numpy().astype(np.float64)
        codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(self.ids), -1).astype(np.int64)
        self.begin = {int(c): (int(a), int(b)) for c, a, b in zip(*_bounds(cell), strict=True)}
        self.flat = codes + np.arange(codes.shape[1]) * index.codebooks.shape[1]

    def nearest(self, asking: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """query_id, vec_id, score of the k best rows for each query, as far as they reach its bar."""
        ix = self.index
        column = lambda name: asking.column(asking.schema.get_field_index(name))
        queries = _matrix(column("vector"))
        scaled = unit(queries)
        n_parts, _, width = ix.codebooks.shape
        out: tuple[list, list, list] = ([], [], [])
        for q, (query_id, cells, bar) in enumerate(zip(column("vec_id").to_pylist(), column("cells").to_pylist(), column("bar").to_pylist(), strict=True)):
            table = np.einsum("pwd,pd->pw", ix.codebooks, scaled[q].reshape(n_parts, width)).ravel()
            ranges = [(c, *self.begin[c]) for c in cells if c in self.begin]
            if not ranges:
                continue
            at = np.concatenate([np.arange(a, b) for _, a, b in ranges])
            rough = table[self.flat[at]].sum(axis=1) + np.repeat(ix.centroids[[c for c, _, _ in ranges]] @ scaled[q], [b - a for _, a, b in ranges])
            other = self.ids[at] != query_id
            at, rough = at[other], rough[other]
            if not len(at):
                continue
            ahead = np.argpartition(-rough, 4 * k)[: 4 * k] if len(at) > 4 * k else np.arange(len(at))
            exact = np.full(len(at), -np.inf)
            exact[ahead] = cosine(queries[q], self.vectors[at[ahead]])
            if len(ahead) >= k:
                bar = max(bar, float(np.partition(exact[ahead], len(ahead) - k)[len(ahead) - k]))
            more = np.flatnonzero((rough + ix.margin * self.left[at] >= bar - 1e-9) & np.isneginf(exact))
            exact[more] = cosine(queries[q], self.vectors[at[more]])
            best = np.lexsort((self.ids[at], -exact))[:k]
            best = best[~np.isneginf(exact[best])]
            out[0].extend([query_id] * len(best))
            out[1].extend(self.ids[at[best]].tolist())
            out[2].extend(exact[best].tolist())
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _bounds(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return cell[first], first, np.r_[first[1:], len(cell)]


def _map(df: DataFrame, make, schema: str) -> DataFrame:
    def task(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch))

    return df.mapInArrow(task, schema)
