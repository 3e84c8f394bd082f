"""SimHash near-duplicates, found through pivot distance tables.

A text's shingles are hashed by XXH64; bit b of its fingerprint says whether bit
b is set in over half of them. Texts link if their fingerprints differ in
``radius`` bits at most; linked texts form components.

Fingerprints are compared inside blocks only. Rows of a block are sorted, then
compared with the next, the second next and so on, all blocks of a batch at
once. For every row a table holds the Hamming distances to ``PIVOTS`` reference
fingerprints. By the triangle inequality a pair whose largest coordinate
difference exceeds the radius cannot link, and is discarded; survivors are
verified bit by bit. Pairs that already are in one component are not looked at
again, and only edges of a spanning forest leave a task, so that a large group of
near copies gives as many rows as it has members. Blocks over ``TILE`` rows are
cut into tiles, and every pair of tiles is a unit of work of its own.

Two ways to make blocks:

* ``pigeonhole``: exact. The fingerprint is cut into ``parts`` runs of bits; two
  fingerprints at most 3 bits apart agree in parts - 3 of them. Each choice
  of that many is a block key. More parts (longer keys) are taken as the
  number of distinct fingerprints grows.
* ``minima``: for a similarity of shingle sets, whose fingerprints are too far
  apart for the pigeonhole. Keys are runs of ``ROWS`` smallest permuted shingle hashes;
  texts with a Jaccard similarity of 0.8 share one of the ``BANDS`` keys with a
  probability of 0.997. Here fingerprints only choose pairs: those that survive are
  verified by the similarity of their sets of shingles (as 32-bit hashes), exactly.

With a similarity these blocks and the radius are only the quick way to most links. A second pass finds all
others: all sets are put in one order of shingles, those common in a sample last, and two sets of
n shingles that are alike by s share one of the first n - ceil(s n) + 1 of each. Each such shingle is a block of the texts
that hold it and have another beside them of like size and of another component. Of each pair in a block the overlap is bounded from
above by the counts of shingles in hash classes (about four shingles in a class), which is exact and costs a
sixteenth of the sets; only rows of pairs that the bound leaves are verified, without a radius.

Null text counts as empty. Texts without words have fingerprint zero and link
like any other. Rows with equal fingerprints (with a similarity: with equal sets of shingles, known by a
128-bit digest) are collapsed before blocks are made, so copies cost nothing. Blocks of very many rows are linked tile by tile first; then only rows outside of their
largest component are compared with all others (with a similarity the second pass does that). An empty table gives an empty result. Rows that
share a doc_id each get their own fingerprint; without a similarity the id stands for all of them, with one each
row has the component of its own text. A null doc_id comes after all others.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.components import components
from quarry.llm.wordbatch import mix, ordered_set

SEED = 42
PIVOTS = 24
TILE = 256
#: Tiles of a block up to which all pairs of tiles are compared at once; larger blocks are first linked tile by tile.
MOST_TILES = 16
#: Bytes of the bit table that counts common shingles in a unit.
BITS = 8 << 20
ROWS, BANDS = 3, 8
#: Fingerprint lanes of 64 bits for the similarity form: wide enough to tell 0.8 from 0.5.
LANES = 4
#: Rows of the sample whose common shingles come last in the order, and how many of these are known.
SAMPLE, OFTEN = 10_000, 1 << 18
#: Entries (shingle, text) of the second pass in a partition, and entries of one shingle that are looked at together.
ENTRIES = 1 << 18
#: Shingles in a hash class, on average, of the bound of a pair's overlap.
IN_CLASS = 4


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def pivots(lanes: int) -> np.ndarray:
    """The reference fingerprints: PIVOTS x lanes fixed pseudo-random integers."""
    return mix(np.arange(1, PIVOTS * lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(PIVOTS, lanes)


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    """The distance table: one row for each fingerprint (n x lanes), one column for each pivot."""
    table = np.empty((len(prints), PIVOTS), np.int16)
    for k, pivot in enumerate(pivots(prints.shape[1])):
        table[:, k] = _popcount(prints ^ pivot).sum(axis=1)
    return table


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of the whole sequence if it is shorter; none without words."""
    import xxhash

    joined = b" ".join(text.lower().split())  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not joined:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    count = len(gaps) + 2 - words
    if count <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    first, last = np.r_[0, gaps + 1][:count].tolist(), np.r_[gaps, len(joined)][words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, count)


def majorities(hashes: np.ndarray) -> np.ndarray:
    """Of each column of hashes (n x lanes) the 64 bits that are set in over half of them."""
    lanes = hashes.shape[1]
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        block = np.ascontiguousarray(hashes[at : at + (1 << 13)], "<u8").view(np.uint8).reshape(-1, 8 * lanes)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    return int(majorities(hashes[:, None])[0])


with np.errstate(over="ignore"):
    #: Multipliers and shifts of the permutations.
    _TIMES = np.arange(1, 2 * ROWS * BANDS, 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    _PLUS = np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)


def minima(hashes: np.ndarray) -> list[int]:
    """Block keys: BANDS hashes of ROWS minima of the permuted shingle hashes."""
    if not len(hashes):
        return [0] * BANDS
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        moved = hashes[at : at + (1 << 12), None] * _TIMES + _PLUS
        moved ^= moved >> np.uint64(29)
        low = np.minimum(low, moved.min(axis=0))
    keys = mix(low.reshape(BANDS, ROWS) * np.arange(1, 2 * ROWS, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def first_in_order(hashes: np.ndarray, similarity: float, often: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of a set of shingles those of which any set alike by ``similarity`` has one among its own first; ``often`` (sorted) come last."""
    n = len(hashes)
    first = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    rank = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        rank = np.where(often[at] == hashes, count[at], 0)
    return hashes[np.lexsort((hashes, rank))[:first]].astype("<u8")


def classes_of(hashes: np.ndarray) -> bytes:
    """How many shingles lie in each class of hashes; the number of classes is a power of two that grows with the set. A class of 255 stands for any number."""
    many = 1 << max(3, (len(hashes) // IN_CLASS).bit_length())
    counts = np.bincount((hashes >> np.uint64(32)) & np.uint64(many - 1), minlength=many)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, prints (array of one long) of each row: the fingerprint of the plain XXH64, a shingle as often as it occurs."""

    def make():
        def work(batch):
            prints = [[np.uint64(majority(shingle_hashes(text, words))).astype(np.int64)] for text in common.text_bytes(batch)]
            return {"doc_id": batch.column(0), "prints": pa.array(prints, pa.list_(pa.int64()))}

        return work

    return common.map_steps(common.doc_texts(docs), make, "doc_id long, prints array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and text_key, a digest of the text."""
    return common.doc_texts(docs).select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("text_key"))


SET_SCHEMA = "doc_id long, text_key string, digest binary, prints array<long>, keys array<long>, rare array<long>, size int, classes binary"


def set_prints(texts: DataFrame, words: int, similarity: float, often) -> DataFrame:
    """Of each row's set of shingles: digest, prints (LANES longs; lanes beyond 0 take a bijection of each hash), block keys, ``first_in_order``, size and ``classes_of``.

    ``texts`` is ``_keyed``; ``often``: the broadcast table of common shingles.
    """

    def make():
        def work(batch):
            out: dict[str, list] = {x.split()[0]: [] for x in SET_SCHEMA.split(", ")[2:]}
            with np.errstate(over="ignore"):
                for text in common.text_bytes(batch):
                    hashes = ordered_set(shingle_hashes(text, words))
                    out["digest"].append(hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest())
                    out["prints"].append(set_lanes(hashes))
                    out["keys"].append(minima(hashes))
                    out["rare"].append(first_in_order(hashes, similarity, *often.value).view(np.int64))
                    out["size"].append(len(hashes))
                    out["classes"].append(classes_of(hashes))
            kinds = {"binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "int": pa.int32()}
            given = {"doc_id": batch.column(0), "text_key": batch.column(2)}
            return given | {k: pa.array(out[k], kinds[t]) for k, t in (x.split() for x in SET_SCHEMA.split(", ")[2:])}

        return work

    return common.map_steps(texts, make, SET_SCHEMA)


def set_lanes(hashes: np.ndarray) -> list[int]:
    """The fingerprint of LANES lanes, all of them at once."""
    return majorities(np.column_stack([hashes, *(mix(hashes + np.uint64(k)) for k in range(1, LANES))])).view(np.int64).tolist()


def _pigeonhole(distinct: DataFrame, radius: int, count: int):
    """Block keys of lane 0: each choice of parts - radius among ``parts`` runs of bits."""
    parts = next((p for p in (radius + 1, radius + 2, radius + 3) if count < 64 * 2 ** (64 * (p - radius) // p)), radius + 3)
    edges = [64 * k // parts for k in range(parts + 1)]
    value = F.col("prints")[0]
    run = [F.shiftrightunsigned(F.shiftleft(value, 64 - edges[k + 1]), 64 - edges[k + 1] + edges[k]) for k in range(parts)]
    choices = list(combinations(range(parts), parts - radius))
    return distinct.withColumn("block", F.explode(F.array(*(F.xxhash64(F.lit(n), *(run[k] for k in chosen)) for n, chosen in enumerate(choices)))))


def _tiled(rows: DataFrame, within: int | None = None) -> DataFrame:
    """Gives each row of a block the units of work it belongs to: (block, low tile, high tile); other columns stay.

    Blocks of over ``within`` tiles only get the units of each tile with itself.
    """
    kept = [c for c in rows.columns if c != "block"]
    sizes = rows.groupBy("block").agg(F.count("*").alias("size")).where("size > 1")
    own = F.pmod(F.xxhash64("rep", "block"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    return (
        rows.join(sizes, "block")
        .withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(every if within is None else F.when(F.col("tiles") > within, F.array("own")).otherwise(every)))
        .select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *kept)
    )


def _rest_of_hot(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Units, with components, of the pairs that ``_tiled`` left out of blocks of over MOST_TILES tiles.

    Rows of a block's largest component are linked already: they only meet the block's other rows, which also meet one another.
    A block of n near copies, all of one component but m, so gives about n m / TILE rows.
    """
    kept = [c for c in rows.columns if c != "block"]
    hot = rows.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > MOST_TILES * TILE).select("block")
    placed = rows.join(hot, "block").join(classes, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    placed = common.written(placed, "simhash-hot")
    per = placed.groupBy("block", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    main = main.where("n_all > n_main").withColumns({"others": F.ceil((F.col("n_all") - F.col("n_main")) / TILE).cast("int"), "mains": F.ceil(F.col("n_main") / TILE).cast("int")})
    both = placed.join(main.drop("n_main", "n_all"), "block").withColumn("inside", F.col("component") == F.col("main"))
    own = F.when(F.col("inside"), F.col("others") + F.pmod(F.xxhash64("rep", "block"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("rep", "block"), F.col("others"))).cast("int")
    to = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    out = both.withColumn("own", own).withColumn("other", F.explode(to))
    return out.select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "component", *kept)


class Common:
    """Jaccard similarities of pairs of rows, from their sets of 32-bit hashes."""

    def __init__(self, sets: list[bytes]):
        self.sets = sets
        self.sizes = np.fromiter((len(x) // 4 for x in sets), np.int64, len(sets))

    def _set(self, i: int) -> np.ndarray:
        return np.frombuffer(self.sets[i], "<u4")

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The similarity of each pair (a[i], b[i]); of two empty sets it is 1."""
        if len(a) < 256:
            both = np.fromiter((len(np.intersect1d(self._set(x), self._set(y), assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
        else:
            both = self._by_bits(a, b)
        whole = self.sizes[a] + self.sizes[b] - both
        return np.where(whole > 0, both / np.maximum(whole, 1), 1.0)

    def _by_bits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common hashes of many pairs: a bit for each (row, hash held by several rows), so many hashes at a time as BITS has room for."""
        rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = place[: len(a)], place[len(a) :]
        flat = np.concatenate([self._set(i) for i in rows.tolist()])
        owner = np.repeat(np.arange(len(rows)), self.sizes[rows])
        hashes, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        several = times[column] > 1
        column, owner = (np.cumsum(times > 1) - 1)[column[several]], owner[several]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        wide = max(64, BITS * 8 // len(rows) // 64 * 64)
        both = np.zeros(len(a), np.int64)
        for low in range(0, int((times > 1).sum()), wide):
            part = slice(*np.searchsorted(column, [low, low + wide]))
            table = np.zeros((len(rows), min(wide, -(-len(hashes) // 64) * 64) // 8), np.uint8)
            at = column[part] - low
            np.bitwise_or.at(table, (owner[part], at // 8), (1 << (at % 8)).astype(np.uint8))
            table = table.view(np.uint64)
            step = max(16, BITS // (8 * table.shape[1]))
            for k in range(0, len(a), step):
                some = slice(k, k + step)
                both[some] += _popcount(table[left[some]] & table[right[some]]).sum(axis=1, dtype=np.int64)
        return both


def link_batch(unit: np.ndarray, own: np.ndarray, rep: np.ndarray, prints: np.ndarray, radius: int, sets: list[bytes] | None = None, similarity: float = 0.0, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each unit; rows are sorted by unit.

    In a unit of two tiles (``own`` differs) only pairs across them count; pairs inside have their own units.
    With ``sets``, a pair links if its similarity is ``similarity`` or more besides. Rows of
    a ``group`` are linked already.
    """
    n = len(unit)
    table = pivot_distances(prints)
    common_shingles = Common(sets) if sets is not None else None
    root = np.arange(n)
    if group is not None and n:
        order = np.lexsort((group, unit))
        starts = np.flatnonzero(np.r_[True, (unit[order][1:] != unit[order][:-1]) | (group[order][1:] != group[order][:-1])])
        root[order] = np.repeat(order[starts], np.diff(np.r_[starts, n]))
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    stop = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    crossing = np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first)
    crossing = np.repeat(crossing, np.diff(np.r_[first, n]))
    active = np.arange(n)
    lag = 1
    while True:
        active = active[active + lag < stop[active]]
        if not len(active):
            break
        a, b = active, active + lag
        fresh = (root[a] != root[b]) & (~crossing[a] | (own[a] != own[b]))
        a, b = a[fresh], b[fresh]
        for low in range(0, PIVOTS, 6):  # the largest coordinate difference, a few pivots at a time
            close = (np.abs(table[a, low : low + 6] - table[b, low : low + 6]) <= radius).all(axis=1)
            a, b = a[close], b[close]
        near = _popcount(prints[a] ^ prints[b]).sum(axis=1) <= radius
        a, b = a[near], b[near]
        if common_shingles and len(a):
            sizes = common_shingles.sizes
            fits = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
            a, b = a[fits], b[fits]
        if common_shingles and len(a):
            alike = common_shingles.pairs(a, b) >= similarity
            a, b = a[alike], b[alike]
        joined = False
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                joined = True
        if joined:
            while True:
                higher = root[root]
                if (higher == root).all():
                    break
                root = higher
        lag += 1
    linked = root != np.arange(n) if group is None else group[root] != group
    return rep[root[linked]], rep[linked]


def _edges(units: DataFrame, radius: int, lanes: int, similarity: float | None = None) -> DataFrame:
    """src, dst: representatives that link, a forest for each unit. With ``similarity``, units have shingles."""

    def work(table: pa.Table, unit: np.ndarray):
        prints = table["prints"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
        sets = None if similarity is None else table["shingles"].to_pylist()
        group = table["component"].to_numpy() if "component" in table.column_names else None
        src, dst = link_batch(unit, table["own"].to_numpy(), table["rep"].to_numpy(), prints, radius, sets, similarity or 0.0, group)
        return pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return _by_unit(units, work, "src long, dst long", ("prints",))


def near_components(docs: DataFrame, words: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, prints, component_id (the smallest doc_id that links lead to) for each row of ``docs``.

    Without ``similarity``: all links of fingerprints at most ``radius`` (3 or fewer) bits apart, exactly.
    With it: texts whose sets of shingles have that Jaccard similarity or more link, all of them and no others; the
    fingerprint that chooses most pairs then has LANES lanes, and its radius follows from the similarity (``radius_for``).
    """
    if similarity is not None:
        prints, distinct, classes = _alike(docs, words, similarity)
        named = _placed(distinct, classes)
        first = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = named.join(first, "component").select("digest", "component_id")
        return prints.join(named, "digest", "left").select("doc_id", "prints", F.coalesce("component_id", "doc_id").alias("component_id"))
    common.prepare(docs.sparkSession)
    prints = common.written(fingerprints(docs, words), "simhash")
    distinct = prints.groupBy("prints").agg(F.min("doc_id").alias("rep"))
    distinct = common.written(distinct.where("rep is not null"), "simhash-distinct")
    keyed = _pigeonhole(distinct, radius, distinct.count())
    edges = common.written(_edges(_tiled(keyed, MOST_TILES), radius, 1).distinct(), "simhash-links")
    classes = components(edges)
    if not keyed.groupBy("block").count().where(F.col("count") > MOST_TILES * TILE).isEmpty():
        rest = common.written(_edges(_rest_of_hot(keyed, classes), radius, 1).distinct(), "simhash-rest")
        classes = components(edges.union(rest))
    named = distinct.join(classes, distinct["rep"] == classes["node"], "left").select("prints", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "prints", "left").select("doc_id", "prints", F.coalesce("component_id", "doc_id").alias("component_id"))


def _alike(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``set_prints`` of each row without what only pairs need; each distinct set under a number ``rep``, with the row it is read from; node, component of numbers that link)."""
    spark = common.prepare(docs.sparkSession)
    texts = _keyed(docs)
    often = spark.sparkContext.broadcast(_often(texts, words))  # OFTEN numbers
    every = common.written(set_prints(texts, words, similarity, often), "simhash")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_key")
    distinct = every.groupBy("digest").agg(F.min(place).alias("place"), *(F.min(c).alias(c) for c in ("keys", "rare", "size", "classes")))
    at = (F.nullif("place.id", F.lit(2**63 - 1)).alias("doc_id"), F.col("place.text_key").alias("text_key"))
    distinct = common.written(distinct.select(F.monotonically_increasing_id().alias("rep"), "digest", *at, "keys", "rare", "size", "classes"), "simhash-distinct")
    keyed = distinct.select("rep", F.posexplode("keys").alias("n", "key")).select("rep", F.xxhash64("n", "key").alias("block"))
    edges = _verified(_tiled(keyed, MOST_TILES), distinct, texts, words, radius_for(similarity), similarity)
    classes = components(edges)
    blocks = _shared_rare(_placed(distinct, classes), similarity)
    units = common.written(_tiled(blocks).join(_placed(distinct, classes).select("rep", "component", "size", "classes"), "rep"), "simhash-bounds")
    rest = _verified(_promising(units, similarity), distinct, texts, words, 64 * LANES, similarity)
    for table in (blocks, units):
        common.forget(table)
    if not rest.isEmpty():
        classes = components(edges.union(rest))
    return every.select("doc_id", "text_key", "digest", "prints"), distinct.select("rep", "digest", "doc_id", "text_key"), classes


def _placed(distinct: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct sets with their component (their own number, if they link to none)."""
    return distinct.join(classes, distinct["rep"] == classes["node"], "left").drop("node").withColumn("component", F.coalesce("component", "rep"))


def _often(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) of over one text of a sample, and the number of texts; the OFTEN most common at most."""
    step = max(1, texts.count() // SAMPLE)

    def make():
        def work(batch):
            hashes, count = np.unique(np.concatenate([ordered_set(shingle_hashes(t, words)) for t in common.text_bytes(batch)]), return_counts=True)
            return {"hash": pa.array(hashes.view(np.int64)), "count": pa.array(count)}

        return work

    some = common.map_steps(texts.where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(step)) == 0), make, "hash long, count long")
    found = some.groupBy("hash").agg(F.sum("count").alias("count")).where("count > 1").orderBy(F.desc("count"), "hash").limit(OFTEN).toArrow()
    hashes = found["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["count"].to_numpy()[order]


def _groups(column: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, column[1:] != column[:-1]])


def like_sizes(hashes: np.ndarray, sizes: np.ndarray, components: np.ndarray | None, similarity: float) -> np.ndarray:
    """Which entries, sorted by hash and size, may have a partner: one of the hash's entries of a size near enough, where the hash has several components (None: it has)."""
    if not len(hashes):
        return np.zeros(0, bool)
    near = (hashes[1:] == hashes[:-1]) & (sizes[:-1] >= similarity * sizes[1:] - 1e-9)
    keep = np.r_[near, False] | np.r_[False, near]
    if components is None:
        return keep
    first = _groups(hashes)
    several = np.minimum.reduceat(components, first) != np.maximum.reduceat(components, first)
    return keep & np.repeat(several, np.diff(np.r_[first, len(hashes)]))


def _shared_rare(placed: DataFrame, similarity: float) -> DataFrame:
    """block, rep: texts of different components that share one of their ``rare`` shingles. A block is named after its texts, so that shingles of the same texts give one block."""
    total = placed.agg(F.sum(F.size("rare"))).first()[0] or 0
    entries = placed.select(F.explode("rare").alias("hash"), "size", "rep", "component")
    dealt = entries.repartition(max(16, total // ENTRIES + 1), "hash").sortWithinPartitions("hash", "size")

    def task(batches):
        held: list[np.ndarray] = []
        streamed = None  # a hash of very many texts, part of which has gone out: its block has the hash for a name

        def blocks(hashes, sizes, reps, components):
            if streamed is not None and len(hashes) and hashes[0] == streamed:
                end = int(np.append(_groups(hashes), len(hashes))[1])
                keep = like_sizes(hashes[:end], sizes[:end], None, similarity)
                yield pa.RecordBatch.from_pydict({"block": pa.array(hashes[:end][keep]), "rep": pa.array(reps[:end][keep])})
                hashes, sizes, reps, components = hashes[end:], sizes[end:], reps[end:], components[end:]
            keep = like_sizes(hashes, sizes, components, similarity)
            hashes, reps = hashes[keep], reps[keep]
            if not len(hashes):
                return
            first = _groups(hashes)
            n = np.diff(np.r_[first, len(hashes)])
            with np.errstate(over="ignore"):
                block = np.add.reduceat(mix(reps.view(np.uint64)), first).view(np.int64)
            _, at = np.unique(block, return_index=True)
            rows = np.repeat(first[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.repeat(block[at], n[at])), "rep": pa.array(reps[rows])})

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in range(4)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            cut = int(_groups(held[0])[-1])  # the last hash may go on in the next batch
            if cut:
                yield from blocks(*(x[:cut] for x in held))
                held, streamed = [x[cut:] for x in held], None
            if len(held[0]) > ENTRIES and (streamed is not None or held[3].min() != held[3].max() or len(held[0]) > 64 * ENTRIES):
                streamed = held[0][0]
                yield from blocks(*held)
                held = [x[-1:] for x in held]  # beside the last stands the next
        if held:
            yield from blocks(*held)

    return common.written(dealt.mapInArrow(task, "block long, rep long").distinct(), "simhash-rare")


def promising(unit: np.ndarray, own: np.ndarray, group: np.ndarray, sizes: np.ndarray, classes: list[bytes], similarity: float) -> np.ndarray:
    """Which rows, sorted by unit, are in a pair of their unit and of two groups whose overlap may reach ``similarity``, by the bound of their classes' counts."""
    n = len(unit)
    width = np.fromiter(map(len, classes), np.int64, n)
    at = np.cumsum(width) - width
    flat = np.frombuffer(b"".join(classes), np.uint8)
    full = np.fromiter((b"\xff" in x for x in classes), bool, n)
    first = _groups(unit)
    stop = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    crossing = np.repeat(np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first), np.diff(np.r_[first, n]))
    found = np.zeros(n, bool)
    active, lag = np.arange(n), 1

    def folded(rows: np.ndarray, wide: int, many: int) -> np.ndarray:
        return flat[at[rows][:, None] + np.arange(wide)].astype(np.int16).reshape(len(rows), wide // many, many).sum(axis=1)

    while len(active := active[active + lag < stop[active]]):
        a, b = active, active + lag
        fits = (group[a] != group[b]) & (~crossing[a] | (own[a] != own[b])) & ~(found[a] & found[b])
        a, b = a[fits], b[fits]
        fits = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
        a, b = a[fits], b[fits]
        kind = width[a] * (1 << 32) + width[b]
        for k in np.unique(kind).tolist():
            some = np.flatnonzero(kind == k)
            x, y, many = k >> 32, k & ((1 << 32) - 1), min(k >> 32, k & ((1 << 32) - 1))
            for low in range(0, len(some), step := max(1, BITS // (8 * max(x, y)))):
                p, q = a[some[low : low + step]], b[some[low : low + step]]
                most = np.minimum(folded(p, x, many), folded(q, y, many)).sum(axis=1, dtype=np.int64)
                hit = (most >= similarity / (1 + similarity) * (sizes[p] + sizes[q]) - 1e-6) | full[p] | full[q]
                found[p[hit]] = found[q[hit]] = True
        lag += 1
    return found


_UNIT = ("block", "low", "high")


def _by_unit(units: DataFrame, work, schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``work`` (of a table of whole units and the number of each row's unit) over all units, several at once."""

    def numbers(table: pa.Table) -> np.ndarray:
        cols = [table[k].to_numpy() for k in _UNIT]
        return np.cumsum(np.r_[0, np.any([c[1:] != c[:-1] for c in cols], axis=0)]) if len(table) else np.zeros(0, int)

    def task(batches):
        held, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            size += batch.nbytes
            if held.num_rows < 4 * TILE and size < 4 * BITS:
                continue
            change = _groups(numbers(held))
            if len(change) > 1:
                cut = int(change[-1])  # the last unit may go on in the next batch
                part = held.slice(0, cut).combine_chunks()
                yield work(part, numbers(part))
                held = held.slice(cut).combine_chunks()
                size = held.nbytes
        if held is not None and held.num_rows:
            held = held.combine_chunks()
            yield work(held, numbers(held))

    return units.repartition(*_UNIT).sortWithinPartitions(*_UNIT, *order).mapInArrow(task, schema)


def _promising(units: DataFrame, similarity: float) -> DataFrame:
    """The units' rows that are in a promising pair, each unit named after them, so that units of the same rows are one."""

    def work(table: pa.Table, unit: np.ndarray):
        own, rep, group = (table[k].to_numpy() for k in ("own", "rep", "component"))
        keep = promising(unit, own, group, table["size"].to_numpy(), table["classes"].to_pylist(), similarity)
        unit, rep, group = unit[keep], rep[keep], group[keep]
        if not len(unit):
            none = pa.array([], pa.int64())
            return pa.RecordBatch.from_arrays([none, none.cast("int32"), none.cast("int32"), none.cast("int32"), none, none], names=[*_UNIT, "own", "rep", "component"])
        high = (own > table["low"].to_numpy())[keep].astype(np.int32)  # of two tiles the second
        first = _groups(unit)
        n = np.diff(np.r_[first, len(unit)])
        with np.errstate(over="ignore"):
            block = np.repeat(np.add.reduceat(mix(rep.view(np.uint64) * np.uint64(2) + high.astype(np.uint64)), first).view(np.int64), n)
        both = np.repeat(np.maximum.reduceat(high, first), n)
        return pa.RecordBatch.from_pydict({"block": block, "low": np.zeros(len(block), np.int32), "high": both, "own": high, "rep": rep, "component": group})

    return _by_unit(units, work, "block long, low int, high int, own int, rep long, component long").distinct()


def _verified(units: DataFrame, distinct: DataFrame, texts: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """src, dst: the links within the units, a forest for each, by the sets of their rows; sets are made anew for the texts that share a unit with another."""
    units = common.written(units, "simhash-units")
    members = distinct.join(units.select("rep").distinct(), "rep").select("rep", "digest", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"))
    some = texts.join(members, texts["doc_id"].eqNullSafe(members["own_id"]) & (texts["text_key"] == members["own_key"])).select("rep", "text")

    def make():
        def work(batch):
            prints, sets = [], []
            with np.errstate(over="ignore"):
                for text in common.text_bytes(batch):
                    hashes = ordered_set(shingle_hashes(text, words))
                    prints.append(set_lanes(hashes))
                    sets.append(ordered_set(hashes >> np.uint64(32)).astype("<u4").tobytes())
            return {"rep": batch.column(0), "prints": pa.array(prints, pa.list_(pa.int64())), "shingles": pa.array(sets, pa.binary())}

        return work

    sets = common.written(common.map_steps(some, make, "rep long, prints array<long>, shingles binary").dropDuplicates(["rep"]), "simhash-shingles")
    edges = common.written(_edges(units.join(sets, "rep"), radius, LANES, similarity).distinct(), "simhash-links")
    for table in (units, sets):
        common.forget(table)
    return edges


def radius_for(similarity: float) -> int:
    """Bits by which fingerprints of LANES lanes differ at a Jaccard similarity, plus three standard deviations."""
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine)) / np.pi
    bits = 64 * LANES
    return int(round(bits * share + 3 * np.sqrt(bits * share * (1 - share))))


def hex_print(column: str = "prints"):
    """Lane 0 as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)[0]), 16, "0"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays (null after all others; of rows
    with one id, the smallest digest of the text; of rows with one id and one text, any one).
    """
    prints, distinct, classes = _alike(docs, words, similarity)
    last = F.lit(2**63 - 1)
    first = _placed(distinct, classes).groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "text_key")).alias("first")).select("first.*", F.lit(True).alias("stays"))
    counted = prints.groupBy(F.coalesce("doc_id", last).alias("id"), "text_key").agg(F.count("*").alias("n"))
    judged = counted.join(first, ["id", "text_key"], "left").select("id", "text_key", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    judged = common.written(judged.where("not stays or n > 1"), "simhash-dropped")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    row_id = F.coalesce(docs["doc_id"].cast("long"), last)
    same = lambda table: (row_id == table["id"]) & (key == table["text_key"])
    gone = judged.where("not stays")
    left = docs.join(gone, same(gone), "left_anti")
    repeated = judged.where("stays")
    if repeated.isEmpty():
        return left
    once = docs.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, same(repeated), "left_anti").unionByName(once)
