"""Hash trees that change, proofs of parts of them, what is signed, and what to do about errors.

A tree is a table (level, idx, hash) as ``integrity.levels`` makes it. Changes recompute the paths above what changed, level by level, by joins on idx div 2. A
proof of a subset is the covered leaves and the siblings that their paths need, no node twice; it is bound to the grid it was taken from.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import integrity
from quarry.sources.shared import written

# Bytes before what is hashed (root attribute, grid, coverage), ids of hash algorithms, size of a packed root.
ROOT_PREFIX, GRID_PREFIX, COVER_PREFIX = "03", "04", "05"
ALGORITHMS = {"sha256": 0, "blake3": 1, "k12": 2}
PACKED_ROOT = 129


def updated(tree: DataFrame, changes: DataFrame, depth: int) -> DataFrame:
    """The tree (level, idx, hash) with the leaves of ``changes`` (idx, hash) replaced; only nodes above them are hashed anew. The tree and each level of changes are stored on the way."""
    tree = written(tree, "tree")
    new = written(changes.select(F.col("idx").cast("long").alias("idx"), "hash"), "tree-level")
    out = new.select(F.lit(0).alias("level"), "idx", "hash")
    for level in range(depth):
        nodes = tree.where(F.col("level") == level).select("idx", F.col("hash").alias("old"))
        parents = new.select(F.floor(F.col("idx") / 2).alias("up")).distinct()
        under = nodes.join(parents, F.floor(F.col("idx") / 2) == F.col("up"), "left_semi").join(new, "idx", "left").select("idx", F.coalesce("hash", "old").alias("hash"))
        new = written(under.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(integrity.pair_hash(F.min_by("hash", "idx"), F.max_by("hash", "idx")).alias("hash")), "tree-level")
        out = out.unionByName(new.select(F.lit(level + 1).alias("level"), "idx", "hash"))
    fresh = out.withColumnRenamed("hash", "new")
    return tree.join(fresh, ["level", "idx"], "left").select("level", "idx", F.coalesce("new", "hash").alias("hash"))


def extended(tree: DataFrame, more: DataFrame, count: int, depth: int) -> DataFrame:
    """The tree over ``count`` leaves with the hashes of ``more`` (idx from count on, hash) appended; it grows by levels where they don't fit."""
    spark, grown, added = tree.sparkSession, depth, more.count()
    while (1 << grown) < count + added:
        grown += 1
    fillers = [integrity.NULL_HASH]
    for _ in range(grown):
        fillers.append(integrity.paired(fillers[-1], fillers[-1]))
    if grown > depth:
        top = tree.where((F.col("level") == depth) & (F.col("idx") == 0)).first()["hash"]
        tops = []
        for level in range(depth, grown):  # beside the old tree stands one of fillers
            top = integrity.paired(top, fillers[level])
            tops.append((level + 1, 0, top))
        tree = tree.unionByName(spark.createDataFrame(tops, "level int, idx long, hash string"))
        for level in range(grown):
            first = 1 << max(0, depth - level)
            rest = spark.range(first, 1 << (grown - level)).select(F.lit(level).alias("level"), F.col("id").alias("idx"), F.lit(fillers[level]).alias("hash"))
            tree = tree.unionByName(rest)
    return updated(tree, more, grown)


def grid_hash(shape: tuple[int, ...], chunk: tuple[int, ...], element: int, contiguous: bool = False) -> Column:
    """Hex hash that binds a grid: layout, element size, dimensions and chunk shape."""
    about = struct.pack(">BI", int(contiguous), element) + b"".join(struct.pack(">Q", x) for x in (*shape, *chunk))
    return F.sha2(F.unhex(F.lit(GRID_PREFIX + about.hex())), 256)


@dataclass
class SubsetProof:
    """leaves (idx, hash), siblings (level, idx, hash), and one row that binds the covered indices to the grid."""

    leaves: DataFrame
    siblings: DataFrame
    cover: DataFrame


def cover_hash(leaves: DataFrame, grid: Column) -> DataFrame:
    """cover: one row, the hash of the sorted indices and the grid's hash. A proof is as large as the subset it is taken for."""
    names = leaves.agg(F.array_join(F.transform(F.array_sort(F.collect_set("idx")), lambda i: F.lpad(F.hex(i), 16, "0")), "").alias("names"))
    return names.select(F.sha2(F.unhex(F.concat(F.lit(COVER_PREFIX), "names", grid)), 256).alias("cover"))


def subset_proof(tree: DataFrame, covered: DataFrame, depth: int, grid: Column) -> SubsetProof:
    """The proof for the leaves ``covered`` (idx): siblings are nodes whose parent is above a covered leaf and that are above none themselves."""
    wanted = covered.select(F.col("idx").cast("long").alias("idx")).distinct()
    leaves = tree.where("level = 0").join(wanted, "idx", "left_semi").select("idx", "hash")
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))
    paths = wanted.select("idx", levels.alias("level")).select("level", F.expr("shiftright(idx, level)").alias("idx")).distinct() if depth else wanted.select(F.lit(0).alias("level"), "idx").limit(0)
    beside = paths.select("level", F.col("idx").bitwiseXOR(F.lit(1).cast("long")).alias("idx")).join(paths, ["level", "idx"], "left_anti")
    return SubsetProof(leaves, tree.join(beside, ["level", "idx"], "left_semi").select("level", "idx", "hash"), cover_hash(leaves, grid))


def subset_verified(proof: SubsetProof, expected: str | Column, depth: int, grid: Column, covered: DataFrame | None = None) -> DataFrame:
    """valid: whether the leaves lead to the root, the cover is that of the leaves and the grid, and they are what was asked for."""
    now = proof.leaves.select("idx", "hash")
    for level in range(depth):
        both = now.unionByName(proof.siblings.where(F.col("level") == level).select("idx", "hash"))
        now = both.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(
            F.when(F.count("*") == 2, integrity.pair_hash(F.min_by("hash", "idx"), F.max_by("hash", "idx"))).alias("hash")
        )
    root = now.agg(F.coalesce(F.max("hash") == (F.lit(expected) if isinstance(expected, str) else expected), F.lit(False)).alias("leads"), F.count("*").alias("n"))
    bound = cover_hash(proof.leaves, grid).withColumnRenamed("cover", "own").join(proof.cover, F.lit(True)).select((F.col("own") == F.col("cover")).alias("bound"))
    asked = covered if covered is not None else proof.leaves
    missing = asked.select(F.col("idx").cast("long").alias("idx")).join(proof.leaves, "idx", "left_anti").agg((F.count("*") == 0).alias("whole"))
    return root.join(bound, F.lit(True)).join(missing, F.lit(True)).select((F.col("leads") & (F.col("n") == 1) & F.col("bound") & F.col("whole")).alias("valid"))


# --- root attributes and signatures ------------------------------------------


def packed_root(root: Column, algorithm: str = "sha256", companion: Column | None = None, grid: Column | None = None) -> Column:
    """129 bytes: root, algorithm, hash that binds both, companion hash and grid hash (hex columns; zeros where there is none)."""
    number = F.lit(f"{ALGORITHMS[algorithm]:02X}")
    none = F.lit("00" * 32)
    own = F.sha2(F.unhex(F.concat(F.lit(ROOT_PREFIX), root, number)), 256)
    return F.unhex(F.concat(root, number, own, companion if companion is not None else none, grid if grid is not None else none))


def unpacked_root(packed: Column) -> Column:
    """struct of root, algorithm, companion, grid (hex; null where zeros) and problem: size, algorithm or integrity, null if sound."""
    part = lambda at, n: F.lower(F.hex(F.substring(packed, at + 1, n)))
    root, number, own = part(0, 32), part(32, 1), part(33, 32)
    optional = lambda at: F.nullif(part(at, 32), F.lit("00" * 32))
    name = F.element_at(F.create_map(*(x for a, i in ALGORITHMS.items() for x in (F.lit(f"{i:02x}"), F.lit(a)))), number)
    problem = F.when(F.octet_length(packed) != PACKED_ROOT, "size").when(~number.isin([f"{i:02x}" for i in ALGORITHMS.values()]), "algorithm")
    problem = problem.when(F.sha2(F.unhex(F.concat(F.lit(ROOT_PREFIX), root, number)), 256) != own, "integrity")
    sound = F.octet_length(packed) == PACKED_ROOT
    return F.struct(
        F.when(sound, root).alias("root"), F.when(sound & number.isin([f"{i:02x}" for i in ALGORITHMS.values()]), name).alias("algorithm"),
        F.when(sound, optional(65)).alias("companion"), F.when(sound, optional(97)).alias("grid"), problem.alias("problem"),
    )


def companion_state(packed: Column, nodes: Column) -> Column:
    """valid, missing or different: what the companion hash says of the stored nodes (binary)."""
    there = unpacked_root(packed)["companion"]
    return F.when(there.isNull(), "missing").when(there == F.sha2(nodes, 256), "valid").otherwise("different")


def hmac(key: bytes, data: Column, bits: int = 256) -> Column:
    """The hex keyed hash of binary data by SHA-2, in built-in functions."""
    import hashlib

    size = 64 if bits <= 256 else 128
    key = hashlib.new(f"sha{bits}", key).digest() if len(key) > size else key
    pads = [bytes(b ^ p for b in key.ljust(size, b"\0")) for p in (0x36, 0x5C)]
    inner = F.sha2(F.concat(F.lit(pads[0]), data), bits)
    return F.sha2(F.concat(F.lit(pads[1]), F.unhex(inner)), bits)


def payload(root: Column, companion: Column, version: Column, time: Column, algorithm: str = "sha256") -> Column:
    """The 81 bytes that are signed: root, companion hash, version, time (big-endian) and algorithm."""
    number = lambda c: F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.unhex(F.concat(root, companion, number(version), number(time), F.lit(f"{ALGORITHMS[algorithm]:02X}")))


def signed(data: Column, keys: tuple[bytes, bytes]) -> Column:
    """struct of two keyed hashes over the same bytes, of two families and two keys: a stand-in for a hybrid signature where no signing library is."""
    return F.struct(hmac(keys[0], data, 256).alias("first"), hmac(keys[1], data, 512).alias("second"))


def signature_holds(data: Column, signature: Column, keys: tuple[bytes, bytes]) -> Column:
    """Whether both hold; one alone is not enough."""
    own = signed(data, keys)
    return F.coalesce((own["first"] == signature["first"]) & (own["second"] == signature["second"]), F.lit(False))


def derived_key(master: bytes, purpose: str) -> bytes:
    """A key of its own for each purpose."""
    import hashlib
    import hmac as keyed

    return keyed.new(master, purpose.encode() + b"\x01", hashlib.sha256).digest()


def baselines(rows: DataFrame, data: Column, order: str, key: bytes) -> DataFrame:
    """flat (a hash over the hashes in order), mac (the same, keyed) and chunks (rows whose own keyed hash was made): what trees are compared with.

    Hashes are chained in blocks of order div 4096, blocks then in one row: no task holds more than a block.
    """
    hashed = rows.select(F.col(order).cast("long").alias("at"), F.sha2(data, 256).alias("h"), hmac(key, data).alias("m"))
    block = hashed.groupBy(F.floor(F.col("at") / 4096).alias("block")).agg(
        F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")), 256).alias("h"), F.count("m").alias("n")
    )
    whole = block.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "").alias("all"), F.sum("n").alias("chunks"))
    return whole.select(F.sha2(F.unhex("all"), 256).alias("flat"), hmac(key, F.unhex("all")).alias("mac"), "chunks")


# --- what to do about errors ---------------------------------------------------

# Errors of content, which the policy decides on; policies and what each does.
CONTENT_ERRORS = ("hash_mismatch", "companion_tampered", "signature_invalid")
RESPONSES = {"halt": "halt", "quarantine": "quarantine", "alert": "alert"}


def error_response(error: Column, policy: Column, signed_: Column) -> Column:
    """struct(response, recovery): errors of content follow the policy, and are mended by hashing anew only where nothing is signed; all others halt."""
    content = error.isin(*CONTENT_ERRORS)
    response = F.when(content & policy.isin(*RESPONSES), policy).otherwise("halt")
    return F.struct(response.alias("response"), F.when(content & ~signed_, "rebuild").otherwise("none").alias("recovery"))
