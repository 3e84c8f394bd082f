"""Queries of arrays, integrity, loads and metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import arrays, integrity, migrate
from quarry.operators.arrays import Hyperslab
from quarry.plans.registry import query, rounded
from quarry.sources import tables
from quarry.sources.tables import table

SLAB = Hyperslab((3, 1), (5, 2), (40, 3), (2, 1))


def _cells(spark, d):
    """lineitem as a grid: order number by line number."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i0"), F.col("l_linenumber").cast("long").alias("i1"), F.col("l_quantity").alias("value"))


def _dense(spark, d):
    """embeddings as a matrix of (vector, dimension) cells."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "value")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("value").cast("double").alias("value"))


_SLAB_SQL = "i0 >= 3 AND i0 < 200 AND (i0 - 3) % 5 < 2 AND i1 >= 1 AND i1 < 6 AND (i1 - 1) % 2 < 1"
_DENSE = "cells AS (SELECT vec_id AS i0, generate_subscripts(embedding, 1) - 1 AS i1, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


@query(f"SELECT i0, i1, round(value, 6) AS value FROM (SELECT l_orderkey AS i0, CAST(l_linenumber AS BIGINT) AS i1, l_quantity AS value FROM lineitem) WHERE {_SLAB_SQL}")
def hyperslab_select(spark, d):
    return rounded(_cells(spark, d).where(SLAB.contains(F.col("i0"), F.col("i1"))), "value")


@query(f"WITH {_DENSE}, s AS (SELECT *, i0 * 64 + i1 AS place FROM cells WHERE i0 >= 10 AND i0 < 20 AND i1 >= 8 AND i1 < 16) SELECT place, round(value, 6) AS value FROM s")
def slice_select(spark, d):
    inside = Hyperslab.ranges((10, 20), (8, 16)).contains(F.col("i0"), F.col("i1"))
    return rounded(_dense(spark, d).where(inside).select(arrays.row_major((0, 64), F.col("i0"), F.col("i1")).alias("place"), "value"), "value")


@query(f"WITH {_DENSE} SELECT i0 // 16 AS chunk_i0, i1 // 16 AS chunk_i1, count(*) AS n, round(sum(value), 5) AS total FROM cells GROUP BY ALL")
def chunk_split(spark, d):
    chunks = arrays.chunked(_dense(spark, d), ["i0", "i1"], (16, 16), "value")
    return rounded(chunks.select("chunk_i0", "chunk_i1", "n", F.aggregate("payload", F.lit(0.0), lambda s, x: s + x).alias("total")), "total", places=5)


@query(f"WITH {_DENSE} SELECT DISTINCT i0 // 16 AS chunk_i0, i1 // 16 AS chunk_i1 FROM cells WHERE (i0 // 16) * 16 < 66 AND (i0 // 16 + 1) * 16 > 20 AND (i1 // 16) * 16 < 40 AND (i1 // 16 + 1) * 16 > 5")
def chunk_prune(spark, d):
    slab = Hyperslab((20, 5), (10, 35), (5, 1), (6, 35))
    chunks = _dense(spark, d).select(F.floor(F.col("i0") / 16).alias("chunk_i0"), F.floor(F.col("i1") / 16).alias("chunk_i1")).distinct()
    return chunks.where(slab.touches((16, 16), F.col("chunk_i0"), F.col("chunk_i1")))


@query(f"WITH {_DENSE} SELECT i0, i1, round(value, 6) AS value FROM cells WHERE (i0, i1) IN ((0, 0), (7, 63), (100, 5), (9999999, 1))")
def point_select(spark, d):
    return rounded(arrays.points(_dense(spark, d), [(0, 0), (7, 63), (100, 5), (9_999_999, 1)], ["i0", "i1"]), "value")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity = 1 THEN -1 ELSE l_quantity * 0.5 + 10 END, 6) AS value, l_quantity = 1 AS missing FROM lineitem")
def scale_offset_unpack(spark, d):
    q = F.col("l_quantity")
    value = arrays.unpacked(q, 0.5, 10.0, fill=1.0)
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.isnan(value), -1.0).otherwise(value).alias("value"), arrays.is_missing(q, fill=1.0).alias("missing"))
    return rounded(out, "value")


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS name FROM nation")
def enum_decode(spark, d):
    return table(spark, d, "nation").select("n_nationkey", arrays.decoded_enum(F.col("n_regionkey"), {0: "zero", 1: "one", 2: "two"}).alias("name"))


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_totalprice > 300000")
def compound_project(spark, d):
    packed = table(spark, d, "orders").select(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").alias("r"))
    return rounded(packed.where("r.o_totalprice > 300000").select("r.o_orderkey", "r.o_orderstatus", "r.o_totalprice"), "o_totalprice", places=2)


_DICT = "d AS (SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY o_orderpriority)"


@query(f"WITH {_DICT} SELECT o_orderkey, code FROM orders JOIN d ON o_orderpriority = value")
def dict_encode(spark, d):
    return arrays.dictionary_encoded(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", "code")


@query("SELECT o_orderkey, o_orderpriority AS value FROM orders")
def dict_decode(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return arrays.dictionary_encoded(orders, "o_orderpriority", "o_orderkey").join(arrays.dictionary(orders, "o_orderpriority", "o_orderkey"), "code").select("o_orderkey", "value")


@query("SELECT count(*) AS n, count(DISTINCT o_orderpriority) AS distinct_values, count(*) >= 4 AND count(DISTINCT o_orderpriority) < 0.75 * count(*) AS pays FROM orders")
def dict_beneficial(spark, d):
    return arrays.dictionary_pays(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT n_nationkey, " + " + ".join(f"(((n_nationkey >> {k}) & 1) << {2 * k}) + (((n_regionkey >> {k}) & 1) << {2 * k + 1})" for k in range(8)) + " AS z FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation)")
def morton_index(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("long").alias("n_regionkey"))
    return n.select("n_nationkey", arrays.morton(8, F.col("n_nationkey"), F.col("n_regionkey")).alias("z"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS place FROM lineitem")
def row_major_index(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", arrays.row_major((0, 8), F.col("l_orderkey"), F.col("l_linenumber")).alias("place"))


@query(f"WITH {_DENSE} SELECT i0, i1, round(CASE WHEN i1 = 3 AND i0 % 10 = 0 THEN 9.5 ELSE value END, 6) AS value FROM cells")
def hyperslab_update(spark, d):
    cells = _dense(spark, d)
    new = cells.where("i1 = 3 and i0 % 10 = 0").select("i0", "i1", F.lit(9.5).alias("value"))
    return rounded(arrays.updated(cells, new, ["i0", "i1"]).select("i0", "i1", "value"), "value")


@query("SELECT l_orderkey % 7 AS lane, count(*) AS n FROM lineitem GROUP BY lane")
def lane_balance(spark, d):
    return arrays.lanes(table(spark, d, "lineitem"), "l_orderkey", 7)


@query("SELECT l_orderkey, l_linenumber, (l_orderkey * 10 // 64) % 4 AS file, (l_orderkey * 10 // 64) // 4 * 64 + (l_orderkey * 10) % 64 AS place FROM lineitem")
def subfile_map(spark, d):
    file, place = arrays.striped(F.col("l_orderkey") * 10, 64, 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", file.cast("long").alias("file"), place.cast("long").alias("place"))


@query("SELECT doc_id AS i, 0 AS part FROM documents UNION ALL SELECT vec_id + 1000000, 1 FROM embeddings")
def virtual_dataset(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("i"), F.lit(0).alias("part"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.lit(1).alias("part"))
    return tables.virtual([(docs, 0), (vectors, 1_000_000)], "i")


@query("WITH v(name, axis, size) AS (VALUES ('t', 0, 10), ('t', 1, 4), ('t', 2, 4), ('p', 0, 4), ('q', 0, 7)), dims(dim, size, place) AS (VALUES ('time', 10, 0), ('lat', 4, 1), ('lon', 4, 2)), a AS (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY axis) AS n FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY place) AS n FROM dims) SELECT name, axis, coalesce(dim, 'dim_' || a.size) AS dim FROM a LEFT JOIN b ON a.size = b.size AND a.n = b.n")
def dimension_match(spark, d):
    v = spark.createDataFrame([("t", 0, 10), ("t", 1, 4), ("t", 2, 4), ("p", 0, 4), ("q", 0, 7)], "name string, axis int, size int")
    dims = spark.createDataFrame([("time", 10, 0), ("lat", 4, 1), ("lon", 4, 2)], "dim string, size int, place int")
    return arrays.dimension_names(v, dims)


@query(f"WITH {_DENSE}, s AS (SELECT i0 // 16 AS chunk_i0, i1 // 16 AS chunk_i1, i0 % 16 AS a, i1 % 16 AS b FROM cells WHERE i0 >= 20 AND (i0 - 20) % 10 < 6 AND i0 < 20 + 3 * 10 + 6 AND i1 >= 5 AND i1 < 40) SELECT chunk_i0, chunk_i1, min(a) AS from_i0, max(a) + 1 AS to_i0, min(b) AS from_i1, max(b) + 1 AS to_i1 FROM s GROUP BY chunk_i0, chunk_i1")
def chunk_local_ranges(spark, d):
    """The part of each chunk that a selection covers, by arithmetic alone."""
    slab = Hyperslab((20, 5), (10, 35), (4, 1), (6, 35))
    chunks = _dense(spark, d).select(F.floor(F.col("i0") / 16).alias("chunk_i0"), F.floor(F.col("i1") / 16).alias("chunk_i1")).distinct()
    (a, b), (c, e) = arrays.local_ranges(slab, (16, 16), F.col("chunk_i0"), F.col("chunk_i1"))
    found = chunks.where(slab.touches((16, 16), F.col("chunk_i0"), F.col("chunk_i1"))).select("chunk_i0", "chunk_i1", a.alias("from_i0"), b.alias("to_i0"), c.alias("from_i1"), e.alias("to_i1"))
    return found.where("from_i0 < to_i0 and from_i1 < to_i1")


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT n, CAST(ceil(n / ceil(n * 256 / 4096.0)) AS BIGINT) AS tile FROM n), l AS (SELECT n, tile, unnest(range(0, CAST(ceil(n / tile) AS BIGINT))) AS leaf FROM g)
        SELECT leaf, leaf * tile * 256 AS start, least(tile, n - leaf * tile) * 256 AS size FROM l""")
def verification_leaves(spark, d):
    """Byte ranges of the leaves of a contiguous array: the vectors, four bytes a component."""
    shape = (table(spark, d, "embeddings").count(), 64)
    grid = arrays.verification_grid(shape, 4, 4096)
    start, size = arrays.leaf_bytes(F.col("id"), shape, grid, 4)
    return spark.range(-(-shape[0] // grid[0])).select(F.col("id").alias("leaf"), start.alias("start"), size.alias("size"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]
_KINDS = "CASE WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'FLOAT[]' THEN 'array<float>' WHEN data_type = 'DOUBLE[]' THEN 'array<double>' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE lower(data_type) END"


@query(f"SELECT table_name AS dataset, column_name AS \"column\", {_KINDS} AS type FROM information_schema.columns WHERE table_name IN {tuple(_TABLES)}")
def table_metadata(spark, d):
    return tables.metadata(spark, d, _TABLES).withColumn("type", F.replace("type", F.lit("timestamp_ntz"), F.lit("timestamp")))


# --- integrity -------------------------------------------------------------


def _leaf_sql(n: int) -> str:
    out = f"l0 AS (SELECT n_nationkey AS idx, sha256('\\x00'::BLOB || encode(n_name)) AS hash FROM nation UNION ALL SELECT i, '{integrity.NULL_HASH}' FROM range(25, {n}) r(i))"
    k, size = 0, n
    while size > 1:
        size //= 2
        out += f", l{k + 1} AS (SELECT idx // 2 AS idx, sha256('\\x01'::BLOB || unhex(arg_min(hash, idx)) || unhex(arg_max(hash, idx))) AS hash FROM l{k} GROUP BY idx // 2)"
        k += 1
    return out


def _leaves(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), integrity.leaf_hash(F.col("n_name")).alias("hash"))


@query(f"WITH {_leaf_sql(32)} SELECT hash FROM l5")
def merkle_root(spark, d):
    return integrity.root(_leaves(spark, d), 25)


@query(f"WITH {_leaf_sql(32)} SELECT CAST(level AS BIGINT) AS level, CAST(idx AS BIGINT) AS idx, hash FROM (" + " UNION ALL ".join(f"SELECT {k} AS level, idx, hash FROM l{k} WHERE idx = {(11 >> k) ^ 1}" for k in range(5)) + ")")
def merkle_proof(spark, d):
    return integrity.proof(integrity.levels(_leaves(spark, d), 25), 11, 5).select(F.col("level").cast("long").alias("level"), "idx", "hash")


@query("SELECT TRUE AS valid, FALSE AS tampered")
def merkle_proof_verify(spark, d):
    tree = integrity.levels(_leaves(spark, d), 25)
    rows = {(r["level"], r["idx"]): r["hash"] for r in tree.where("level = 5 or (level = 0 and idx = 11)").collect()}
    path = [r["hash"] for r in integrity.proof(tree, 11, 5).orderBy("level").collect()]
    good = integrity.verified(rows[0, 11], 11, path, rows[5, 0])
    bad = integrity.verified(integrity.NULL_HASH, 11, path, rows[5, 0])
    return spark.createDataFrame([(good, bad)], "valid boolean, tampered boolean")


_VERSIONS = "v AS (SELECT user_id AS chunk, event_id AS seq, (event_id * 7) % 1000 AS version FROM events)"


def _versions(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("chunk"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 1000).alias("version"))


@query(f"WITH {_VERSIONS}, s AS (SELECT *, max(version) OVER (PARTITION BY chunk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v) SELECT chunk, seq, version FROM s WHERE version < seen")
def version_rollback(spark, d):
    return integrity.rollbacks(_versions(spark, d)).select("chunk", "seq", "version")


@query(f"WITH {_VERSIONS} SELECT chunk AS dataset, max(version) AS version, arg_max(seq, version) AS root FROM (SELECT chunk, version, max(seq) AS seq FROM v GROUP BY ALL) GROUP BY chunk")
def journal_latest(spark, d):
    one = _versions(spark, d).groupBy("chunk", "version").agg(F.max("seq").alias("root"))
    return integrity.journal_latest(one.withColumnRenamed("chunk", "dataset"))


@query(f"WITH {_VERSIONS}, s AS (SELECT *, lag(version) OVER (PARTITION BY chunk ORDER BY seq) AS p FROM v) SELECT chunk AS dataset, bool_and(p IS NULL OR version > p) AS valid FROM s GROUP BY chunk")
def journal_valid(spark, d):
    return integrity.journal_valid(_versions(spark, d).withColumnRenamed("chunk", "dataset"))


@query(f"WITH {_VERSIONS} SELECT DISTINCT chunk, version FROM v WHERE version % 3 <> 0")
def pending_writes(spark, d):
    v = _versions(spark, d).select("chunk", "version").distinct()
    return integrity.pending(v, v.where("version % 3 = 0"))


@query("SELECT doc_id AS id, doc_id % 8 <> 0 AND doc_id % 9 <> 0 AS ok FROM documents")
def content_intact(spark, d):
    i = F.col("doc_id")
    stored = F.when(i % 9 == 0, None).when(i % 8 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return integrity.intact(table(spark, d, "documents").select(i.alias("id"), "text", stored.alias("stored")))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


# --- loads -----------------------------------------------------------------


def _target(spark, d):
    return table(spark, d, "orders").where("o_orderkey < 10000").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 10000)")
def migrate_incremental(spark, d):
    source = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    return rounded(migrate.new_rows(source, _target(spark, d)), "o_totalprice", places=2)


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 13 = 0 THEN 'different' ELSE 'same' END AS problem FROM orders UNION ALL SELECT 'extra' FROM range(3)) GROUP BY problem""")
def migrate_validate(spark, d):
    source = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    changed = source.where("id % 11 <> 0").withColumn("o_totalprice", F.when(F.col("id") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 1e-6))
    extra = spark.range(3).select((-1 - F.col("id")).alias("id"), F.lit(0.0).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))
    return migrate.mismatches(source, changed.unionByName(extra), "id", ["o_orderstatus"], ["o_totalprice"])


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_attributes(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag) + 0 AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return rounded(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.grouping("l_returnflag").cast("long").alias("g")), "quantity", places=2)


@query("WITH d AS (SELECT l_orderkey, l_linenumber, lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS p FROM lineitem) SELECT CASE WHEN p IS NULL THEN 'start' WHEN l_orderkey - p <= 1 THEN 'forward' ELSE 'jump' END AS kind, count(*) AS n FROM d GROUP BY kind")
def sweep_direction(spark, d):
    """How often an access log goes on with the next key."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    rows = rows.withColumn("p", F.lag("l_orderkey").over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")))
    kind = F.when(F.col("p").isNull(), "start").when(F.col("l_orderkey") - F.col("p") <= 1, "forward").otherwise("jump")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT to_json({doc_id: doc_id, source: source}) AS line FROM documents WHERE doc_id % 10 <> 0")
def export_json(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 10 == 0).alias("deleted"))
    return tables.json_lines(rows)


