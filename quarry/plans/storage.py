"""Queries of what is written and read again, of streams, and of the engine's own surface."""

from __future__ import annotations

import os
import sqlite3
import uuid

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import functions as F

from quarry.functions import coding
from quarry.operators import arrays, lifecycle, markdown, migrate, store, temporal
from quarry.plans.arrays import _DENSE, _dense
from quarry.plans.memory import EV, _events
from quarry.plans.registry import query, rounded
from quarry.plans.retrieval import _NORMAL, GATE
from quarry.sources import arrayfile, tables
from quarry.sources.shared import shared_dir
from quarry.sources.tables import table
from quarry.streaming import streams


def _fresh(spark, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _local(spark, name: str) -> str:
    """A path that plain files can be written to; the shared folder must be mounted."""
    path = _fresh(spark, name)
    if not path.startswith(("file:", "/")):
        raise ValueError("plain files need a mounted shared folder")
    path = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


_CODECS = ["none", "snappy", "gzip", "zstd", "lz4"]


@query("SELECT codec, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS digest FROM documents, (SELECT unnest(" + str(_CODECS) + ") AS codec) GROUP BY codec")
def codec_round_trip(spark, d):
    """Documents written with each codec are read back byte for byte."""
    out = None
    docs = table(spark, d, "documents").select("doc_id", "text")
    for codec in _CODECS:
        path = _fresh(spark, f"codec-{codec}")
        docs.write.option("compression", codec).parquet(path)
        # A digest of each row; of the rows in order one digest more, as the table is small beside its texts.
        back = spark.read.parquet(path).select("doc_id", F.octet_length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("h"))
        row = back.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"]), "").cast("binary")).alias("digest"))
        row = row.select(F.lit(codec).alias("codec"), "n", "bytes", "digest")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {_DENSE} SELECT i0, i1, round(value, 6) AS value FROM cells")
def chunk_assemble(spark, d):
    """Cells cut into chunks, stored, and put together again."""
    path = _fresh(spark, "chunks")
    arrays.chunked(_dense(spark, d), ["i0", "i1"], (16, 16), "value").write.parquet(path)
    cells = spark.read.parquet(path).select("chunk_i0", "chunk_i1", F.posexplode("payload").alias("place", "value"))
    return rounded(cells.select((F.col("chunk_i0") * 16 + F.floor(F.col("place") / 16)).alias("i0"), (F.col("chunk_i1") * 16 + F.col("place") % 16).alias("i1"), "value"), "value")


@query(f"WITH {_DENSE} SELECT i0, i1, round(value, 6) AS value FROM cells WHERE i0 < 12")
def chunk_assemble_shuffled(spark, d):
    """Numbers as bytes, shuffled, deflated by the writer, read back, unshuffled and decoded."""
    path = _fresh(spark, "filtered")
    raw = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.round(x * 1_000_000).cast("long")), 16, "0")), ""))
    rows = table(spark, d, "embeddings").where("vec_id < 12").select("vec_id", raw.alias("raw"))
    rows.select("vec_id", coding.byte_shuffled(F.col("raw"), 8).alias("raw")).write.option("compression", "gzip").parquet(path)
    back = spark.read.parquet(path).select(F.col("vec_id").alias("i0"), F.posexplode(coding.numbers(coding.byte_shuffled(F.col("raw"), 8, True), "i8", True)).alias("i1", "n"))
    return rounded(back.select("i0", F.col("i1").cast("long").alias("i1"), (F.col("n") / 1_000_000).alias("value")), "value")


@query(f"WITH {_DENSE} SELECT i0 // 16 AS chunk, count(*) AS reads, count(*) AS again FROM cells GROUP BY chunk")
def cached_chunks(spark, d):
    """Chunks that are kept after the first read give the same cells again."""
    chunks = arrays.chunked(_dense(spark, d), ["i0", "i1"], (16, 64), "value").persist(StorageLevel.MEMORY_AND_DISK)
    one = chunks.select(F.col("chunk_i0").alias("chunk"), F.size("payload").cast("long").alias("reads"))
    two = chunks.select(F.col("chunk_i0").alias("chunk"), F.col("n").alias("again"))
    return one.join(two, "chunk")


@query(f"WITH {_DENSE} SELECT i0, i1, round(value, 6) AS value FROM cells WHERE i0 >= 5 AND i0 < 9")
def array_file_scan(spark, d):
    """A run of rows out of an array file: only its chunks are read."""
    import numpy as np

    arrayfile.register(spark)
    path = _local(spark, "array")
    first = table(spark, d, "embeddings").where("vec_id < 16").orderBy("vec_id").select("embedding").collect()  # 16 rows
    with open(path, "wb") as f:
        np.save(f, np.array([r[0] for r in first], "<f4"))
    rows = spark.read.format("arrayfile").option("chunk", "4").option("from", "5").option("to", "9").load(path)
    return rounded(rows.select("i0", "i1", "value"), "value")


def _sqlite(spark, d) -> str:
    path = _local(spark, "store.db")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE chunks (id INTEGER PRIMARY KEY, chunk TEXT, region INTEGER, deleted INTEGER)")
        db.executemany("INSERT INTO chunks VALUES (?, ?, ?, ?)", [(r[0], r[1], r[2], r[0] % 5 == 0) for r in rows])
    return path


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS chunk, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_nationkey % 5 <> 0")
def sqlite_scan(spark, d):
    """A table of an SQLite file, by ranges of its key, with the filter in the SELECT."""
    return tables.read_sqlite(spark, _sqlite(spark, d), "chunks", "id long, chunk string, region long", ["id", "chunk", "region"], "deleted = 0", key="id")


@query("SELECT 'same' AS problem, count(*) AS n FROM nation WHERE n_nationkey % 5 <> 0")
def sqlite_migrate(spark, d):
    """Rows of an SQLite file loaded onto those that are there, and validated against the source."""
    source = tables.read_sqlite(spark, _sqlite(spark, d), "chunks", "id long, chunk string, region long", ["id", "chunk", "region"], "deleted = 0", key="id")
    path = _fresh(spark, "migrated")
    source.where("id < 12").write.parquet(path)
    migrate.new_rows(source, spark.read.parquet(path)).write.mode("append").parquet(path)
    return migrate.mismatches(source, spark.read.parquet(path), "id", ["chunk", "region"], [])


_SECOND = "SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END AS name FROM customer WHERE c_custkey % 7 <> 0"


@query(f"SELECT 2 AS version, * FROM ({_SECOND}) UNION ALL SELECT 1, c_custkey, c_name FROM customer")
def snapshot_restore(spark, d):
    """Two versions of a table in one folder, each read back; without a version the latest is."""
    folder = _fresh(spark, "snapshots")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    tables.snapshot(rows, folder, 1)
    tables.snapshot(rows.where("id % 7 <> 0").withColumn("name", F.concat("name", F.when(F.col("id") % 3 == 0, "!").otherwise(""))), folder, 2)
    return tables.restored(spark, folder).withColumn("version", F.lit(2)).unionByName(tables.restored(spark, folder, 1).withColumn("version", F.lit(1)))


@query("SELECT event_id AS id, round(CASE WHEN event_id % 4 = 0 THEN value * 2 ELSE value END, 6) AS value FROM events WHERE event_id % 6 <> 5")
def snapshot_journal_restore(spark, d):
    """A snapshot and the log after it, both read from their folders."""
    folder, log = _fresh(spark, "snapshots"), _fresh(spark, "log")
    rows, i = _events(spark, d).select("id", "value"), F.col("id")
    tables.snapshot(rows, folder, 1)
    rows.where(i % 4 == 0).select(i.alias("seq"), F.lit("save").alias("op"), "id", (F.col("value") * 2).alias("value")).write.parquet(log)
    rows.where(i % 6 == 5).select((i + 10_000_000).alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("double").alias("value")).write.mode("append").parquet(log)
    return rounded(tables.replayed(tables.restored(spark, folder), spark.read.parquet(log)), "value")


@query("SELECT l_returnflag, count(*) AS n, FALSE AS changed FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_returnflag")
def partitioned_write(spark, d):
    """A table written by a column's values; a filter on it reads those partitions only."""
    path = _fresh(spark, "parts")
    rows = table(spark, d, "lineitem")
    rows.repartition("l_returnflag").write.partitionBy("l_returnflag").parquet(path)
    back = spark.read.parquet(path).where("l_returnflag <> 'A'")
    same = set(back.columns) == set(rows.columns)
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("changed", F.lit(not same))


@query("SELECT doc_id AS id, '# ' || source || chr(10) || lang || chr(10) || '## text' || chr(10) || doc_id AS text FROM documents")
def markdown_export(spark, d):
    """Sections as one Markdown text for each document."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    head = docs.select(i.alias("id"), F.lit(0).alias("first_line"), F.col("source").alias("heading"), F.lit(1).alias("level"), F.col("lang").alias("body"))
    tail = docs.select(i.alias("id"), F.lit(2).alias("first_line"), F.lit("text").alias("heading"), F.lit(2).alias("level"), i.cast("string").alias("body"))
    return markdown.exported(head.unionByName(tail))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS size, TRUE AS same FROM embeddings")
def float_blobs(spark, d):
    """Vectors as little-endian bytes of four, read back."""

    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.astype("<f4").tobytes())

    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("e")).withColumn("raw", packed("e"))
    back = rows.withColumn("back", migrate.floats("raw", 4096))
    return back.select("vec_id", F.size("back").alias("size"), (F.col("back") == F.col("e")).alias("same"))


@query(f"WITH {_DENSE}, s AS (SELECT DISTINCT i0, i1 FROM cells WHERE (i0 - 2) % 8 < 3 AND i0 >= 2 AND i0 < 2 + 4 * 8 + 3 AND i1 >= 1 AND i1 < 5) SELECT count(*) AS n, count(DISTINCT i0) AS high, count(DISTINCT i1) AS wide, CAST(2 AS INT) AS rank FROM s")
def selection_shape(spark, d):
    """Elements, shape and rank of a selection, as its algebra tells them."""
    slab = arrays.Hyperslab((2, 1), (8, 1), (5, 4), (3, 1))
    high, wide = slab.shape()
    return spark.createDataFrame([(slab.size(), high, wide, len(slab.shape()))], "n long, high long, wide long, rank int")


# --- streams -------------------------------------------------------------------


def _drained(frame, mode: str):
    """What a stream over all files that are there puts out."""
    spark, name = frame.sparkSession, f"stream_{uuid.uuid4().hex}"
    if mode == "complete":
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode)
        out = lambda: spark.table(name)
    else:
        path = _fresh(spark, "stream")
        q = frame.writeStream.format("parquet").option("path", path).outputMode(mode)
        out = lambda: spark.read.schema(frame.schema).parquet(path)
    q.option("checkpointLocation", _fresh(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return out()


def _event_stream(spark, d):
    path = _fresh(spark, "events")
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts::TIMESTAMP)) // 1000000 AS start, count(*) AS n FROM events GROUP BY start HAVING count(*) > 2")
def stream_rates(spark, d):
    """Windows of a stream with more than two events."""
    found = _drained(streams.rate_windows(_event_stream(spark, d), 2, "6 hours", "6 hours"), "complete")
    return found.select(F.unix_seconds("window.start").alias("start"), "n")


@query(f"WITH {EV}, s AS (SELECT user_id, ts, floor(ts) AS t FROM ev) SELECT a.user_id AS key, round(a.ts, 3) AS ts, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - 86400 AND a.ts GROUP BY a.user_id, a.ts")
def stream_exact_rates(spark, d):
    """Of each event of a stream how many of its user lie in the day up to it."""
    rows = _events(spark, d).select(F.col("user_id").alias("key"), "ts")
    path = _fresh(spark, "rates")
    rows.coalesce(1).write.parquet(path)
    found = _drained(streams.exact_rates(spark.readStream.schema(rows.schema).parquet(path), 86_400), "append")
    return rounded(found, "ts", places=3)


@query(f"WITH t AS (SELECT conv_id, turn, text, {_NORMAL} AS plain FROM conversations) SELECT conv_id, turn FROM t WHERE ({GATE}) IS NULL")
def stream_ingest(spark, d):
    """Turns that a stream appends to a table after the gate."""
    out, path = _fresh(spark, "memory"), _fresh(spark, "turns")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    rows.write.parquet(path)
    streams.ingest(spark.readStream.schema(rows.schema).parquet(path), out, _fresh(spark, "stream-state")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("conv_id", "turn")


# --- the engine's own surface ------------------------------------------------


@query("SELECT r_name, count(*) AS nations, CAST(sum(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) > 1")
def sql_front_end(spark, d):
    """SQL text over registered views."""
    for name in ("nation", "region"):
        table(spark, d, name).createOrReplaceTempView(f"quarry_{name}")
    return spark.sql("SELECT r_name, count(*) AS nations, sum(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END) AS even FROM quarry_nation JOIN quarry_region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) > 1")


@query("SELECT event_id, round(sqrt(value), 6) AS root, round(ln(value + 1), 6) AS log, round(pow(value, 0.5) * pi(), 6) AS power, round(abs(sin(value)), 6) AS sine, CAST(floor(value) AS BIGINT) AS low, CAST(ceil(value) AS BIGINT) AS high FROM events")
def math_functions(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select("event_id", F.sqrt(v).alias("root"), F.log(v + 1).alias("log"), (F.pow(v, F.lit(0.5)) * F.pi()).alias("power"), F.abs(F.sin(v)).alias("sine"), F.floor(v).alias("low"), F.ceil(v).alias("high"))
    return rounded(e, "root", "log", "power", "sine")


@query("SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(quarter(ts) AS INT) AS q, CAST(dayofyear(ts) AS INT) AS day, strftime(ts, '%Y-%m') AS month, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS since FROM events")
def date_functions(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.year(ts).alias("y"), F.quarter(ts).alias("q"), F.dayofyear(ts).alias("day"), F.date_format(ts, "yyyy-MM").alias("month"), F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).alias("since"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def user_functions(spark, d):
    """A vectorised function, and a table function, of one's own."""

    @F.pandas_udf("long")
    def characters(s: pd.Series) -> pd.Series:
        return s.str.len()

    def counted(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": [sum(1 for w in t.split(" ") if w) for t in pdf["text"]]})

    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", characters("text").alias("n")).join(docs.mapInPandas(counted, "doc_id long, words long"), "doc_id")


@query("SELECT n_regionkey, n_name, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS running, n_nationkey - lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS step FROM nation WHERE n_nationkey > 4 QUALIFY step IS NOT NULL")
def running_sums(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = table(spark, d, "nation").where("n_nationkey > 4")
    return rows.select("n_regionkey", "n_name", F.sum("n_nationkey").over(by).alias("running"), (F.col("n_nationkey") - F.lag("n_nationkey").over(by)).alias("step")).where("step is not null")


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM documents")
def store_read_back(spark, d):
    """Rows of a store written, numbered and read again in order of their numbers."""
    path = _fresh(spark, "store")
    lifecycle.numbered(table(spark, d, "documents").select(F.col("doc_id").alias("id")), ["id"]).write.parquet(path)
    return spark.read.parquet(path)


# --- tables that are changed ----------------------------------------------------


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 4 = 0 THEN n_name || ' renamed' ELSE n_name END AS name, CAST(count(r) AS BIGINT) AS relations, max(a) AS alias
        FROM nation LEFT JOIN (SELECT n_nationkey AS k, 1 AS r FROM nation WHERE n_regionkey <> 1) ON k = n_nationkey LEFT JOIN (SELECT n_nationkey AS q, 'the ' || n_name AS a FROM nation WHERE n_nationkey % 2 = 1) ON q = n_nationkey
        WHERE n_nationkey <> 7 GROUP BY n_nationkey, n_name""")
def graph_store(spark, d):
    """Entities, relations and aliases added, changed and taken away, then read."""
    graph = store.graph_tables(spark, _fresh(spark, "graph"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"), F.col("n_regionkey").cast("long").alias("tgt"))
    graph["entities"].save(n)
    graph["relations"].save(n.select(F.col("id").alias("src"), "tgt", F.lit("in").alias("relation"), F.lit(0.9).alias("weight")))
    graph["aliases"].save(n.select(F.concat(F.lit("the "), "name").alias("alias"), "id"))
    graph["entities"].save(n.where("id % 4 = 0").withColumn("name", F.concat("name", F.lit(" renamed"))))
    graph["entities"].remove(n.where("id = 7"))
    graph["relations"].remove(n.where("tgt = 1").select(F.col("id").alias("src"), "tgt", F.lit("in").alias("relation")))
    graph["aliases"].remove(n.where("id % 2 = 0").select(F.concat(F.lit("the "), "name").alias("alias")))
    for changed in graph.values():
        changed.compact()
    per = graph["relations"].rows().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("relations"))
    out = graph["entities"].rows().join(per, "id", "left").join(graph["aliases"].rows(), "id", "left")
    return out.select("id", "name", F.coalesce("relations", F.lit(0)).cast("long").alias("relations"), "alias")


@query(f"WITH {EV} SELECT id, round(ts, 3) AS ts FROM (SELECT id, CASE WHEN id % 10 = 3 THEN ts + 3600 ELSE ts END AS ts FROM ev WHERE id % 6 <> 0) WHERE ts >= 1704412800 ORDER BY ts, id LIMIT 50")
def temporal_insert_remove(spark, d):
    """A time index to which records are added, of which some are removed and some moved; its first rows after a time."""
    index = store.ChangeTable(spark, _fresh(spark, "times"), "id long, ts double", ("id",))
    rows = _events(spark, d).select("id", "ts")
    index.save(rows.where("id % 2 = 0"))
    index.save(rows.where("id % 2 = 1"))
    index.remove(rows.where("id % 6 = 0"))
    index.save(rows.where("id % 10 = 3").withColumn("ts", F.col("ts") + 3600))
    return rounded(temporal.earliest(index.rows().where("ts >= 1704412800"), 50), "ts", places=3)


@query(f"WITH {EV}, h AS (SELECT user_id AS id, count(*) AS n, max(ts) AS latest FROM ev GROUP BY user_id) SELECT c_custkey AS id, CAST(1 + coalesce(n, 0) AS BIGINT) AS access, round(coalesce(latest, 0), 3) AS last_ts FROM customer LEFT JOIN h ON h.id = c_custkey")
def memory_access(spark, d):
    """Records whose accesses are counted from a log."""
    memories = store.ChangeTable(spark, _fresh(spark, "memories"), "id long, access long, last_ts double", ("id",))
    memories.save(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("access"), F.lit(0.0).alias("last_ts")))
    store.accessed(memories, _events(spark, d).select(F.col("user_id").alias("id"), "ts"))
    return rounded(memories.rows(), "last_ts", places=3)


@query("SELECT conv_id AS session_id, count(*) AS records, max(turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_records(spark, d):
    """Records added by session, batch after batch, and what each session holds."""
    kept = store.ChangeTable(spark, _fresh(spark, "sessions"), "session_id long, turn long, text string", ("session_id", "turn"))
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", "text")
    for part in range(2):
        kept.save(rows.where(F.col("turn") % 4 < 2 if part == 0 else F.col("turn") % 4 >= 2))
    kept.save(rows.where("turn = 0"))
    return kept.rows().groupBy("session_id").agg(F.count("*").alias("records"), F.max("turn").alias("last_turn"))
