"""Cross-site boilerplate lines, by HyperLogLog sketches of the sites that hold a line.

DataFrame functions only. A line's key is the 128-bit digest of its text without
blanks at its ends; lines of blanks only are never boilerplate. Each key's sites
(``source``) go into a sketch, sketches merge by aggregation (partly before
the shuffle), and the estimate says how far the line is spread. Where the
estimate lies within ``band`` of the threshold, distinct sites are counted exactly. Lines on
``sites`` sites or more are taken out of every document.

Up to FEW boilerplate keys (counted first) go along with the plan as one constant, dealt to buckets, and texts
are cleaned where they are read: none is shuffled. More keys are joined to the lines, then to the documents.

Null text stays null; a null source counts for no site. Repeated rows and rows that
share a doc_id are cleaned alike. An empty table gives an empty result; a document
of boilerplate only becomes an empty text. Other columns may have any names; one that is called as the count is asked to be
gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

SITES = 10
BAND = 0.25
BLANKS = " \t\r"
#: Keys that travel as a constant, about half a megabyte, and the buckets they are looked up in.
FEW, BUCKETS = 16_384, 4096


def _key(line):
    return F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary"))


def _filled(line):
    return F.btrim(line, F.lit(BLANKS)) != ""


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, source and key of every distinct line in a row that isn't blank."""
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), _filled), _key))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.explode(keys).alias("key"))


def boilerplate(docs: DataFrame, sites: int = SITES, band: float = BAND) -> DataFrame:
    """key of each line on ``sites`` or more sources."""
    lines = _lines(docs).select("key", "source")
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg("source", F.lit(12)).alias("sketch"))
    spread = common.written(sketched.select("key", F.hll_sketch_estimate("sketch").alias("spread")).where(F.col("spread") >= sites * (1 - band)), "line-spread")
    sure = spread.where(F.col("spread") > sites * (1 + band)).select("key")
    near = spread.where(F.col("spread") <= sites * (1 + band)).select("key")
    exact = lines.join(near, "key", "left_semi").distinct().groupBy("key").agg(F.count("source").alias("n")).where(F.col("n") >= sites).select("key")
    return sure.union(exact)


def _bucket(key):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def without_boilerplate(docs: DataFrame, sites: int = SITES, band: float = BAND, count: str | None = "n_removed") -> DataFrame:
    """The rows of ``docs`` with boilerplate lines taken out of ``text``; the other columns as they are, and the number of lines taken out last, as ``count``."""
    common.prepare(docs.sparkSession)
    bad = common.written(boilerplate(docs, sites, band), "line-boilerplate")
    lines = F.split("text", "\n", -1)
    rows = docs
    if bad.count() <= FEW:
        named = {r["bucket"]: r["keys"] for r in bad.groupBy(_bucket("key").alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys")).collect()}  # FEW keys
        table = F.split(F.lit(";".join(named.get(b, "") for b in range(BUCKETS))), ";")
        hit = lambda x: F.contains(F.get(table, _bucket(_key(x))), _key(x))
    else:
        held, own = (next(n for n in (f"{word}_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for word in ("bad", "bad_id"))
        hits = _lines(docs).join(bad, "key", "left_semi").groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("key").alias(held))
        rows = docs.join(hits, docs["doc_id"].eqNullSafe(hits[own]), "left")
        hit = lambda x: F.coalesce(F.array_contains(held, _key(x)), F.lit(False))
    clean = F.filter(lines, lambda x: ~(_filled(x) & hit(x)))
    removed = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(clean)).cast("long")
    columns = [F.array_join(clean, "\n").alias(c) if c == "text" else docs[c] for c in docs.columns if c != count]
    return rows.select(*columns, *([removed.alias(count)] if count else []))
