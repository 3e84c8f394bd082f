"""Memory records: paths, several embeddings for a record, tiers searched together, profiles, chains of hashes."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import vector as V
from quarry.operators.guards import fnv1a64


def under_path(channel: Column, path: str) -> Column:
    """The path itself or one below it."""
    return (channel == path) | F.startswith(channel, F.lit(path + "::"))


def line_slice(rows: DataFrame, start: int, count: int) -> DataFrame:
    """path, text: ``count`` lines from line ``start`` (from 0) of each path's chunks, joined in order of id.

    Chunks of a path are read as a sorted stream: no more than the slice is held.
    """
    dealt = rows.select("path", "id", "text").repartition("path").sortWithinPartitions("path", "id")

    def task(batches):
        path, seen, held, begun = None, 0, [], False
        out: tuple[list, list] = ([], [])

        def close():
            out[0].append(path)
            out[1].append("\n".join(held))

        for batch in batches:
            for p, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or p != path:
                    if begun:
                        close()
                    path, seen, held, begun = p, 0, [], True
                if text is not None and seen < start + count:
                    lines = text.split("\n")
                    held += lines[max(0, start - seen) : start + count - seen]
                    seen += len(lines)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.string())], names=["path", "text"])
            out = ([], [])
        if begun:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.string())], names=["path", "text"])

    return dealt.mapInArrow(task, f"path {rows.schema['path'].dataType.simpleString()}, text string")


def modality_scores(records: DataFrame, query: list[float], modality: str | None = None) -> DataFrame:
    """id, score: each record's best cosine over its embeddings (array of modality, embedding), of one modality or of all; what isn't finite goes."""
    q = F.array(*(F.lit(float(x)) for x in query))
    fits = F.filter("embeddings", lambda e: F.lit(True) if modality is None else e["modality"] == modality)
    best = F.array_max(F.filter(F.transform(fits, lambda e: V.cosine(e["embedding"], q)), lambda s: ~F.isnan(s) & (F.abs(s) < float("inf"))))
    return records.select("id", best.alias("score")).where("score is not null")


def unified(persistent: DataFrame, ephemeral: DataFrame, k: int, lift: float = 1.2) -> DataFrame:
    """The k best of both tiers' hits (id, score), the ephemeral ones' scores times ``lift``."""
    both = persistent.select("id", "score", F.lit("persistent").alias("tier")).unionByName(ephemeral.select("id", (F.col("score") * lift).alias("score"), F.lit("ephemeral").alias("tier")))
    return both.orderBy(F.desc("score"), "tier", "id").limit(k)


def read_profile(reads: DataFrame) -> DataFrame:
    """dataset, reads, bytes for each, compression ratio and share of cache hits (0 where nothing was read)."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    return reads.groupBy("dataset").agg(
        F.count("*").alias("reads"), F.coalesce(F.avg("bytes"), F.lit(0.0)).alias("bytes_each"), ratio("bytes", "stored").alias("compression"), F.avg(F.col("hit").cast("double")).alias("hit_rate"),
    )


def chained(rows: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """key, head: each log's chain of SHA-256, every link over the one before and the next entry.

    A chain is serial by nature: a log is read as a sorted stream, of which one digest is held; logs are worked on side by side.
    """
    dealt = rows.select(key, order, data).repartition(key).sortWithinPartitions(key, order)

    def task(batches):
        now, head, begun, kind = None, "", False, None
        for batch in batches:
            kind = batch.schema.field(0).type
            out: tuple[list, list] = ([], [])
            for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or k != now:
                    if begun:
                        out[0].append(now)
                        out[1].append(head)
                    now, head, begun = k, "", True
                head = hashlib.sha256((head + (x or "")).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string())], names=[key, "head"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([head], pa.string())], names=[key, "head"])

    return dealt.mapInArrow(task, f"{key} {rows.schema[key].dataType.simpleString()}, head string")


def media_ref(kind: str, value: Column, mime_type: Column | str) -> Column:
    """struct of ref_type (path, url, inline), value, mime_type, size_bytes (of inline data only) and checksum (FNV-1a of the bytes or of the string)."""
    if kind not in ("path", "url", "inline"):
        raise ValueError(f"no media reference of kind {kind}")
    mime = F.lit(mime_type) if isinstance(mime_type, str) else mime_type
    size = F.octet_length(value).cast("long") if kind == "inline" else F.lit(None).cast("long")
    return F.struct(F.lit(kind).alias("ref_type"), value.cast("binary").alias("value"), mime.alias("mime_type"), size.alias("size_bytes"), fnv1a64(value).alias("checksum"))


def observation(raw: Column, interpretation: Column, confidence: Column, modality: Column) -> Column:
    """struct of what was perceived, what was made of it, how surely (held between 0 and 1) and by which sense."""
    sure = F.least(F.greatest(confidence.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.struct(raw.alias("raw_perception"), interpretation.alias("interpretation"), sure.alias("confidence"), modality.alias("modality"))


def resolved_paths(links: DataFrame, paths: list[str], root: int = 0) -> DataFrame:
    """path, node: the node each path leads to along named links (parent, name, child); null where one is missing. One join for each part."""
    spark = links.sparkSession
    table = spark.createDataFrame([(p, [x for x in p.split("/") if x]) for p in paths], "path string, parts array<string>")
    now = table.withColumn("node", F.lit(root).cast("long"))
    for k in range(max((len([x for x in p.split("/") if x]) for p in paths), default=0)):
        step = F.try_element_at("parts", F.lit(k + 1))
        now = now.withColumn("step", step).join(links, (F.col("node") == F.col("parent")) & (F.col("step") == F.col("name")), "left")
        now = now.select("path", "parts", F.when(F.col("step").isNull(), F.col("node")).otherwise(F.col("child")).alias("node"))
    return now.select("path", "node")


def cf_attributes(attrs: Column) -> dict[str, Column]:
    """Columns for the conventions' attributes out of a map of strings; the valid range from either form."""
    number = lambda name: F.try_element_at(attrs, F.lit(name)).cast("double")
    pair = F.split(F.try_element_at(attrs, F.lit("valid_range")), r"[,\s]+")
    return {
        "units": F.try_element_at(attrs, F.lit("units")), "long_name": F.try_element_at(attrs, F.lit("long_name")), "fill": number("_FillValue"), "missing": number("missing_value"),
        "scale": number("scale_factor"), "offset": number("add_offset"), "low": F.coalesce(F.try_element_at(pair, F.lit(1)).cast("double"), number("valid_min")), "high": F.coalesce(F.try_element_at(pair, F.lit(2)).cast("double"), number("valid_max")),
    }


def is_coordinate(name: Column, dimensions: Column) -> Column:
    """Whether a variable has one dimension, of its own name."""
    return (F.size(dimensions) == 1) & (F.try_element_at(dimensions, F.lit(1)) == name)


def summary(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """line of a Markdown summary of a store: counts, then the five most frequent kinds (kind)."""
    totals = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("deleted")).alias("active")).select(F.array(F.struct(F.lit(0).alias("k"), F.lit("# Memory").alias("line")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("- records: "), "n").alias("line")), F.struct(F.lit(2).alias("k"), F.concat(F.lit("- active: "), "active").alias("line"))).alias("x"))
    top = kinds.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(5)
    lines = totals.select(F.inline("x")).select("k", "line").unionByName(top.select(F.lit(3).alias("k"), F.concat(F.lit("- "), "kind", F.lit(": "), "n").alias("line")))
    return lines
