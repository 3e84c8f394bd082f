"""The queries of this package, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, chat, linededup, media, packing, pii, pitman, quality, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.without_boilerplate(docs).select("doc_id", "text", "n_removed")


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op3_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted(rows))


def op4_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 50 == 0))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman.scored(_table(spark, sf_dir, "documents"))


def op6_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decoded(bpe.encoded(_table(spark, sf_dir, "documents"))))


def op7_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.featured(media.stored(_table(spark, sf_dir, "documents")))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(_table(spark, sf_dir, "labels")))
    return quality.scored(docs, model).withColumn("keep", F.col("p_good") >= quality.KEEP)


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op10_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(_table(spark, sf_dir, "documents"))
    base = F.split("base_spans", ",")
    count = lambda kind: F.size(F.filter(base, lambda x: F.startswith(x, F.lit(f"{kind}:")))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, pii.KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_cost_packing, op3_chat_spans, op4_ivfpq, op5_pitman_yor, op6_pair_index_bpe, op7_png_media, op8_ordinal_quality, op9_simhash_pivots, op10_crf_pii, pipeline)}

_BLANKS = "' ' || chr(9) || chr(13)"
_ESCAPED = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '### ', chr(92) || '### '), '</turn>', chr(92) || '</turn>')"
ORACLE_SQL = {
    "op3_chat_spans": f"""
        WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, k, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ' || replace({_ESCAPED.format("role")}, ':', chr(92) || ':') || ': ' || {_ESCAPED.format("text")} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
               FALSE AS rewrites
        FROM turns GROUP BY conv_id""",
    "op1_line_dedup": f"""
        WITH lines AS (SELECT source, trim(unnest(string_split(text, chr(10))), {_BLANKS}) AS line FROM documents),
        bad AS (SELECT coalesce(list(line), []) AS bad FROM (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {linededup.SITES})),
        cut AS (SELECT doc_id, string_split(text, chr(10)) AS all_lines,
                       list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, trim(x, {_BLANKS}))) AS kept FROM documents, bad)
        SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(len(all_lines) - len(kept) AS BIGINT) AS n_removed FROM cut""",
}
