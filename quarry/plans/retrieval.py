"""Queries of keyword and vector search, fusion and re-ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.operators import fusion, keyword, keyword_index, vector_index, vector_search
from quarry.plans.registry import query, rounded
from quarry.sources.shared import shared_dir
from quarry.sources.tables import table

WORDS = "apache license version the the"
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
NOW = 1_000_000.0


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _bm25_sql(where: str = "TRUE") -> str:
    terms = sorted(keyword.query_terms(WORDS).items())
    tf = ", ".join(f"len(list_filter(words, lambda x: x = '{t}')) AS tf{k}" for k, (t, _) in enumerate(terms))
    df = ", ".join(f"count_if(tf{k} > 0) AS df{k}" for k in range(len(terms)))
    part = " + ".join(f"{w} * ln((n - df{k} + 0.5) / (df{k} + 0.5) + 1) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k, (_, w) in enumerate(terms))
    hit = " OR ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"""bm25_words AS (SELECT doc_id AS id, {TOKENS} AS words FROM documents WHERE {where}),
        bm25_counts AS (SELECT id, len(words) AS dl, {tf} FROM bm25_words),
        bm25_stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM bm25_counts),
        bm25 AS (SELECT id, {part} AS score FROM bm25_counts, bm25_stats WHERE {hit})"""


_COSINE_SQL = "cosine AS (SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"


@query(f"WITH {_bm25_sql()} SELECT id AS doc_id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 10")
def bm25_topk(spark, d):
    return rounded(keyword.top(keyword.bm25(_docs(spark, d), WORDS), 10).withColumnRenamed("id", "doc_id"), "score")


@query(f"WITH {_bm25_sql()} SELECT id AS doc_id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 10")
def bm25_index_topk(spark, d):
    """The same from a stored index, whose blocks that cannot reach the top are not read."""
    index = keyword_index.KeywordIndex.build(_docs(spark, d), f"{shared_dir(spark).rstrip('/')}/keywords-{uuid.uuid4().hex}")
    return rounded(keyword_index.KeywordIndex.open(spark, index.folder).search(WORDS, 10).withColumnRenamed("id", "doc_id"), "score")


@query(f"WITH {_bm25_sql('doc_id % 10 <> 0')} SELECT id AS doc_id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 10")
def bm25_topk_active(spark, d):
    return rounded(keyword.top(keyword.bm25(_docs(spark, d).where("id % 10 <> 0"), WORDS), 10).withColumnRenamed("id", "doc_id"), "score")


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) , n AS (SELECT count(*) AS n FROM documents)
        SELECT term, count(DISTINCT doc_id) AS df, round(ln((any_value(n) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5) + 1), 6) AS idf FROM t, n GROUP BY term""")
def bm25_idf(spark, d):
    docs = _docs(spark, d)
    n = docs.agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return rounded(keyword.document_frequency(docs).crossJoin(F.broadcast(n)).select("term", "df", idf.alias("idf")), "idf")


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term")
def token_df(spark, d):
    return keyword.document_frequency(_docs(spark, d))


@query(f"WITH {_COSINE_SQL} SELECT id AS vec_id, round(score, 6) AS score FROM cosine ORDER BY score DESC, id LIMIT 10")
def cosine_topk(spark, d):
    rows = _vectors(spark, d)
    return rounded(vector_search.flat_topk(rows, vector_search.vector_of(rows, 7), 10).withColumnRenamed("id", "vec_id"), "score")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def cosine_topk_multi(spark, d):
    rows = _vectors(spark, d)
    found = vector_search.multi_topk(rows, rows.where("id % 100 = 0"), 5)
    return rounded(found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), "score"), "score")


@query("""SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q
        ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), vec_id LIMIT 10""")
def l2_topk(spark, d):
    rows = _vectors(spark, d)
    found = vector_search.flat_topk(rows, vector_search.vector_of(rows, 7), 10, "l2")
    return rounded(found.select(F.col("id").alias("vec_id"), F.col("score").alias("distance")), "distance")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_norms(spark, d):
    return rounded(_vectors(spark, d).select(F.col("id").alias("vec_id"), V.norm(F.col("embedding")).alias("norm")), "norm", places=5)


@query("""SELECT e.label, round(max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS best, count(*) AS n
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 GROUP BY e.label""")
def cosine_by_label_max(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = F.array(*(F.lit(x) for x in vector_search.vector_of(rows, 7)))
    return rounded(rows.where("id <> 7").groupBy("label").agg(F.max(V.cosine(F.col("embedding"), q)).alias("best"), F.count("*").alias("n")), "best")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0""")
def distance_matrix(spark, d):
    rows = _vectors(spark, d)
    return rounded(vector_search.distances(rows, rows.where("id % 100 = 0")).withColumnRenamed("id", "vec_id"), "distance")


@query("SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q")
def dot_products(spark, d):
    rows = _vectors(spark, d)
    return rounded(vector_search.scored(rows, vector_search.vector_of(rows, 7), "dot").select(F.col("id").alias("vec_id"), F.col("score").alias("dot")), "dot")


_MINMAX = "CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END"
_FUSED_SQL = f"""{_COSINE_SQL}, {_bm25_sql()},
        nv AS (SELECT id, {_MINMAX} AS score FROM cosine, (SELECT min(score) AS lo, max(score) AS hi FROM cosine)),
        nk AS (SELECT id, {_MINMAX} AS score FROM bm25, (SELECT min(score) AS lo, max(score) AS hi FROM bm25)),
        fused AS (SELECT coalesce(nv.id, nk.id) AS id, 0.7 * coalesce(nv.score, 0) + 0.3 * coalesce(nk.score, 0) AS score FROM nv FULL JOIN nk ON nv.id = nk.id)"""


def _lists(spark, d):
    rows = _vectors(spark, d)
    return vector_search.scored(rows, vector_search.vector_of(rows, 7)), keyword.bm25(_docs(spark, d), WORDS)


@query(f"WITH {_FUSED_SQL} SELECT id, round(score, 6) AS score FROM fused ORDER BY round(score, 9) DESC, id LIMIT 20")
def minmax_fusion(spark, d):
    v, k = _lists(spark, d)
    fused = fusion.weighted([(v, 0.7), (k, 0.3)])
    return rounded(fused.orderBy(F.desc(F.round("score", 9)), "id").limit(20), "score")


@query(f"""WITH {_COSINE_SQL}, {_bm25_sql()},
        a AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM (SELECT * FROM cosine ORDER BY score DESC, id LIMIT 100)),
        b AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM (SELECT * FROM bm25 ORDER BY score DESC, id LIMIT 100))
        SELECT id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY round(sum(s), 9) DESC, id LIMIT 20""")
def rrf_fusion(spark, d):
    fused = fusion.rrf(list(_lists(spark, d)), 100)
    return rounded(fused.orderBy(F.desc(F.round("score", 9)), "id").limit(20), "score")


_MEMORY_SQL = "memory AS (SELECT doc_id AS id, 1000000.0 - (doc_id % 50) * 3600 AS ts, CASE doc_id % 4 WHEN 0 THEN 'user_correction' WHEN 1 THEN 'conversation' WHEN 2 THEN 'system' ELSE 'tool' END AS channel, 1.0 / (1 + doc_id % 7) AS activation FROM documents)"
_RERANK = "0.3 * pow(2, -greatest(1000000.0 - ts, 0) / 86400) + 0.2 * (CASE channel WHEN 'user_correction' THEN 1.0 WHEN 'conversation' THEN 0.7 WHEN 'system' THEN 0.4 ELSE 0.2 END) + 0.5 * least(greatest(activation, 0), 1)"


def _memory(spark, d):
    i = F.col("doc_id")
    channel = F.when(i % 4 == 0, "user_correction").when(i % 4 == 1, "conversation").when(i % 4 == 2, "system").otherwise("tool")
    return table(spark, d, "documents").select(i.alias("id"), (F.lit(NOW) - (i % 50) * 3600).alias("ts"), channel.alias("channel"), (1.0 / (1 + i % 7)).alias("activation"))


@query(f"""WITH {_FUSED_SQL}, {_MEMORY_SQL}, c AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT 30),
        r AS (SELECT c.id, {_RERANK} AS score FROM c JOIN memory m ON c.id = m.id), b AS (SELECT max(score) AS best FROM r)
        SELECT id, round(score, 6) AS score FROM r, b WHERE best >= 0.1 AND score >= 0.1 AND best - score <= 0.5 ORDER BY score DESC, id LIMIT 10""")
def hybrid_backend(spark, d):
    v, k = _lists(spark, d)
    return rounded(fusion.backend_search(_memory(spark, d), v, k, 10, NOW).select("id", "score"), "score")


@query(f"WITH {_MEMORY_SQL} SELECT id, round({_RERANK}, 6) AS score FROM memory ORDER BY round({_RERANK}, 9) DESC, id LIMIT 50")
def rerank(spark, d):
    m = _memory(spark, d)
    ranked = m.select("id", fusion.rerank_score(F.col("ts"), F.col("channel"), F.col("activation"), NOW).alias("score"))
    return rounded(ranked.orderBy(F.desc(F.round("score", 9)), "id").limit(50), "score")


@query(f"WITH {_MEMORY_SQL} SELECT channel, round(any_value(CASE channel WHEN 'user_correction' THEN 1.0 WHEN 'conversation' THEN 0.7 WHEN 'system' THEN 0.4 ELSE 0.2 END), 6) AS authority, count(*) AS n FROM memory GROUP BY channel")
def source_authority(spark, d):
    return rounded(_memory(spark, d).withColumn("authority", fusion.authority(F.col("channel"))).groupBy("channel").agg(F.max("authority").alias("authority"), F.count("*").alias("n")), "authority")


@query(f"WITH {_MEMORY_SQL} SELECT id, round(pow(2, -greatest(1000000.0 - ts, 0) / 86400), 6) AS decay FROM memory")
def temporal_decay(spark, d):
    return rounded(_memory(spark, d).select("id", fusion.temporal_decay(F.col("ts"), NOW).alias("decay")), "decay")


@query(f"WITH {_COSINE_SQL}, b AS (SELECT max(score) AS best FROM cosine) SELECT id, round(score, 6) AS score FROM cosine, b WHERE best >= 0.1 AND score >= 0.1 AND best - score <= 0.75 ORDER BY score DESC, id LIMIT 10")
def confidence_filter(spark, d):
    rows = _vectors(spark, d)
    return rounded(fusion.confident(vector_search.scored(rows, vector_search.vector_of(rows, 7)), gap=0.75), "score")


@query("""WITH s AS (SELECT q.vec_id AS query_id, q.label AS wanted, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
          FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
        h AS (SELECT query_id, min(CASE WHEN label = wanted THEN rank END) AS rank FROM s WHERE rank <= 10 GROUP BY query_id)
        SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10,
               round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) AS n_queries FROM h""")
def hit_mrr_metrics(spark, d):
    rows = _vectors(spark, d)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    found = vector_search.multi_topk(rows, rows.where("id % 100 = 0"), 11).where("id <> query_id")
    named = found.join(labels.withColumnRenamed("vec_id", "id").withColumnRenamed("label", "found"), "id").join(labels.withColumnRenamed("vec_id", "query_id"), "query_id")
    # The query itself stands first, but for ties; ranks are taken without it.
    own = found.groupBy("query_id").agg(F.collect_list("rank").alias("ranks"))
    ranked = named.join(own, "query_id").withColumn("rank", F.size(F.filter("ranks", lambda r: r <= F.col("rank"))))
    best = ranked.where("rank <= 10").groupBy("query_id").agg(F.min(F.when(F.col("found") == F.col("label"), F.col("rank"))).alias("rank"))
    return rounded(fusion.hit_metrics(best), "hit_1", "hit_5", "hit_10", "mrr")


def _sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_NORMAL = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
GATE = f"""CASE WHEN plain = '' THEN 'empty input' WHEN list_contains({_sql_list(K.TRIVIAL_PHRASES)}, plain) THEN 'trivial phrase' WHEN len(string_split(plain, ' ')) < 3 THEN 'too few words'
        WHEN len(list_filter(string_split(plain, ' '), lambda w: list_contains({_sql_list(K.TRIVIAL_WORDS)}, w))) / len(string_split(plain, ' ')) > 0.8 THEN 'trivial words' END"""
_MESSAGES = [(0, ""), (1, "OK!"), (2, "Got it."), (3, "so it is"), (4, "the a an is it"), (5, "please look at the index"), (6, "  !? "), (7, "That's fine"), (8, "hello world"), (9, "it was so very fine, build it")]
_MESSAGES_SQL = "(VALUES " + ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in _MESSAGES) + ") m(id, text)"


@query(f"WITH t AS (SELECT conv_id * 100 + turn AS id, text FROM conversations UNION ALL SELECT -1 - id, text FROM {_MESSAGES_SQL}), p AS (SELECT id, {_NORMAL} AS plain FROM t) SELECT id, coalesce({GATE}, 'save') AS decision FROM p")
def decision_gate(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    more = spark.createDataFrame([(-1 - i, t) for i, t in _MESSAGES], "id long, text string")
    return turns.unionByName(more).select("id", F.coalesce(T.gate_reason(F.col("text")), F.lit("save")).alias("decision"))


ASKED = [(-1, "find the API bug"), (-2, "what changed recently"), (-3, "searching operations quickly"), (-4, "SQL and CI errors"), (-5, "nothing here")]


@query()
def query_expand(spark, d):
    """Variants of all users' turns, and of a few sentences more."""
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return T.expanded(turns.unionByName(spark.createDataFrame(ASKED, "query_id long, text string")))


_NEAREST = f"WITH {_COSINE_SQL} SELECT id, round(score, 6) AS score FROM cosine{{}} ORDER BY cosine.score DESC, id LIMIT 10"


@query(_NEAREST.format(""))
def ivf_search(spark, d):
    rows = _vectors(spark, d)
    return rounded(vector_index.kept_index(rows).search(vector_search.vector_of(rows, 7), 10), "score")


@query(_NEAREST.format(""))
def rairs_search(spark, d):
    rows = _vectors(spark, d)
    return rounded(vector_index.kept_index(rows, copies=2).search(vector_search.vector_of(rows, 7), 10), "score")


@query(_NEAREST.format(""))
def pq_search(spark, d):
    rows = _vectors(spark, d)
    return rounded(vector_index.kept_index(rows, lists=1).search(vector_search.vector_of(rows, 7), 10, codes=True), "score")


@query(_NEAREST.format(""))
def ivfpq_rerank(spark, d):
    rows = _vectors(spark, d)
    return rounded(vector_index.kept_index(rows).search(vector_search.vector_of(rows, 7), 10, probes=6, codes=True), "score")


@query()
def ivf_balance(spark, d):
    return vector_index.kept_index(_vectors(spark, d)).balance()


def _fresh(spark):
    return f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"


@query(_NEAREST.format(" WHERE id % 3 <> 1 OR id % 2 = 0"))
def index_insert_delete(spark, d):
    """An index of half the vectors, to which the others are added, and of which some are deleted."""
    rows = _vectors(spark, d)
    index = vector_index.VectorIndex.build(rows.where("id % 2 = 0"), _fresh(spark))
    index.insert(rows.where("id % 2 = 1"))
    index.delete(rows.where("id % 3 = 1 and id % 2 = 1"))
    return rounded(vector_index.VectorIndex.open(spark, index.folder).search(vector_search.vector_of(rows, 7), 10, codes=True), "score")


@query("SELECT CAST(count_if(vec_id % 5 <> 0) AS BIGINT) AS active, CAST(0 AS BIGINT) AS deleted, 64 AS dimension FROM embeddings")
def index_compact(spark, d):
    """Counts of an index without the rows that were deleted from it."""
    rows = _vectors(spark, d)
    index = vector_index.VectorIndex.build(rows, _fresh(spark))
    index.delete(rows.where("id % 5 = 0"))
    return index.compact(_fresh(spark)).stats().select("active", "deleted", "dimension")


@query("SELECT count(*) AS n, count(*) AS last_end, TRUE AS joined FROM embeddings")
def index_offsets(spark, d):
    """Lists laid end to end: their sizes sum up to the rows, and each begins where the one before ends."""
    table_ = vector_index.kept_index(_vectors(spark, d)).offsets()
    before = F.lag(F.col("start") + F.col("n"), 1, 0).over(Window.orderBy("list"))  # a row for each list
    return table_.withColumn("before", before).agg(F.sum("n").alias("n"), F.max(F.col("start") + F.col("n")).alias("last_end"), F.min(F.col("before") == F.col("start")).alias("joined"))


@query(_NEAREST.format(""))
def strategy_search(spark, d):
    """The search that suits the number of rows; by any strategy the rows are the same."""
    rows = _vectors(spark, d)
    return rounded(vector_search.search(rows, vector_search.vector_of(rows, 7), 10), "score")


@query(_NEAREST.format(""))
def prenormalised_search(spark, d):
    rows = _vectors(spark, d)
    return rounded(vector_search.search(rows, vector_search.vector_of(rows, 7), 10, "prenormalised"), "score")
