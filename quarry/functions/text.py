"""Column expressions over text: tokens, the gate, query expansion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import constants as K

NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def normalized(text: Column) -> Column:
    """Letters and digits in lower case, one space between words; other signs vanish without a gap."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def gate_reason(text: Column, min_words: int = 3, max_trivial: float = 0.8) -> Column:
    """Why a message isn't worth keeping; null if it is."""
    plain = normalized(text)
    words = F.split(plain, " ")
    trivial = F.size(F.filter(words, lambda w: w.isin(K.TRIVIAL_WORDS)))
    return (
        F.when(plain == "", "empty input")
        .when(plain.isin(K.TRIVIAL_PHRASES), "trivial phrase")
        .when(F.size(words) < min_words, "too few words")
        .when(trivial / F.size(words) > max_trivial, "trivial words")
    )


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(text, F.lit(needle))
    return out


def expansion_rules(spark) -> DataFrame:
    """Rows (kind, weight, place, old, new, bounded): what may stand for what in a query. ``bounded``: only at word bounds."""
    rows = []
    for group in K.SYNONYM_GROUPS:
        rows += [("synonym", 0.7, old, new, True) for old in group for new in group if new != old]
    rows += [("acronym", 0.8, old, new, False) for old, new in K.ACRONYMS]
    rows += [("temporal", 0.6, old, new, True) for old, several in K.TEMPORAL_EXPANSIONS for new in several]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, kind string, weight double, old string, new string, bounded boolean")


def expanded(queries: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, rank, text, kind, weight: up to ``limit`` variants of each query (query_id, text), the heaviest first."""
    spark = queries.sparkSession
    rules = F.broadcast(expansion_rules(spark))  # a fixed table
    low = F.lower("text")
    at = F.expr("locate(lower(old), lower(text))")
    before, after = F.substring(low, at - 1, F.lit(1)), F.substring(low, at + F.length("old"), F.lit(1))
    free = lambda c: ~c.rlike("^[a-z0-9]$")
    hit = (at > 0) & (~F.col("bounded") | (((at == 1) | free(before)) & free(after)))
    swapped = F.concat(F.substring(F.col("text"), F.lit(1), at - 1), F.col("new"), F.expr("substring(text, locate(lower(old), lower(text)) + length(old))"))
    by_rule = queries.crossJoin(rules).where(hit).select("query_id", F.col("text").alias("query"), swapped.alias("text"), "kind", "weight", "place")
    words = queries.select("query_id", "text", F.posexplode(F.filter(F.split("text", NOT_WORD), lambda x: x != "")).alias("n", "word"))
    stem = F.lit(None).cast("string")
    for end, several in reversed(K.MORPHOLOGY):
        fits = (F.length("word") > len(end) + 2) & F.endswith(F.lower("word"), F.lit(end))
        stem = F.when(fits, F.concat(F.expr(f"left(lower(word), length(word) - {len(end)})"), F.lit(several[0]))).otherwise(stem)
    word_at = F.expr("locate(lower(word), lower(text))")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), word_at - 1), F.col("stem"), F.expr("substring(text, locate(lower(word), lower(text)) + length(word))"))
    by_form = words.withColumn("stem", stem).where("stem is not null").select("query_id", F.col("text").alias("query"), changed.alias("text"), F.lit("morphological").alias("kind"), F.lit(0.5).alias("weight"), (F.col("n") + 1_000_000).alias("place"))
    found = by_rule.unionByName(by_form).where(F.lower("text") != F.lower("query"))
    # Of variants alike, the first by rule stays; then the heaviest come first.
    first = found.groupBy("query_id", F.lower("text").alias("folded")).agg(F.min_by(F.struct("text", "kind", "weight", "place"), "place").alias("v")).select("query_id", "v.*")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "place"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "text", "kind", "weight")
