"""BM25 keyword ranking."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.sources.shared import written

K1, B = 1.2, 0.75
#: Stands before a word that counts for its text; no word holds it.
MARK = "\x01"


def query_terms(text: str) -> Counter:
    """Terms of a query and how often each stands in it; repeated terms count repeatedly."""
    import re

    return Counter(re.findall(r"[^\W_]+", text.lower()))


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """id, length in tokens and the count of each query term: one narrow pass, no shuffle of tokens."""
    words = docs.select("id", tokens(F.col("text")).alias("words"))
    counts = [(F.size("words") - F.size(F.array_remove("words", t))).alias(f"tf{k}") for k, t in enumerate(terms)]
    return words.select("id", F.size("words").alias("dl"), *counts)


def bm25(docs: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of every row of ``docs`` (id, text) that holds a term of the query.

    Texts are cut into words once: each row's length and counts are written to the shared folder, a few
    integers for a text. Statistics are one aggregated row of that table; nothing is shuffled.
    """
    weights = query_terms(query)
    terms = sorted(weights)
    if not terms:
        return docs.sparkSession.createDataFrame([], "id long, score double")
    counts = written(term_counts(docs, terms), "bm25")
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))

    def part(k: int) -> Column:
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        return weights[terms[k]] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    score = sum((part(k) for k in range(1, len(terms))), part(0))
    found = counts.crossJoin(F.broadcast(stats)).where(F.greatest(*(F.col(f"tf{k}") for k in range(len(terms))), F.lit(0)) > 0)  # one row
    return found.select("id", score.alias("score"))


def top(scores: DataFrame, k: int, column: str = "score") -> DataFrame:
    """The k best rows, ties to the smaller id: each task keeps k rows."""
    return scores.orderBy(F.desc(column), "id").limit(k)


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df, tf over all documents.

    Each text gives its words and, marked, its distinct words; both are counted by word alone, in each task
    before the shuffle, so that what is shuffled grows with the vocabulary and not with the texts.
    """
    words = docs.select(tokens(F.col("text")).alias("words"))
    marked = F.concat("words", F.transform(F.array_distinct("words"), lambda x: F.concat(F.lit(MARK), x)))
    counts = words.select(F.explode(marked).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    once = F.startswith(F.col("word"), F.lit(MARK))
    by_term = counts.groupBy(F.when(once, F.expr("substring(word, 2)")).otherwise(F.col("word")).alias("term"))
    return by_term.agg(F.sum(F.when(once, F.col("n")).otherwise(0)).alias("df"), F.sum(F.when(once, 0).otherwise(F.col("n"))).alias("tf"))


def idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)
