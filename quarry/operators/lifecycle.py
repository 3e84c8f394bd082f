"""What is kept: importance, decay, tiers, upserts, compaction, expiry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import cut

DAY = 86_400.0
WORKING_LAMBDA, EPISODIC_LAMBDA = math.log(2) / (7 * DAY), math.log(2) / (30 * DAY)


def length_score(text: Column) -> Column:
    """Words by white space, 100 or more for 1."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return F.least(words / 100, F.lit(1.0))


def importance(surprise: Column, correction: Column, length: Column) -> Column:
    """0.5 x surprise + 0.3 x correction + 0.2 x length."""
    return 0.5 * surprise + 0.3 * correction + 0.2 * length


def surprise(best_cosine: Column) -> Column:
    """1 - the largest cosine with what is known, between 0 and 1; 1 where nothing is known."""
    return F.least(F.greatest(1 - F.coalesce(best_cosine, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def decayed(importance_: Column, access: Column, last: Column, now: float, rate: float = WORKING_LAMBDA) -> Column:
    return importance_ * (access + 1) * F.exp(-F.lit(rate) * F.greatest(F.lit(now) - last, F.lit(0.0)))


def _best(rows: DataFrame, tier: str, capacity: int) -> DataFrame:
    """Rows of ``tier`` with the ``capacity`` highest decay scores, and all rows of other tiers.

    The cut is found by a top-k (each task keeps ``capacity`` rows), not by ranking all rows in one task.
    """
    own = rows.where(F.col("tier") == tier)
    cut = own.orderBy(F.desc("decay"), "id").limit(capacity).agg(F.min(F.struct("decay", (-F.col("id")).alias("low"))).alias("edge"), F.count("*").alias("held"))
    kept = own.crossJoin(F.broadcast(cut)).where((F.col("held") < capacity) | (F.struct("decay", (-F.col("id")).alias("low")) >= F.col("edge")))  # one row
    return kept.drop("edge", "held").unionByName(rows.where(F.col("tier") != tier))


def consolidated(memories: DataFrame, now: float, working: int = 100, episodic: int = 10_000, promote: float = 0.6, recalled: int = 10) -> DataFrame:
    """Evicts working memories beyond capacity, promotes important ones to episodic and often recalled ones to semantic, evicts episodic beyond capacity.

    ``memories``: id, tier, importance, access, last_ts.
    """
    rate = lambda tier: F.when(tier == "working", WORKING_LAMBDA).otherwise(EPISODIC_LAMBDA)
    score = F.col("importance") * (F.col("access") + 1) * F.exp(-rate(F.col("tier")) * F.greatest(F.lit(now) - F.col("last_ts"), F.lit(0.0)))
    rows = _best(memories.withColumn("decay", score), "working", working)
    moved = F.when((F.col("tier") == "working") & (F.col("importance") > promote), "episodic").otherwise(F.col("tier"))
    rows = rows.withColumn("tier", moved)
    rows = rows.withColumn("tier", F.when((F.col("tier") == "episodic") & (F.col("access") > recalled), "semantic").otherwise(F.col("tier")))
    return _best(rows.withColumn("decay", score), "episodic", episodic)


def tier_stats(memories: DataFrame) -> DataFrame:
    return memories.groupBy("tier").agg(F.count("*").alias("n"))


def hebbian(activation: Column, hits: Column, step: float = 0.15) -> Column:
    """Each hit makes a memory easier to find."""
    return activation + step * hits


def ticked(activation: Column, ticks: int = 1, rate: float = 0.98) -> Column:
    return activation * rate**ticks


def upserted(rows: DataFrame, key: str) -> DataFrame:
    """The last row (by seq) of each key; the first one's id stays."""
    return rows.groupBy(key).agg(F.min("id").alias("id"), F.max_by("value", "seq").alias("value"), F.count("*").alias("writes"))


def compacted(rows: DataFrame) -> DataFrame:
    """Rows that aren't deleted. Ids are stable; they are not numbered anew."""
    return rows.where(~F.col("deleted"))


def deleted_share(rows: DataFrame, limit: float = 0.3) -> DataFrame:
    share = F.avg(F.col("deleted").cast("double"))
    return rows.agg(share.alias("share"), (share > limit).alias("compact"))


# --- entries that expire ---------------------------------------------------


def alive(entries: DataFrame, now: float) -> DataFrame:
    """Entries whose time to live (0: for ever) isn't over."""
    return entries.where((F.col("ttl") == 0) | (F.col("set_ts") + F.col("ttl") >= now))


def evicted(entries: DataFrame, capacity: int, now: float) -> DataFrame:
    """The ``capacity`` entries used most, ties to the later access: expired ones go first."""
    return alive(entries, now).orderBy(F.desc("access"), F.desc("last_ts"), "key").limit(capacity)


def token_matches(entries: DataFrame, query: str) -> DataFrame:
    """key, score: how many of the query's words stand in the text."""
    words = [w for w in query.lower().split() if w]
    score = sum((F.when(F.contains(F.lower("text"), F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0))
    return entries.select("key", score.alias("score")).where("score > 0")


def promoted(entries: DataFrame, now: float, least: int = 3) -> DataFrame:
    """Entries still alive that were used ``least`` times, as memories of a channel of their own."""
    return alive(entries, now).where(F.col("access") >= least).select(F.concat(F.lit("ephemeral::"), "key").alias("channel"), "text")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Row numbers from 0 by ``order``, over partitions sorted by range: no single task sees all rows.

    The sorted rows are written out once, so that counts and numbers come from the same partitions; one count for each partition is collected.
    """
    ranged = cut(rows.orderBy(*order).withColumn("__p", F.spark_partition_id()))
    total, starts = 0, []
    for p, n in sorted(ranged.groupBy("__p").count().collect()):
        starts.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "__p int, __start long"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.join(offsets, "__p").withColumn("row_no", F.col("__start") + within - 1).drop("__p", "__start")
