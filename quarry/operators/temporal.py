"""Time: ranges, neighbours in time, overlap, as-of states, session chains, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import forget, written

DAY = 86_400.0


def between(rows: DataFrame, start: float, end: float) -> DataFrame:
    """Rows with ts in the closed range, a filter that reaches the scan."""
    return rows.where(F.col("ts").between(start, end))


def latest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def earliest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("ts", "id").limit(n)


def before(rows: DataFrame, ts: float, n: int) -> DataFrame:
    return latest(rows.where(F.col("ts") < ts), n)


def after(rows: DataFrame, ts: float, n: int) -> DataFrame:
    return earliest(rows.where(F.col("ts") > ts), n)


def overlapping(sessions: DataFrame, start: float, end: float) -> DataFrame:
    """Sessions (start_ts, end_ts or null: open) that share a moment with the closed range."""
    return sessions.where((F.col("start_ts") <= end) & (F.col("end_ts").isNull() | (F.col("end_ts") >= start)))


def overlap_join(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs (left_id, right_id) of intervals (id, start_ts, end_ts) that overlap.

    Both sides are cut into bins of ``width`` seconds and joined on the bin; a pair counts in the first bin that both touch. No theta join.
    """
    bins = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("start_ts").alias(f"{p}_s"), F.col("end_ts").alias(f"{p}_e"), F.explode(F.sequence(F.floor(F.col("start_ts") / width), F.floor(F.col("end_ts") / width))).alias("bin"))
    pairs = bins(left, "left").join(bins(right, "right"), "bin").where("left_s <= right_e and right_s <= left_e")
    return pairs.where(F.col("bin") == F.floor(F.greatest("left_s", "right_s") / width)).select("left_id", "right_id")


def state_asof(changes: DataFrame, ts: float) -> DataFrame:
    """entity_id, key, value: the last new value of each key at or before ``ts``; changes are (entity_id, ts, seq, key, new)."""
    return changes.where(F.col("ts") <= ts).groupBy("entity_id", "key").agg(F.max_by("new", F.struct("ts", "seq")).alias("value"))


def segments(order: Column, width: float) -> Column:
    """The segment of an ordered column: rows of a key are worked on segment by segment, so that a key with very many rows is not one task's."""
    return F.floor(order / width)


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, within, across, width: float) -> DataFrame:
    """The rows with ``segment`` and ``carry``: what all earlier segments of the key come to.

    ``value`` is summed up in each segment by ``within`` (an aggregate), and segments by ``across`` (of a column, over a window of segments, one row each).
    """
    from pyspark.sql import Window

    cut = rows.withColumn("segment", segments(F.col(order[0]), width))
    per = cut.groupBy(*keys, "segment").agg(within(value).alias("own"))
    before = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(per.select(*keys, "segment", across(F.col("own")).over(before).alias("carry")), [*keys, "segment"])


def asof_join(left: DataFrame, right: DataFrame, key: str, width: float = 7 * DAY) -> DataFrame:
    """For each left row (key, id, ts) the value of the last right row (key, ts, value) at or before it.

    Both sides go through one sort by key, segment and time, and the last value is carried on, from segment to segment too: no pairs are made.
    """
    from pyspark.sql import Window

    rows = left.select(key, "ts", F.lit(1).alias("side"), "id", F.lit(None).cast("double").alias("value")).unionByName(right.select(key, "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), F.col("value").cast("double").alias("value")))
    last = lambda v: F.max_by(v, F.when(F.col("side") == 0, F.struct("ts", "value")))
    rows = carried(rows, [key], ["ts"], F.col("value"), last, lambda c: F.last(c, ignorenulls=True), width)
    inside = F.last("value", ignorenulls=True).over(Window.partitionBy(key, "segment").orderBy("ts", "side", "value").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("value", F.coalesce(inside, "carry")).where("side = 1").select(key, "id", "ts", "value")


def session_chain(sessions: DataFrame, leaf: int) -> DataFrame:
    """depth, session_id from the root to ``leaf`` along parent_session; a cycle ends the walk.

    Steps double: each round joins the ancestors found with a table of jumps twice as far as before, so a chain of n sessions takes about log2(n) rounds.
    """
    up = sessions.select(F.col("session_id").cast("long").alias("a"), F.col("parent_session").cast("long").alias("b"))
    there = up.select("a").distinct()
    jumps = up.join(there.withColumnRenamed("a", "b"), "b", "left_semi").groupBy("a").agg(F.min("b").alias("b"))
    found = written(there.where(F.col("a") == leaf).select("a", F.lit(0).cast("long").alias("up")), "chain")
    jumps, far, before = written(jumps, "jumps"), 1, 0
    while (now := found.count()) != before:
        before = now
        more = found.join(jumps, "a").select(F.col("b").alias("a"), (F.col("up") + far).alias("up"))
        grown = written(found.unionByName(more).groupBy("a").agg(F.min("up").alias("up")), "chain")
        further = written(jumps.join(jumps.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "jumps")
        for table in (found, jumps):
            forget(table)
        found, jumps, far = grown, further, 2 * far
    forget(jumps)
    last = found.agg(F.max("up").alias("last"))
    return found.join(F.broadcast(last), F.lit(True)).select((F.col("last") - F.col("up")).cast("int").alias("depth"), F.col("a").alias("session_id"))


def children(sessions: DataFrame, parent: int) -> DataFrame:
    return sessions.where(F.col("parent_session") == parent).select("session_id")


def boost(ts: Column, mode: str, now: float, start: float = 0.0, end: float = 0.0) -> Column:
    """How well a time suits a query about time: none, latest, earliest, around (now), between (start, end)."""
    recent = F.exp(-F.greatest(F.lit(now) - ts, F.lit(0.0)) / DAY * F.log(F.lit(2.0)))
    outside = F.greatest(F.lit(start) - ts, ts - F.lit(end))
    return {
        "none": F.lit(0.0), "latest": recent, "earliest": 1 - recent, "around": F.exp(-F.pow((ts - now) / DAY, F.lit(2.0)) / 2),
        "between": F.when(outside <= 0, 1.0).otherwise(F.exp(-outside / DAY)),
    }[mode]


def sessionised(events: DataFrame, gap: float, width: float = 7 * DAY) -> DataFrame:
    """user_id, session_no, start_ts, end_ts, n: runs of a user's events (user_id, ts) with gaps of ``gap`` seconds at most.

    Runs are found in each segment of time, then those that go on over a segment's end are joined: there are as many rows left as runs and segments.
    """
    from pyspark.sql import Window

    cut = events.select("user_id", "ts", "id", segments(F.col("ts"), width).alias("segment"))
    inside = Window.partitionBy("user_id", "segment").orderBy("ts", "id")
    fresh = (F.col("ts") - F.lag("ts").over(inside) > gap) | F.lag("ts").over(inside).isNull()
    runs = cut.withColumn("run", F.sum(fresh.cast("int")).over(inside)).groupBy("user_id", "segment", "run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))
    by_user = Window.partitionBy("user_id").orderBy("start_ts", "segment")
    new = (F.col("start_ts") - F.lag("end_ts").over(by_user) > gap) | F.lag("end_ts").over(by_user).isNull()
    numbered = runs.withColumn("fresh", new.cast("int")).withColumn("session_no", F.sum("fresh").over(by_user))
    return numbered.groupBy("user_id", "session_no").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n"))
