"""Guards on writing: anomalies, provenance, strategies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions.text import contains_any, gate_reason


def windowed_counts(events: DataFrame, seconds: int = 60, slices: int = 0) -> DataFrame:
    """id, ts, n: how many events (id, ts in whole seconds) lie in the ``seconds`` up to each, both ends included.

    Events are counted by second first; each second's count goes to the spans of ``seconds`` it may lie in, so that
    a span is worked on by itself and time is not one single partition.
    """
    per_second = events.groupBy(F.floor("ts").alias("s")).agg(F.count("*").alias("n"))
    dealt = per_second.withColumn("span", F.explode(F.array(F.floor(F.col("s") / seconds), F.floor(F.col("s") / seconds) + 1)))
    running = F.sum("n").over(Window.partitionBy("span").orderBy("s").rangeBetween(-seconds, 0))
    sums = dealt.withColumn("n", running).where(F.col("span") == F.floor(F.col("s") / seconds)).select("s", "n")
    return events.withColumn("s", F.floor("ts")).join(sums, "s").select("id", "ts", "n")


def rate_severity(n: Column, limit: int) -> Column:
    return F.when(n > 3 * limit, "critical").when(n > 2 * limit, "high").when(n > limit, "medium")


def session_alerts(events: DataFrame, limit: int) -> DataFrame:
    """Sessions with more than ``limit`` writes."""
    return events.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def pattern_alert(text: Column) -> Column:
    """struct(pattern, severity) of the first suspicious pattern in the text, or null."""
    out = F.lit(None).cast("struct<pattern:string,severity:string>")
    for p in reversed(K.SUSPICIOUS_PATTERNS):
        severity = "critical" if "ignore" in p or "override" in p else "high" if "system" in p or "jailbreak" in p else "medium"
        out = F.when(F.contains(F.lower(text), F.lit(p)), F.struct(F.lit(p).alias("pattern"), F.lit(severity).alias("severity"))).otherwise(out)
    return out


def source_mix(n: Column, user: Column) -> Column:
    """Whether too large a share of recent writes is the user's."""
    share = user / n
    return F.when((n >= 10) & (share >= 0.95), "high").when((n >= 10) & (share > 0.8), "medium")


def saved_exchanges(exchanges: DataFrame) -> DataFrame:
    """conv_id, turn, channel, text or skip reason of each exchange (user_text, agent_text): corrections always, others if the gate lets them."""
    correction = contains_any(F.lower("user_text"), K.CORRECTION_CUES)
    reason = F.when(~correction, gate_reason(F.col("user_text")))
    text = F.concat_ws("\n---\n", "user_text", "agent_text")
    channel = F.when(correction, "correction").otherwise("conversation")
    return exchanges.select("conv_id", "turn", F.when(reason.isNull(), channel).alias("channel"), F.when(reason.isNull(), text).alias("text"), reason.alias("skipped"))


def exchanges(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, user_text, agent_text: user turns and the assistant turn that follows at once."""
    by_conv = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumn("next_role", F.lead("role").over(by_conv)).withColumn("next_turn", F.lead("turn").over(by_conv)).withColumn("agent_text", F.lead("text").over(by_conv))
    return rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.col("next_turn") == F.col("turn") + 1)).select("conv_id", "turn", F.col("text").alias("user_text"), "agent_text")


def fnv1a64(data: Column) -> Column:
    """The 64-bit FNV-1a hash of a string's or binary's bytes as a signed long; null counts as empty.

    Byte k of all values of a batch is folded at once, so that there are as many steps as the longest value has bytes.
    """

    @F.pandas_udf("long")
    def hashed(s: pd.Series) -> pd.Series:
        raw = [x or b"" for x in s]
        order = np.argsort([-len(x) for x in raw], kind="stable")
        lengths = np.array([len(raw[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        begin = np.cumsum(lengths) - lengths
        h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        prime = np.uint64(0x100000001B3)
        at = 0
        while len(lengths) and at < lengths[0]:
            live = int(np.searchsorted(-lengths, -at, side="left"))
            if live < 4:  # a few long ones go one by one
                break
            h[:live] = (h[:live] ^ flat[begin[:live] + at]) * prime
            at += 1
        for i in range(int(np.searchsorted(-lengths, -at, side="left"))):
            one = int(h[i])
            for b in flat[begin[i] + at : begin[i] + lengths[i]].tolist():
                one = ((one ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            h[i] = one
        out = np.empty(len(raw), np.uint64)
        out[order] = h
        return pd.Series(out.view(np.int64))

    return hashed(F.coalesce(data.cast("binary"), F.lit(b"")))
