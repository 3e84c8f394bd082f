"""Structured Streaming forms: write-rate alerts, entries that expire, ingest."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.text import gate_reason


def rate_windows(events: DataFrame, limit: int, width: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """window, n of windows with more than ``limit`` events (event time ts, late rows up to ``late``)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "2 minutes") -> DataFrame:
    """user_id, session, n: sessions by gaps of event time."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def exact_rates(events: DataFrame, seconds: int = 60) -> DataFrame:
    """key, ts, n: of each event (key, ts in seconds) how many of its key lie in the ``seconds`` up to it, with state kept for each key.

    Only times inside the window are kept, so state is bounded by a key's rate. Late events count with what is still held.
    """
    import pandas as pd

    def step(key: tuple, pdfs: Iterator, state) -> Iterator:
        held = list(state.get[0]) if state.exists else []
        for pdf in pdfs:
            times = sorted(pdf["ts"].tolist())
            out = []
            for t in times:
                held.append(t)
                held = [x for x in held if x >= max(held) - seconds]
                out.append((key[0], t, sum(t - seconds <= x <= t for x in held)))
            yield pd.DataFrame(out, columns=["key", "ts", "n"])
        state.update((held,))

    return events.groupBy("key").applyInPandasWithState(step, "key long, ts double, n long", "held array<double>", "append", "NoTimeout")


def ttl_store(commands: DataFrame) -> DataFrame:
    """key, value, expired_at of entries as commands (key, op, value, ttl, ts as event time) come: state times out when an entry expires.

    ``commands`` needs a watermark on ts. An entry is put out when it is set; one with ttl 0 stays for ever.
    """
    import pandas as pd

    def step(key: tuple, pdfs: Iterator, state) -> Iterator:
        if state.hasTimedOut:
            (value,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "event": ["expired"]})
            return
        for pdf in pdfs:
            for row in pdf.sort_values("ts").itertuples():
                if row.op == "delete":
                    if state.exists:
                        state.remove()
                    continue
                state.update((row.value,))
                if row.ttl > 0:
                    state.setTimeoutTimestamp(max(int(row.ts.timestamp() * 1000) + int(row.ttl * 1000), state.getCurrentWatermarkMs() + 1))
                yield pd.DataFrame({"key": [key[0]], "value": [row.value], "event": ["set"]})

    return commands.groupBy("key").applyInPandasWithState(step, "key string, value string, event string", "value string", "append", "EventTimeTimeout")


def ingest(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends turns (text and others) that pass the gate to a Parquet table; each micro-batch is one append."""

    def append(batch: DataFrame, _: int) -> None:
        batch.withColumn("skipped", gate_reason(F.col("text"))).where("skipped is null").drop("skipped").write.mode("append").parquet(path)

    return turns.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
