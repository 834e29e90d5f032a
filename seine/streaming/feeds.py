"""Structured Streaming forms: change feeds, upserts, session boosts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seine.operators.history import WEIGHTS


def windowed_activity(events: DataFrame, late: str = "45 minutes", width: str = "15 minutes") -> DataFrame:
    """(window, file_path, events, weight) of an event stream (ts, kind, file_path); later rows than `late` are left out by the watermark."""
    weight = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])[F.col("kind")]
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "file_path")
        .agg(F.count("*").alias("events"), F.sum(weight).alias("weight"))
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "45 minutes") -> DataFrame:
    """(agent_id, session, events) by gaps of silence."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy("agent_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("events"))


def running_boosts(events: DataFrame, life_minutes: float = 15.0) -> DataFrame:
    """(file_path, boost, ts) after each micro-batch: decayed weights kept as state (boost, last time) a file, dropped after 45 minutes.

    A decayed sum needs only its value and its time, so state is two numbers a file.
    """

    def update(key: tuple, batches: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        boost, last = state.get if state.exists else (0.0, 0.0)
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            t = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 6e7
            w = pdf["kind"].map(WEIGHTS).fillna(0).to_numpy()
            now = max(last, float(t[-1]))
            boost = boost * float(np.exp((last - now) / life_minutes)) + float((w * np.exp((t - now) / life_minutes)).sum())
            last = now
        state.update((boost, last))
        state.setTimeoutTimestamp(int(max(last + 45, state.getCurrentWatermarkMs() / 6e4 + 1) * 60_000))
        yield pd.DataFrame({"file_path": [key[0]], "boost": [boost], "minute": [last]})

    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "45 minutes")
    return own.groupBy("file_path").applyInPandasWithState(
        update, "file_path string, boost double, minute double", "boost double, last double", "update", "EventTimeTimeout"
    )


def upsert_into(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run `apply` once for each micro-batch of (file_path, change, ...) with only the last change of each path."""

    def each(batch: DataFrame, epoch: int) -> None:
        columns = [c for c in batch.columns if c != "file_path"]
        last = batch.groupBy("file_path").agg(F.max_by(F.struct(*columns), "seq").alias("x")).select("file_path", "x.*")
        apply(last)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
