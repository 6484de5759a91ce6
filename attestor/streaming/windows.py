"""Event-time windows and keyed state, for tables and for streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by type in windows of ``width``; with ``late``, a stream's windows close that long after their end."""
    ts = F.col("ts") if late is None else F.col("ts").cast("timestamp")
    e = events.withColumn("ts", ts)
    if late is not None:
        e = e.withWatermark("ts", late)
    total = F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), total.alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """A user's events with less than ``gap`` between them."""
    e = events if late is None else events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def circuit_stream(events: DataFrame, threshold: int = 3) -> DataFrame:
    """A stream of (user_id, ord, ok) -> failures in a row and whether the circuit is open, with the streak as state of a key.

    Within a batch a key's events go by ``ord``; a later batch carries the streak on.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = []
        for ord_, ok in sorted((o, k) for b in batches for o, k in zip(b["ord"], b["ok"], strict=True)):
            streak = 0 if ok else streak + 1
            rows.append((key[0], ord_, bool(ok), streak, streak >= threshold))
        state.update((streak,))
        yield pd.DataFrame(rows, columns=["user_id", "ord", "ok", "streak", "open"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ord long, ok boolean, streak long, open boolean", "streak long", "append", GroupStateTimeout.NoTimeout)
