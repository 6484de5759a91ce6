"""Spacing and pauses over streams: a key's state is what was granted or asked for last, and a timer ends it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(state: GroupState, until_us: int) -> None:
    """The state is called back once the watermark is past this instant, also if no event comes."""
    state.setTimeoutTimestamp(max(-(-until_us // 1000), state.getCurrentWatermarkMs() + 1))


def spaced_stream(calls: DataFrame, interval: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, ord, ts) -> key, ord, at_us, release, wait, as ``runs.spaced`` gives for a table whose rows come in order of time.

    Within a batch calls go by time and ord. A key is forgotten when its last release is ``interval`` past, so state holds
    only keys that are busy.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free = state.get[0] if state.exists else None
        rows = []
        for at, ord_ in sorted((a, o) for b in batches for a, o in zip(b["at_us"], b["ord"], strict=True)):
            release = at if free is None else max(at, free)
            free = release + interval
            rows.append((key[0], ord_, at, release, release - at))
        state.update((int(free),))
        _timed(state, int(free))
        yield pd.DataFrame(rows, columns=["key", "ord", "at_us", "release", "wait"])

    c = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))
    return c.groupBy("key").applyInPandasWithState(step, "key string, ord long, at_us long, release long, wait long", "free long", "append", GroupStateTimeout.EventTimeTimeout)


def pauses_stream(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of (host, ts, ord, seconds, reason) -> the rows of ``pacing.pauses``, each when its pause ends.

    A pause that nothing renews ends by its timer, when other hosts' events have moved the watermark past it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        rows = []
        if state.hasTimedOut:
            rows.append((key[0], open_[0], open_[1], open_[2], "expired"))
            state.remove()
        else:
            new = sorted(((a, o, s, r) for b in batches for a, o, s, r in zip(b["at_us"], b["ord"], b["seconds"], b["reason"], strict=True)), key=lambda x: x[:2])
            for at, _, seconds, reason in new:
                if open_ is not None:
                    again = at < open_[1]
                    rows.append((key[0], open_[0], at if again else open_[1], open_[2], "renewed" if again else "expired"))
                open_ = (int(at), int(at + round(max(0.0, seconds) * 1e6)), reason)
            state.update(open_)
            _timed(state, open_[1])
        yield pd.DataFrame(rows, columns=["host", "from_us", "to_us", "reason", "ended"])

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("host", F.lower(F.trim("host"))).withColumn("at_us", F.unix_micros("ts"))
    e = e.where("host <> '' AND seconds IS NOT NULL").withColumn("seconds", F.col("seconds").cast("double"))
    return e.groupBy("host").applyInPandasWithState(step, "host string, from_us long, to_us long, reason string, ended string", "from_us long, until long, reason string", "append", GroupStateTimeout.EventTimeTimeout)
