"""Cases and their runs: the latest one, what a rollback leaves, timelines, and state over time.

State that was kept in a process becomes columns over ordered events: streaks,
spacing and expiry are windows, so any number of keys run at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_run(runs: DataFrame, case: str = "case_id") -> DataFrame:
    """runs(case, run_id, status, finished_at) -> the completed run of each case that finished last."""
    done = runs.where("status = 'completed'")
    return done.groupBy(case).agg(F.max_by(F.struct("run_id", "finished_at"), F.struct("finished_at", "run_id")).alias("r"), F.count("*").alias("completed")).select(case, "r.run_id", "r.finished_at", "completed")


def observation_status(seen: DataFrame, runs: DataFrame, case: str = "case_id") -> DataFrame:
    """seen(case, entity, last_seen) -> LATEST if it was seen in the latest run, which began at started_at; else HISTORICAL."""
    j = seen.join(runs, case)
    return j.select(case, "entity", F.when(F.col("last_seen") < F.col("started_at"), "HISTORICAL").otherwise("LATEST").alias("observation"))


def without_runs(facts: DataFrame, rolled_back: DataFrame) -> DataFrame:
    """Facts whose run wasn't rolled back; entities are kept apart and stay."""
    return facts.join(rolled_back.select("run_id").distinct(), "run_id", "left_anti")


def referenced(entities: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Entities that some fact refers to."""
    return entities.join(facts.select(key).distinct(), key, "left_semi")


def timeline(parts: list[DataFrame], now: str) -> DataFrame:
    """Events of all kinds (case_id, ts, label, source) in order; those without an instant come where ``now`` is, and keep none."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    key = F.coalesce("ts", F.lit(now).cast("timestamp_ntz"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(key, "label", "source")))


def failure_streaks(events: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """events(key, ord, ok) -> the failures in a row so far, and whether the circuit is open: from the third on, until a success."""
    w = Window.partitionBy(key).orderBy("ord")
    run = events.withColumn("island", F.sum(F.col("ok").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum((~F.col("ok")).cast("long")).over(Window.partitionBy(key, "island").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("streak", streak).withColumn("open", F.col("streak") >= threshold).drop("island")


def spaced(events: DataFrame, key: str, interval: int) -> DataFrame:
    """events(key, ord, at_us) -> when each may go so that two of a key are ``interval`` apart: the closed form of going one after the other."""
    w = Window.partitionBy(key).orderBy("at_us", "ord")
    n = F.row_number().over(w).cast("long")
    ahead = F.max(F.col("at_us") - n * F.lit(interval)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("n", n).withColumn("release", ahead + F.col("n") * F.lit(interval)).withColumn("wait", F.col("release") - F.col("at_us"))


def cached(writes: DataFrame, ttl: DataFrame, now: str, version: int) -> DataFrame:
    """writes(key, kind, version, ts, value) -> the last value of each key of this version that hasn't expired; ttl(kind, seconds)."""
    last = writes.where(F.col("version") == version).groupBy("key").agg(F.max_by(F.struct("kind", "ts", "value"), F.struct("ts", "ord")).alias("r")).select("key", "r.*")
    expires = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.col("seconds")
    return last.join(ttl, "kind").withColumn("expires", expires).where(F.col("expires") >= F.unix_timestamp(F.lit(now).cast("timestamp")))
