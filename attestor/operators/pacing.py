"""When a service may be asked: which key a call is spaced by, and pauses of hosts that asked for one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between two calls of a service.
INTERVALS = {"default": 0.25, "username": 0.5, "crtsh": 1.0, "rdap": 0.5, "virustotal": 1.0, "abuseipdb": 1.0, "shodan": 1.0, "hibp": 1.6, "github": 0.5, "wayback": 0.8}


def limiter_key(provider: Column, host: Column) -> Column:
    """What a call is spaced by: its host, where it is known, else its service."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    service = F.coalesce(F.nullif(low(provider), F.lit("")), F.lit("default"))
    return F.when(low(host) != "", F.concat(F.lit("host:"), low(host))).otherwise(F.concat(F.lit("provider:"), service))


def interval_us(provider: Column, host: Column, override: Column | None = None, intervals: dict[str, float] = INTERVALS) -> Column:
    """Microseconds to the next call: as asked for, but not below 0; else the host's, the service's, or the usual ones."""
    known = F.create_map(*(F.lit(x) for k, v in intervals.items() for x in (k, round(v * 1e6))))
    of = F.coalesce(F.try_element_at(known, F.lower(F.trim(host))), F.try_element_at(known, provider), F.lit(round(intervals["default"] * 1e6)))
    return (of if override is None else F.coalesce(F.when(override.isNotNull(), F.greatest(F.lit(0), F.round(override * 1e6))), of)).cast("long")


def _hosts(events: DataFrame) -> DataFrame:
    """Hosts in one spelling, with the day of each event; those without host or instant aren't paused."""
    return events.withColumn("host", F.lower(F.trim("host"))).where("host <> '' AND at_us IS NOT NULL").withColumn("day", F.floor(F.col("at_us") / 86_400_000_000))


def _until(seconds: Column) -> Column:
    return F.col("at_us") + F.round(F.greatest(F.lit(0.0), seconds.cast("double")) * 1e6).cast("long")


def _same(left: str, right: str, *columns: str) -> Column:
    return reduce(lambda a, c: a & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}")), columns[1:], F.col(f"{left}.{columns[0]}") == F.col(f"{right}.{columns[0]}"))


def pauses(events: DataFrame) -> DataFrame:
    """events(host, at_us, ord, seconds, reason) -> host, from_us, to_us, reason, ended: each pause until it expires or the next begins.

    A host's days are windows of their own, and only each day's first pause is known to the day before, so a host
    that most rows are of isn't sorted in one task. Pauses without seconds are none.
    """
    p = _hosts(events).where("seconds IS NOT NULL").withColumn("until", _until(F.col("seconds")))
    order = F.struct("at_us", "ord")
    first = p.groupBy("host", "day").agg(F.min("at_us").alias("first"))
    after = first.select("host", "day", F.lead("first").over(Window.partitionBy("host").orderBy("day")).alias("after"))
    within = p.withColumn("then", F.lead("at_us").over(Window.partitionBy("host", "day").orderBy(order)))
    j = within.alias("p").join(after.alias("a"), _same("p", "a", "host", "day"), "left").select("p.*", F.coalesce("p.then", "a.after").alias("next"))
    again = F.col("next") < F.col("until")
    return j.select("host", F.col("at_us").alias("from_us"), F.when(again, F.col("next")).otherwise(F.col("until")).alias("to_us"), "reason", F.when(again, "renewed").otherwise("expired").alias("ended"))


def remaining(events: DataFrame) -> DataFrame:
    """events(host, at_us, ord, seconds: null for a call, reason, ...) -> the calls, with what is left of their host's last pause and its reason, which stays when the pause is over.

    By host and day, with the last pause of earlier days carried over.
    """
    e = _hosts(events)
    order = F.struct("at_us", "ord")
    pause = F.when(F.col("seconds").isNotNull(), F.struct(_until(F.col("seconds")).alias("until"), F.col("reason").alias("reason")))
    e = e.withColumn("pause", pause)
    last = e.groupBy("host", "day").agg(F.max_by("pause", F.when(F.col("pause").isNotNull(), order)).alias("last"))
    before = Window.partitionBy("host").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("host", "day", F.last("last", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("host", "day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("own", F.last("pause", ignorenulls=True).over(so_far)).where("seconds IS NULL")
    j = e.alias("e").join(carried.alias("c"), _same("e", "c", "host", "day"), "left").withColumn("p", F.coalesce("e.own", "c.carried"))
    kept = [F.col(f"e.{c}") for c in events.columns if c not in ("seconds", "reason")]
    return j.select(*kept, F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("p.until") - F.col("e.at_us"), F.lit(0).cast("long"))).alias("left_us"), F.coalesce("p.reason", F.lit("")).alias("reason"))
