"""Spacing and pauses: tables against a walk, streams against tables, timers that end a pause without an event."""

import datetime as dt
import random

from pyspark.sql import functions as F

from attestor.operators import pacing, runs
from attestor.streaming import pacing as streams

EVENT = "host string, at_us long, ord long, seconds double, reason string"


def walked(rows):
    """One event after the other: pauses, and what a call finds left."""
    open_, spans, left = {}, [], {}
    for host, at, ord_, seconds, reason in sorted(rows, key=lambda r: r[1:3]):
        if seconds is None:
            until, why = open_.get(host, (0, at, ""))[1:]
            left[ord_] = (max(0, until - at), why)
            continue
        if host in open_:
            since, until, why = open_[host]
            spans.append((host, since, min(at, until), why, "renewed" if at < until else "expired"))
        open_[host] = (at, at + round(max(0.0, seconds) * 1e6), reason)
    spans += [(h, since, until, why, "expired") for h, (since, until, why) in open_.items()]
    return sorted(spans), left


def made(n, seed):
    rnd, day = random.Random(seed), 86_400_000_000
    # one host has half of all rows; some days are empty
    return [(rnd.choice(["h", "h", "h", "a", "b"]), rnd.randrange(40) // 3 * 2 * day // 2 + rnd.randrange(50) * day // 50, k, rnd.choice([None, None, 0.0, -1.0, 0.5, 3000.0, 200_000.0]), f"r{k % 3}") for k in range(n)]


def test_pauses_and_what_is_left(spark):
    rows = made(600, 1)
    df = spark.createDataFrame(rows, EVENT).repartition(5)
    extra = spark.createDataFrame([(" ", 1, 9001, 1.0, "x"), (None, 1, 9002, 1.0, "x"), ("a", None, 9003, 1.0, "x"), ("only", 5, 9004, None, None)], EVENT)
    spans, left = walked(rows)
    assert sorted(tuple(r) for r in pacing.pauses(df.unionByName(extra)).collect()) == spans
    got = {r["ord"]: (r["left_us"], r["reason"]) for r in pacing.remaining(df.unionByName(extra)).collect()}
    assert got == left | {9004: (0, "")}
    assert pacing.pauses(df.limit(0)).count() == 0 and pacing.remaining(df.limit(0)).count() == 0


def test_keys_and_intervals(spark):
    rows = [("HIBP", " Host ", None), ("hibp", "", None), (None, None, None), ("x", None, -1.0), ("x", "rdap", 2.0), ("x", "RDAP", None)]
    df = spark.createDataFrame(rows, "p string, h string, o double")
    got = [tuple(r) for r in df.select(pacing.limiter_key(F.col("p"), F.col("h")), pacing.interval_us(F.col("p"), F.col("h"), F.col("o"))).collect()]
    assert got == [("host:host", 250000), ("provider:hibp", 1600000), ("provider:default", 250000), ("provider:x", 0), ("host:rdap", 2000000), ("host:rdap", 500000)]


def _streamed(spark, tmp_path, batches, schema, run, name):
    """Batches as files that come one at a time; the last moves the watermark past all timers, and a further one lets them fire."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={k:03d}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = run(files).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]


def _at(us):
    return dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)


def _in_time(rows, n):
    rows = sorted(rows, key=lambda r: r[1:3])
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def test_streamed_pauses_end_by_themselves(spark, tmp_path):
    rows = [(h, us, k, s, r) for k, (h, us, _, s, r) in enumerate(sorted(made(120, 2), key=lambda r: r[1])) if s is not None]
    batches = [[(h, _at(us), k, s, r) for h, us, k, s, r in part] for part in _in_time(rows, 4)]
    far = 60 * 86_400_000_000
    batches += [[("z", _at(far), 900, 0.0, "z")], [("z", _at(2 * far), 901, 0.0, "z")]]
    schema = "host string, ts timestamp_ntz, ord long, seconds double, reason string"
    got = _streamed(spark, tmp_path, batches, schema, streams.pauses_stream, "pauses")
    zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() * 1e6)
    spans = [(h, a + zero, b + zero, r, e) for h, a, b, r, e in walked(rows)[0]]
    assert sorted(r for r in got if r[0] != "z") == sorted(spans) and len({r[0] for r in spans}) == 3


def test_streamed_spacing(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), rnd.randrange(90) * 1_000_000 // 3, k) for k in range(200)]
    rows = [(key, us, k) for k, (key, us, _) in enumerate(sorted(rows, key=lambda r: r[1]))]
    batches = [[(key, _at(us), k) for key, us, k in part] for part in _in_time(rows, 3)]
    got = _streamed(spark, tmp_path, batches, "key string, ts timestamp_ntz, ord long", lambda s: streams.spaced_stream(s, 700_000), "spacing")
    zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() * 1e6)
    table = spark.createDataFrame([(key, k, us + zero) for key, us, k in rows], "key string, ord long, at_us long")
    assert sorted(got) == sorted((r["key"], r["ord"], r["at_us"], r["release"], r["wait"]) for r in runs.spaced(table, "key", 700_000).collect())
