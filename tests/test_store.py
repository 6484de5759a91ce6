"""A store of runs: writers that die, runs that come again, rollbacks, purges, and which folders are read."""

import tempfile

import pytest
from pyspark.sql import functions as F

from attestor.sources import store

RUN = "run_id long, case_id long, status string, started_at timestamp, finished_at timestamp"


def part(spark, ids, value, day=1, status="completed"):
    runs = spark.createDataFrame([(i, i % 2, status) for i in ids], "run_id long, case_id long, status string").withColumns({c: F.to_timestamp(F.lit(f"2024-01-{day:02d}")) for c in ("started_at", "finished_at")})
    rows = runs.select("case_id", "run_id", F.lit(value).alias("v"))
    return {"runs": runs, "findings": rows, "evidence": rows.where("run_id % 2 = 0")}


def values(df):
    return {(r["run_id"], r["v"]) for r in df.collect()}


def test_a_writer_that_dies_is_not_seen(spark):
    root = tempfile.mkdtemp() + "/s"
    assert store.commits(spark, root).count() == 0
    store.commit(spark, root, part(spark, [1, 2], "a"))
    broken = part(spark, [1, 3], "b")
    broken["evidence"] = broken["evidence"].withColumn("v", F.expr("raise_error('gone')"))
    broken["evidence"] = spark.range(1).select(F.lit(0).alias("case_id"), F.lit(3).alias("run_id"), F.expr("raise_error('gone')").cast("string").alias("v"))
    with pytest.raises(Exception, match="gone"):
        store.commit(spark, root, broken)
    # its runs and findings are there whole, and yet nothing of it counts
    assert spark.read.parquet(f"{root}/findings").count() == 4
    assert values(store.facts(spark, root, "findings")) == {(1, "a"), (2, "a")} and store.run_states(spark, root).count() == 2
    assert store.purge(spark, root, 1) == {"runs": 2, "findings": 2, "evidence": 0}
    assert values(store.facts(spark, root, "findings")) == {(1, "a"), (2, "a")}


def test_runs_again_back_and_again(spark):
    root = tempfile.mkdtemp() + "/s"
    store.commit(spark, root, part(spark, [1, 2, 3], "a"))
    store.commit(spark, root, part(spark, [2], "b", 2))
    ids = spark.createDataFrame([(1,), (2,), (2,), (9,)], "run_id long")
    assert values(store.facts(spark, root, "findings")) == {(1, "a"), (2, "b"), (3, "a")}
    assert store.roll_back(spark, root, ids, "2024-02-01") == 2 and store.roll_back(spark, root, ids, "2024-02-02") == 0
    assert values(store.facts(spark, root, "findings")) == {(3, "a")} and values(store.facts(spark, root, "evidence")) == set()
    assert {(r["run_id"], r["status"], r["finished_at"].month) for r in store.run_states(spark, root).collect()} == {(1, "rolled_back", 2), (2, "rolled_back", 2), (3, "completed", 1)}
    store.commit(spark, root, part(spark, [1], "c", 3))
    store.commit(spark, root, part(spark, [5], "d", 4, "running"))
    assert values(store.facts(spark, root, "findings")) == {(1, "c"), (3, "a"), (5, "d")}
    assert values(store.latest_snapshot(spark, root)) == {(1, "c")}  # of case 1; run 5 hasn't ended, case 0 has none left
    assert [(r["run_id"], r["place"]) for r in store.listed(spark, root).where("case_id = 1").orderBy("place").collect()] == [(5, 1), (1, 2), (3, 3)]
    for wrong in ("runs", "entities"):
        with pytest.raises(ValueError):
            store.facts(spark, root, wrong)
    with pytest.raises(ValueError):
        store.commit(spark, root, {"other": ids})


def test_versions_are_counted_and_purged(spark):
    root = tempfile.mkdtemp() + "/s"
    store.commit(spark, root, part(spark, [1, 2], "old"), version=1)
    store.commit(spark, root, part(spark, [2, 3, 4], "new"), version=2)
    assert {tuple(r) for r in store.contents(spark, root, "findings").collect()} == {(1, 1, 2), (2, 1, 3)}
    assert store.purge(spark, root, 2) == {"runs": 2, "findings": 2, "evidence": 1}
    assert values(store.facts(spark, root, "findings")) == {(2, "new"), (3, "new"), (4, "new")}
    assert store.purge(spark, root, 2) == {"runs": 0, "findings": 0, "evidence": 0}


def test_only_commits_that_count_are_read(spark):
    root = tempfile.mkdtemp() + "/s"
    store.commit(spark, root, part(spark, range(20), "a"))
    part(spark, range(100, 900), "dead")["findings"].write.parquet(f"{root}/findings/commit=dead")
    seen = store.committed(spark, root, "findings")
    assert "dynamicpruning" in seen._jdf.queryExecution().executedPlan().toString().lower()
    assert seen.count() == 20


def test_entities_are_folded(spark):
    root = tempfile.mkdtemp() + "/s"
    e = lambda *rows: {"entities": spark.createDataFrame(rows, "case_id long, run_id long, entity string, confidence string, source string, seen_at int").withColumn("seen_at", F.timestamp_seconds("seen_at"))}
    store.commit(spark, root, e((1, 1, "x", "LOW", "dns", 50), (1, 1, "y", "LOW", "dns", 5)))
    store.commit(spark, root, e((1, 2, "x", "HIGH", "rdap", 20), (2, 3, "x", "LOW", None, 7)))
    got = {(r["case_id"], r["entity"]): (r["source"], r["confidence"], r["first_seen"].second, r["last_seen"].second) for r in store.entities(spark, root).collect()}
    assert got == {(1, "x"): ("dns", "HIGH", 20, 50), (1, "y"): ("dns", "LOW", 5, 5), (2, "x"): (None, "LOW", 7, 7)}
