"""Runs of cases in a folder of Parquet tables: all rows of a commit are seen at once, or none.

A commit writes each table into a folder of its own, ``<table>/commit=<id>``, and at the end one
small file, ``commits/<id>.json``. Readers join tables with these files on the
partition column, so what a dead writer left isn't seen, and only folders that count are read. Nothing is
changed in place: a run that is rolled back, or committed again, is a new record, and a run's last record counts.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.sources.steps import bounded, remove

COMMIT = "commit string, seq bigint, version int"
#: Tables whose rows go with their run. Entities stay: other runs may have seen them too.
FACTS = ("findings", "evidence", "relationships", "reports")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def _marked(spark: SparkSession, root: str, record: dict) -> None:
    """One file with a commit's record, under its name only when it is whole."""
    fs, draft = _files(spark, f"{root}/drafts/{record['commit']}")
    _, final = _files(spark, f"{root}/commits/{record['commit']}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(record), "utf-8"))
    finally:
        out.close()
    fs.mkdirs(final.getParent())
    if not fs.rename(draft, final):
        raise OSError(f"commit {record['commit']} could not be published")


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], version: int = 1) -> str:
    """Writes rows of several tables and then shows them all; ``runs`` says whose they are. Returns the commit's id.

    ``runs`` has run_id, case_id, status, started_at and finished_at; the others case_id and run_id, ``entities`` also entity,
    confidence, source and seen_at. A writer that dies before the end leaves nothing that is seen. Two commits at one time don't disturb each other.
    """
    unknown = set(tables) - {"runs", "entities", *FACTS}
    if unknown:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    name = uuid.uuid4().hex
    for table, rows in tables.items():
        rows.write.option("compression", "zstd").parquet(f"{root}/{table}/commit={name}")
    _marked(spark, root, {"commit": name, "seq": time.time_ns(), "version": version})
    return name


def commits(spark: SparkSession, root: str) -> DataFrame:
    """commit, seq, version of all commits."""
    return spark.read.schema(COMMIT).json(f"{root}/commits") if _exists(spark, f"{root}/commits") else spark.createDataFrame([], COMMIT)


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows of a table that were ever committed, with their commit, seq and version; the folders of other commits aren't read."""
    # folders are pruned by what is found in a join only where the other side has a condition
    return spark.read.parquet(f"{root}/{table}").join(bounded(commits(spark, root).where("seq > 0")), "commit")


def run_states(spark: SparkSession, root: str) -> DataFrame:
    """Each run's last record, and in which commit its rows are: the last that isn't a rollback."""
    r = committed(spark, root, "runs")
    last = F.max_by(F.struct("case_id", "status", "started_at", "finished_at"), F.struct("seq", "commit")).alias("r")
    rows = F.max_by(F.when(F.col("status") != "rolled_back", F.col("commit")), F.struct(F.col("status") != "rolled_back", "seq", "commit")).alias("rows_in")
    return r.groupBy("run_id").agg(last, rows).select("run_id", "r.*", "rows_in")


def facts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table that count: of each run those of its last commit, none of runs that are rolled back."""
    if table not in FACTS:
        raise ValueError(f"{table} has no rows of runs")
    live = run_states(spark, root).where("status <> 'rolled_back'").select(F.col("run_id").alias("_run"), "rows_in")
    f = committed(spark, root, table)
    return f.join(live, (f["run_id"] == F.col("_run")) & (f["commit"] == F.col("rows_in")), "left_semi").drop("commit", "seq", "version")


def entities(spark: SparkSession, root: str) -> DataFrame:
    """Each case's entities over all commits: source and first time of the first, confidence and last time of the last."""
    order = F.struct("seq", "seen_at", "source")
    return committed(spark, root, "entities").groupBy("case_id", "entity").agg(F.min_by("source", order).alias("source"), F.max_by("confidence", order).alias("confidence"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def roll_back(spark: SparkSession, root: str, runs: DataFrame, at: str) -> int:
    """Takes back the given runs (run_id), in one commit; returns how many of them there are. Those that are back already, or unknown, aren't counted."""
    known = run_states(spark, root).where("status <> 'rolled_back'").join(runs.select("run_id").distinct(), "run_id", "left_semi")
    rows = known.select("run_id", "case_id", F.lit("rolled_back").alias("status"), "started_at", F.lit(at).cast("timestamp").alias("finished_at"))
    name = uuid.uuid4().hex
    rows.write.parquet(f"{root}/runs/commit={name}")
    n = spark.read.parquet(f"{root}/runs/commit={name}").count()
    if n:
        _marked(spark, root, {"commit": name, "seq": time.time_ns(), "version": 1})
    else:
        remove(spark, f"{root}/runs/commit={name}")
    return n


def latest_snapshot(spark: SparkSession, root: str, table: str = "findings") -> DataFrame:
    """The rows of each case's run that was completed last."""
    done = run_states(spark, root).where("status = 'completed'").groupBy("case_id").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"))
    return facts(spark, root, table).join(done, ["case_id", "run_id"], "left_semi")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Each case's runs, the one that began last first."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    return run_states(spark, root).drop("rows_in").withColumn("place", place)


def contents(spark: SparkSession, root: str, table: str) -> DataFrame:
    """How many commits and rows a table has of each version."""
    return committed(spark, root, table).groupBy("version").agg(F.countDistinct("commit").alias("commits"), F.count("*").alias("rows"))


def purge(spark: SparkSession, root: str, version: int) -> dict[str, int]:
    """Deletes what other versions committed; returns the number of rows by table.

    The commits' own files go first, so readers never see half of one; a purge that dies is repeated by the next, which also deletes
    folders that no commit names. So none may be written at the same time.
    """
    fs, at = _files(spark, root)
    keep = {r["commit"] for r in commits(spark, root).where(F.col("version") == version).select("commit").toLocalIterator()}
    tables = [t for t in ("runs", "entities", *FACTS) if _exists(spark, f"{root}/{t}")]
    for r in commits(spark, root).where(F.col("version") != version).collect():
        remove(spark, f"{root}/commits/{r['commit']}.json")
    gone = {}
    for table in tables:
        names = [s.getPath().getName().removeprefix("commit=") for s in fs.listStatus(_files(spark, f"{root}/{table}")[1])]
        dead = [f"{root}/{table}/commit={n}" for n in names if n not in keep]
        gone[table] = sum(spark.read.parquet(p).count() for p in dead if _exists(spark, f"{p}/_SUCCESS"))
        for path in dead:
            remove(spark, path)
    return gone
