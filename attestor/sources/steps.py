"""Steps written to the folder that the cluster shares, so that what follows reads files and not the plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is to be deleted, by the thread or task that wrote it.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; where that is unset, a temporary one on a single machine (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps read the files and not the plan, so a lost executor costs one
    task's reading, and a step that is used twice is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    if _written.get():
        _written.get()[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deals rows over three tasks a core: a narrow table is a few files, so what each of its rows costs much would run in as few tasks."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *by)


def shares(df: DataFrame, *by: str, rows: int = 500_000) -> DataFrame:
    """Deals rows over as many tasks as keep each at about so many, so that what a task holds doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *by)


def fits(df: DataFrame, megabytes: int = 32) -> bool:
    """Whether a written table's rows take at most so much as Spark holds them.

    Numbers have a known width, strings are measured; tables with arrays are refused.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wide = [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType | T.BooleanType | T.StringType)]
    if wide:
        raise ValueError(f"the width of {wide} is not known")
    room, row = megabytes << 20, 16 + 8 * len(df.columns)
    chars = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    n, more = df.limit(room // row + 1).agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    return n * row + more <= room


def bounded(df: DataFrame, megabytes: int = 32) -> DataFrame:
    """Marks a written table for broadcast if it fits; beyond that it joins by shuffle."""
    return F.broadcast(df) if fits(df, megabytes) else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Steps cut inside are deleted at the end, but for what the given function writes: ``with passing(spark) as kept: ... result = kept(df)``."""
    paths: list[str] = []
    before = _written.get()
    _written.set((*before, paths))

    def kept(df: DataFrame) -> DataFrame:
        inside = _written.get()
        _written.set(before)
        try:
            return cut(df, "kept")
        finally:
            _written.set(inside)

    try:
        yield kept
    finally:
        _written.set(before)
        for path in paths:
            remove(spark, path)
