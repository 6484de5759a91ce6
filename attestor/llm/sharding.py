"""Sharding by histogram sort: shards of near equal bytes, found before anything moves.

Documents are sorted by a 64-bit key: the CRC-32 of the text, then 31 bits of a
hash of doc_id. So equal texts lie together, and a text that fills more than a
shard is still split between documents.

The splitters are found by counting. Each round sends candidate boundaries to
all partitions, which add up the exact bytes below each; the sums tell between
which two candidates every splitter lies, and the next round's candidates
divide that gap. Only key and size are read, and a round gives one number for
each candidate. It ends when every splitter is within the tolerance or its gap
holds no further key. Then the rows move once.

Slots are numbered in several tasks: rows are counted by the first bits of their
key, and by more bits where many share these; the counts before a leaf, plus the
place within it, give the slot. All that is done by joins; the driver sees the
candidates for the splitters between shards and nothing else, whatever the size.

Defined results: a null text has size 16 and the CRC-32 of the empty text; a
null doc_id is hashed as null; rows with equal keys stay together, whatever
their number, and are numbered one after the other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, fresh, table

OVERHEAD = 16
#: Candidates between two known boundaries in one round.
PROBES = 15
MAX_ROUNDS = 20
#: A splitter is met within this part of a shard's bytes.
TOLERANCE = 0.002
#: Rows beyond which a leaf is divided by further bits of the key, and the bits that each step adds up to.
LEAF_ROWS = 500_000
KEY_BITS = 63
LEAF_BITS = (16, 32, 42, 52)
LAW = "bytes"


def sort_key(text_crc32: Column, doc_id: Column) -> Column:
    return F.shiftleft(text_crc32, 31).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(0x7FFFFFFF)))


def bytes_below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys(key, size) -> the bytes and rows with a key below each of the sorted probes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b["key"].to_numpy(), side="right")
            np.add.at(size, at, b["size"].to_numpy())
            rows += np.bincount(at, minlength=len(probes) + 1)
        on = np.flatnonzero(rows)
        yield pd.DataFrame({"gap": on, "size": size[on], "rows": rows[on]})

    found = keys.mapInPandas(run, "gap int, size long, rows long").groupBy("gap").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in found:
        size[r["gap"]], rows[r["gap"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, aims: np.ndarray, total: int, tolerance: float) -> np.ndarray:
    """For each of the aimed byte counts, the key below which nearest to that many bytes lie."""
    low, high = np.zeros(len(aims), np.int64), np.full(len(aims), np.iinfo(np.int64).max)
    low_b, high_b = np.zeros(len(aims)), np.full(len(aims), float(total))
    low_r, high_r = np.zeros(len(aims)), np.full(len(aims), np.inf)
    for n in range(MAX_ROUNDS):
        near = np.minimum(np.abs(low_b - aims), np.abs(high_b - aims))
        open_ = (near > tolerance) & (high - low > 1) & (high_b > low_b) & (high_r - low_r > 1)
        if not open_.any():
            break
        if n + 1 == MAX_ROUNDS:
            raise RuntimeError("the splitters are not found; each round divides the open gaps by 16, so this can't be")
        # candidates divide each open gap; the first round's gap is the whole range, so it is divided for all at once
        step = np.arange(1, PROBES + 1) / (PROBES + 1)
        guess = (low[open_, None] + (high[open_] - low[open_])[:, None] * step).astype(np.int64)
        if n == 0:
            guess = (np.arange(1, len(aims) * 8) / (len(aims) * 8) * np.iinfo(np.int64).max).astype(np.int64)
        probes = np.unique(np.clip(guess.ravel(), 1, None))
        below, rows = bytes_below(keys, probes)
        for k in np.flatnonzero(open_):
            at = int(np.searchsorted(below, aims[k], side="right"))  # probes before `at` have at most the aim below them
            if at > 0 and probes[at - 1] > low[k]:
                low[k], low_b[k], low_r[k] = probes[at - 1], below[at - 1], rows[at - 1]
            if at < len(probes) and probes[at] < high[k]:
                high[k], high_b[k], high_r[k] = probes[at], below[at], rows[at]
    return np.where(np.abs(low_b - aims) <= np.abs(high_b - aims), low, high)


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, tolerance: float = TOLERANCE, leaf_rows: int = LEAF_ROWS, row: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, shard and slot; and column ``row`` of ``docs``, if it is named."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = [F.col(row)] if row else []
    keys = docs.select(*own, "doc_id", (F.length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("key", sort_key(F.col("text_crc32"), F.col("doc_id")))
    keys = cut(keys, "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = total / n_shards
    cuts = np.sort(splitters(keys.select("key", "size"), share * np.arange(1, n_shards), total, tolerance * share))
    at = sum(((F.col("key") >= int(c)).cast("int") for c in cuts), F.lit(0))
    placed = keys.withColumn("shard", at)

    # leaves: keys by their first bits, and by more of them where that many rows have these in common
    leaf = F.lit(0).cast("long")
    for k, bits in enumerate(LEAF_BITS):
        begin = F.shiftleft(F.shiftright("key", KEY_BITS - bits), KEY_BITS - bits)
        placed = placed.withColumn("leaf", begin if k == 0 else F.when(F.col("heavy").isNotNull(), begin).otherwise(F.col("leaf"))).drop("heavy")
        if k + 1 < len(LEAF_BITS):
            heavy = placed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows)
            placed = placed.join(bounded(cut(heavy.select(F.col("leaf").alias("heavy")), "heavy")), F.col("leaf") == F.col("heavy"), "left")
    counts = placed.groupBy("shard", "leaf").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = cut(counts.select(F.col("shard").alias("l_shard"), F.col("leaf").alias("l_leaf"), ahead.alias("first")), "leaves")
    placed = placed.join(bounded(first), (F.col("shard") == F.col("l_shard")) & (F.col("leaf") == F.col("l_leaf")))
    slot = F.row_number().over(Window.partitionBy("shard", "leaf").orderBy("key", "doc_id")) - 1 + F.col("first")
    return placed.select(*own, "doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Writes the rows of ``docs`` below one folder for each shard, in the order of their slots within each file.

    Rows are numbered, so repeated and null ids are rows like others; a column
    of ``docs`` that is called shard, in any case, is refused, as that names the folders.
    """
    if fresh("shard", docs.columns) != "shard":
        raise ValueError("documents have a column shard already")
    own = fresh("_row", docs.columns)
    numbered = cut(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    slot, other = fresh("slot", docs.columns), fresh("_other", docs.columns)
    places = shard_by_bytes(numbered.select(F.col(own).alias("row"), "doc_id", "text"), n_shards, row="row").select(F.col("row").alias(other), "shard", F.col("slot").alias(slot))
    joined = numbered.join(places, F.col(own) == F.col(other)).select(*docs.columns, "shard", slot)
    # a shard goes to several tasks, by ranges of slots, so none of them has to hold it whole
    joined.repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_by_bytes(table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
