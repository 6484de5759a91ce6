"""Merging repeated observations: entities, mentions, indicators, observed fields.

Order is a column. Three merges of entities differ on purpose: within a run the
first confidence stays; stored entities take the last one; details of duplicates
are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tags() -> Column:
    return F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags")


def merge_entities(seen: DataFrame) -> DataFrame:
    """Within a run: first values, last sight, union of tags; the confidence of the first sight stays."""
    return seen.groupBy("entity").agg(F.min_by("confidence", "ord").alias("confidence"), F.min_by("source", "ord").alias("source"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), _tags(), F.count("*").alias("seen"))


def upsert_entities(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored and new (entity, ord, ts, confidence, source, tag): a stored entity takes the last confidence and sight, and keeps the rest."""
    both = stored.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    order = F.struct("new", "ord")
    return both.groupBy("entity").agg(F.max_by("confidence", order).alias("confidence"), F.min_by("source", order).alias("source"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), (F.min("new") == 1).alias("inserted"))


def dedupe_mentions(mentions: DataFrame, keys: list[str], cap: int = 5, per: str = "provider") -> DataFrame:
    """The first mention of each key, with all its sources; then the first ``cap`` of each provider. Repeats don't use up the cap."""
    first = mentions.groupBy(*keys).agg(F.min("ord").alias("ord"), F.min_by(per, "ord").alias(per), F.array_join(F.array_sort(F.collect_set(per)), ",").alias("sources"), F.count("*").alias("repeats"))
    place = F.row_number().over(Window.partitionBy(per).orderBy("ord"))
    return first.withColumn("place", place).where(F.col("place") <= cap)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by aggregation: no sort, and partial results before the shuffle."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in cols))


def shared(column: str) -> Column:
    """A value that all rows of a group have; null if they differ or one lacks it."""
    return F.when((F.count_distinct(F.col(column)) == 1) & (F.count(column) == F.count("*")), F.max(column))


def project_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Observed items as one field: distinct values in order of first sight, details that all share, the newest instant."""
    firsts = items.groupBy(*keys, "value").agg(F.min("ord").alias("first"))
    values = firsts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]), ",").alias("values"))
    method = F.when(F.count("method") < F.count("*"), None).when(F.count_distinct(F.col("method")) > 1, "MIXED").otherwise(F.max("method"))
    details = items.groupBy(*keys).agg(shared("source").alias("source"), method.alias("method"), F.max("ts").alias("observed_at"), F.count("*").alias("n"))
    return values.join(details, keys)


def consensus(rows: DataFrame, keys: list[str], value: str, ord_: str, least: int = 2) -> DataFrame:
    """The most frequent value without regard to case, in its first spelling, if ``least`` rows have it; ties to the first seen."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.lower(value).alias("v")).agg(F.count("*").alias("n"), F.min(ord_).alias("first"), F.min_by(value, ord_).alias("spelling"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("spelling", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.where(F.col("b.n") >= least).select(*keys, F.col("b.spelling").alias(value), F.col("b.n").alias("n"))
