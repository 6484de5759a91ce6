"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

A source's target is its share, by weight, of the mix. No target may be over
``max_epochs`` times what the source holds: sources over that are clamped and
what they can't take is shared among the others by weight, round after round,
until none is over. A source that must give ``r`` times its size gives every
document ``floor(r)`` times, and a seeded sample of whole documents once more.

The sample takes documents in the order of a seeded digest, long documents
first, until their sizes reach what is wanted; what long documents miss is made
up for by shorter ones, so a source ends within about half a short document.

Hot sources: positions within a source come from the sizes of its digest
buckets, so a source's rows are sorted in pieces of about ``BUCKET_ROWS``, never
as a whole.

Defined results: a null source is a source of its own; a null text or one
without words has size 0 and is taken 0 times 0 words; a source whose size is 0
has target 0; an empty table gives an empty result; rows that repeat count as
often as they occur; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, fresh, n_words, table

BUCKET_ROWS = 1024
SEED = "mix-1"


def water_fill(sources: DataFrame, total: float, max_epochs: float = 2.0) -> DataFrame:
    """sources(source, weight, source_size) -> the same with target.

    Each round is one aggregation to a single row: what the clamped sources take
    and what the others weigh. It ends when a round clamps no further source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = float("-inf"), -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        n, taken, weight = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == clamped or not weight:
            break
        clamped, level = n, (total - taken) / weight
    return sources.withColumn("target", F.when(F.lit(weight == 0) | over, cap).otherwise(F.lit(level) * F.col("weight")))


def mix(sizes: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """sizes(doc_id, source, size), targets(source, source_size, n_rows, target) -> with times and taken for each document.

    ``sizes`` is read several times and should be a written table.
    """
    t = bounded(targets.withColumnRenamed("source", "t_source"))
    buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    rows = (
        sizes.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("digest", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("short", F.col("size") * F.col("n_rows") <= 2 * F.col("source_size"))
        .withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0**32)))
    )
    line, piece = ["t_source", "short"], ["t_source", "short", "bucket"]
    sums = rows.groupBy(*piece).agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy(*line).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = bounded(sums.select(*(F.col(c).alias(f"b_{c}") for c in piece), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("offset")))
    within = Window.partitionBy(*piece).orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(sums, F.col("t_source").eqNullSafe(F.col("b_t_source")) & (F.col("short") == F.col("b_short")) & (F.col("bucket") == F.col("b_bucket")))
    placed = cut(placed.select("doc_id", F.col("t_source").alias("source"), "size", "source_size", "target", "whole", "want", "short", (F.col("offset") + F.col("upto") - F.col("size") / 2).alias("middle")), "mix")

    longs = placed.where(~F.col("short"))
    of_long = longs.groupBy("source").agg(F.sum("size").alias("long_size"))
    got = _joined(longs, bounded(of_long)).groupBy("source").agg(F.sum(F.when(F.col("middle") * F.col("source_size") < F.col("want") * F.col("long_size"), F.col("size")).otherwise(0)).alias("long_got"), F.first("long_size").alias("long_size"))
    chosen_long = F.col("middle") * F.col("source_size") < F.col("want") * F.col("long_size")
    chosen = F.when(F.col("short"), F.col("middle") < F.col("want") - F.coalesce("long_got", F.lit(0))).otherwise(chosen_long)
    times = F.col("whole") + F.coalesce(chosen, F.lit(False)).cast("long")
    return _joined(placed, bounded(got), "left").select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on source, null included."""
    right = right.withColumnRenamed("source", "r_source")
    return left.join(right, left["source"].eqNullSafe(right["r_source"]), how).drop("r_source")


def by_cycle(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """A source's size, rows and weight; weights repeat over the sources by code point, null last. One row a source is numbered, not the documents."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))


def mix_documents(docs: DataFrame, epochs: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """The mix of ``docs``(doc_id, text, source) whose size is ``epochs`` times theirs, in words."""
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    sources = cut(by_cycle(sizes), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    return mix(sizes, water_fill(sources, epochs * total, max_epochs))


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it. Rows of one doc_id go as often as the one that goes most.

    A null doc_id is an id like others and a null source a source; null, empty
    and wordless texts have size 0 and go by their source's whole repetitions only; an empty
    table stays empty; other columns, whatever their names, are handed on.
    """
    own, n, each = (fresh(c, docs.columns) for c in ("taken_id", "times", "copy"))
    times = mix_documents(docs).groupBy(F.col("doc_id").alias(own)).agg(F.max("times").cast("int").alias(n))
    times = cut(times.where(F.col(n) > 0), "times")
    taken = docs.join(bounded(times), docs["doc_id"].eqNullSafe(F.col(own)))
    return taken.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


def mixing_sql(docs: str = "documents") -> str:
    return f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
total AS (SELECT 1.5 * sum(source_size)::DOUBLE AS t, sum(weight) AS w FROM weighed),
steps AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
  coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
clamps AS (SELECT steps.*, cap <= (t - cap_before) / (w - weight_before) * weight AS clamped FROM steps, total),
water AS (SELECT (any_value(t) - coalesce(sum(cap) FILTER (clamped), 0)) / nullif(any_value(w) - coalesce(sum(weight) FILTER (clamped), 0), 0) AS level FROM clamps, total),
targets AS (SELECT source, source_size, n_rows, CASE WHEN clamped OR level IS NULL THEN cap ELSE level * weight END AS target FROM clamps, water),
rows_ AS (SELECT doc_id, s.source, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest, size * n_rows <= 2 * source_size AS short
  FROM sizes s JOIN targets g ON s.source IS NOT DISTINCT FROM g.source),
placed AS (SELECT *, target - whole * source_size AS want, sum(size) OVER (PARTITION BY source, short ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM rows_),
longs AS (SELECT source, sum(size) AS long_size FROM placed WHERE NOT short GROUP BY source),
got AS (SELECT p.source, any_value(long_size) AS long_size, sum(size) FILTER (middle * source_size < want * long_size) AS long_got
  FROM placed p JOIN longs l ON p.source IS NOT DISTINCT FROM l.source WHERE NOT short GROUP BY p.source),
final AS (SELECT p.*, whole + coalesce(CASE WHEN short THEN middle < want - coalesce(long_got, 0) ELSE middle * source_size < want * long_size END, false)::INT AS times
  FROM placed p LEFT JOIN got g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, times::BIGINT AS times FROM final"""


QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": mixing_sql()}
