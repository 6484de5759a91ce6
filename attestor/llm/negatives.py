"""Hard negatives by a distributed kNN join over a Voronoi partition.

Vectors are quantised to whole numbers and scored by inner product. A further
component that brings all of them to one norm turns the largest product into the
smallest distance: |q' - x'|^2 = |q|^2 + M^2 - 2 q x for q' = (q, 0).

Rows go to the nearest of some pivots, and to a ring by their distance from it. A
cell's anchors make groups of at most ``GROUP`` rows. By the triangle inequality a
pivot's distance to an anchor and the two edges of a ring bound every score that
the anchor can have in there. So a group asks only for those rings in which a score
between one of its anchors' bounds is possible; the rows of such rings are copied to
it in blocks, and each block is joined with the group by an exact product.

Positives come in two steps. In its own cell each anchor finds enough rows of its
label to know a score that the others must reach, then the rings that can reach it
are asked. Negatives go the same way: their scores lie between the shares ``LOW`` and
``HIGH`` of a positive's, and the worst of those found in the own cell raises the
lower bound.

Blocks of a group are dealt to several tasks, by a number that follows the rows to
be met, and a block has at most ``BLOCK`` rows. So neither many copies of a vector
nor a cell that holds a third of the rows meet in one task. Vectors without
structure leave nothing to prune; then every group meets every row.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part; shorter vectors are filled up with zeros; a repeated vec_id
is as many candidates, but never its own anchor's, and its anchors' results repeat;
products are exact (in whole numbers of any size where doubles wouldn't be) and one
that doesn't fit into 64 bits ends the job; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, passing, table

STEPS = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least and at most so many hundredths of its positive's.
LOW, HIGH = 50, 95
#: Pivots: one for so many anchors, at least 8 and at most 4,096, which bounds what is sent to all tasks (cells times rings).
PER_PIVOT, MOST_PIVOTS = 512, 4_096
RINGS = 32
GROUP, BLOCK = 1_024, 2_048
#: Rows that one task meets with a group.
DEALT = 32_768


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


class Space:
    """The pivots, and what follows from them: cells, rings and bounds. Small, and the same in every task."""

    def __init__(self, pivots: np.ndarray, norm: float, dimension: int, exact: bool):
        self.pivots, self.norm, self.dimension, self.exact = pivots, norm, dimension, exact
        self.width = max(norm, 1e-9) * 2 / RINGS
        #: Bounds give way by this much, so that rounding of distances can't lose a row.
        self.slack = 1e-6 * max(norm, 1.0) ** 2
        self.rings = np.zeros(0, np.int64)

    def matrix(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.dimension))
        for k, v in enumerate(vectors):
            out[k, : len(v)] = v
        return out

    def raised(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return np.column_stack([x, rest])

    def distances(self, raised: np.ndarray) -> np.ndarray:
        square = (raised**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * raised @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and ring of each row."""
        away = self.distances(self.raised(x))
        cell = away.argmin(1)
        ring = np.minimum(np.nan_to_num(away[np.arange(len(x)), cell] / self.width), RINGS - 1).astype(np.int64)
        return cell, cell * RINGS + ring

    def asked(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which rings may hold a row whose score with one of the anchors x is between that anchor's bounds."""
        away = self.distances(np.column_stack([x, np.zeros(len(x))]))
        base = (x**2).sum(1) + self.norm**2
        need = np.zeros(len(self.rings), bool)
        for k, ring in enumerate(self.rings):
            d, inner = away[:, ring // RINGS], (ring % RINGS) * self.width
            outer = inner + self.width if ring % RINGS < RINGS - 1 else 2 * self.norm + self.width
            near = np.maximum(0, np.maximum(d - outer, inner - d))
            most, least = (base - near**2) / 2, (base - (d + outer) ** 2) / 2
            need[k] = bool((~((most + self.slack < low) | (least - self.slack > high))).any())  # so that what can't be compared is asked for
        return self.rings[need]

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact scores, as 64-bit whole numbers where they are known to fit, else as Python's."""
        if self.exact:
            return (a @ b.T).astype(np.int64)
        to = np.frompyfunc(int, 1, 1)
        return to(a).dot(to(b).T)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the allowed columns with the k largest scores, ties to the first columns: pairs (row, column) by row and rank."""
    n = scores.shape[1]
    keys = scores * n + (n - 1 - np.arange(n))  # distinct within a row
    lowest = keys.min() - 1 if keys.size else 0
    keys = np.where(allowed, keys, lowest)
    top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if k < n else np.tile(np.arange(n), (len(keys), 1))
    rows = np.arange(len(keys))[:, None]
    top = np.take_along_axis(top, np.argsort(keys[rows, top], axis=1)[:, ::-1], axis=1)
    at, rank = np.nonzero(allowed[rows, top])
    return at, top[at, rank]


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles) of the rows that take part."""
    clean = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    # floor() gives a long, so what is beyond stays as it is: a double of that size is whole
    whole = lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)
    return clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: whole(F.lit(float(STEPS)) * x.cast("double"))).alias("vector"))


def space_of(rows: DataFrame, anchor: Column) -> Space | None:
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    n, anchors, norm, top, dimension = rows.agg(F.count("*"), F.count_if(anchor), F.max(square), F.max(largest), F.max(F.size("vector"))).first()
    if not n:
        return None
    pivots = int(min(MOST_PIVOTS, max(8, anchors // PER_PIVOT)))
    chosen = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vector").collect()]
    space = Space(np.zeros((0, dimension + 1)), float(np.sqrt(norm)) * (1 + 1e-9), dimension, dimension * top * top * BLOCK < 2.0**52)
    space.pivots = space.raised(space.matrix(chosen))
    return space


def placed(rows: DataFrame, space: Space) -> DataFrame:
    """rows with their cell and ring."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf("cell int, ring long")
    def run(vectors: pd.Series) -> pd.DataFrame:
        cell, ring = shared.value.place(shared.value.matrix(vectors.to_list()))
        return pd.DataFrame({"cell": cell.astype(np.int32), "ring": ring})

    return rows.withColumn("at", run("vector")).select("vec_id", "label", "vector", "at.cell", "at.ring")


def blocks(rows: DataFrame, space: Space) -> DataFrame:
    """rows(vec_id, label, vector, ring) -> ring, ids, labels, vectors: at most ``BLOCK`` rows of one ring, by id."""
    d = space.dimension

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def pack(ring: int) -> pd.DataFrame:
            own = sorted(held.pop(ring), key=lambda r: r[0])
            x = np.zeros((len(own), d))
            for k, r in enumerate(own):
                x[k, : len(r[2])] = r[2]
            return pd.DataFrame({"ring": [ring], "n": [len(own)], "ids": [np.array([r[0] for r in own], np.int64).tobytes()], "labels": [np.array([r[1] for r in own], np.int64).tobytes()], "vectors": [x.tobytes()]})

        for b in batches:
            for r in b.itertuples(index=False):
                own = held.setdefault(r.ring, [])
                own.append((r.vec_id, r.label, r.vector))
                if len(own) == BLOCK:
                    yield pack(r.ring)
            for ring in list(held)[:-1]:  # rows come by ring, so only the last is still growing
                yield pack(ring)
        for ring in list(held):
            yield pack(ring)

    by_ring = rows.select("ring", "vec_id", "label", "vector").repartitionByRange("ring", F.xxhash64("vec_id")).sortWithinPartitions("ring")
    return by_ring.mapInPandas(run, "ring long, n int, ids binary, labels binary, vectors binary")


def join_rings(anchors: DataFrame, packed: DataFrame, space: Space, own_cell: bool, work, schema: str) -> DataFrame:
    """What ``work`` finds where each group of anchors(group, cell, vec_id, label, vector, low, high, ...) meets the blocks of the rings that it asks for.

    Of the own cell all rings are asked, or none.
    """
    shared = anchors.sparkSession.sparkContext.broadcast(space)

    def ask(key: tuple, a: pd.DataFrame) -> pd.DataFrame:
        s = shared.value
        own = s.rings // RINGS == a["cell"].iloc[0]
        if own_cell:
            rings = s.rings[own]
        else:
            rings = np.setdiff1d(s.asked(s.matrix(a["vector"].to_list()), a["low"].to_numpy(float), a["high"].to_numpy(float)), s.rings[own])
        return pd.DataFrame({"group": key[0], "ring": rings})

    wanted = cut(anchors.select("group", "cell", "vector", "low", "high").groupBy("group").applyInPandas(ask, "group long, ring long"), "wanted")
    size = packed.groupBy("ring").agg(F.sum("n").alias("rows"))
    # a group's blocks go to as many tasks as its rows need
    tasks = wanted.join(size, "ring").groupBy("group").agg(F.ceil(F.sum("rows") / DEALT).cast("int").alias("tasks"))
    wanted = cut(wanted.join(tasks, "group"), "dealt")
    sent = packed.join(bounded(wanted), "ring").withColumn("task", F.pmod(F.xxhash64("ids"), F.col("tasks")).cast("int")).select("group", "task", "ids", "labels", "vectors")
    asking = anchors.join(bounded(tasks_of(wanted)), "group").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

    def meet(key: tuple, a: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        s, out = shared.value, []
        x = s.matrix(a["vector"].to_list())
        for b in sent.itertuples(index=False):
            ids, labels = np.frombuffer(b.ids, np.int64), np.frombuffer(b.labels, np.int64)
            y = np.frombuffer(b.vectors).reshape(len(ids), -1)
            out += work(a, ids, labels, s.products(x, y))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return asking.groupBy("group", "task").cogroup(sent.groupBy("group", "task")).applyInPandas(meet, schema)


def tasks_of(wanted: DataFrame) -> DataFrame:
    return cut(wanted.select("group", "tasks").distinct(), "tasks")


def positives(a: pd.DataFrame, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[pd.DataFrame]:
    own, label = a["vec_id"].to_numpy(), a["label"].to_numpy()
    row, col = best(scores, (labels == label[:, None]) & (ids != own[:, None]), POSITIVES)
    return [pd.DataFrame({"anchor": a["anchor"].to_numpy()[row], "vec_id": ids[col], "score": scores[row, col].astype(np.int64)})]


def negatives(a: pd.DataFrame, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[pd.DataFrame]:
    label, out = a["label"].to_numpy(), []
    other = labels != label[:, None]
    for k in range(POSITIVES):
        has = a["positive"].map(lambda p, k=k: len(p) > k).to_numpy(bool)
        s = np.array([int(p[k]) if len(p) > k else 0 for p in a["positive"]], dtype=scores.dtype)[:, None]
        row, col = best(scores, other & has[:, None] & (LOW * s <= 100 * scores) & (100 * scores <= HIGH * s), NEGATIVES)
        out.append(pd.DataFrame({"anchor": a["anchor"].to_numpy()[row], "nth": k, "vec_id": ids[col], "score": scores[row, col].astype(np.int64)}))
    return out


def nearest(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of each key the k rows with the largest scores, ties to the smaller vec_id, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column) -> DataFrame:
    """rows(vec_id, label, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the rows for which ``anchor`` holds."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with passing(spark) as kept:
        whole = cut(quantised(rows), "vectors")
        space = space_of(whole, anchor)
        if space is None:
            return spark.createDataFrame([], schema)
        at = cut(placed(whole, space), "placed")
        packed = cut(blocks(at, space), "blocks")
        space.rings = np.array(sorted(r["ring"] for r in packed.select("ring").distinct().collect()), np.int64)
        # a cell's anchors in groups of about the same size, however many they are
        parts = at.where(anchor).groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        group = F.col("cell") + F.pmod(F.xxhash64("vec_id"), F.col("parts")) * F.lit(len(space.pivots))
        anchors = at.where(anchor).join(bounded(cut(parts, "parts")), "cell").select(F.monotonically_increasing_id().alias("anchor"), group.cast("long").alias("group"), "cell", "vec_id", "label", "vector")
        anchors = cut(anchors, "anchors")
        free = F.lit(float("inf"))

        # positives: first those of the own cell, then whatever may score as high as the last of these
        found_as, kind = "anchor long, vec_id long, score long", "anchor long, nth int, vec_id long, score long"
        near = cut(nearest(join_rings(anchors.withColumns({"low": -free, "high": free}), packed, space, True, positives, found_as), ["anchor"], POSITIVES), "near")
        reach = near.where(F.col("rank") == POSITIVES).select("anchor", F.col("score").cast("double").alias("low"))
        reaching = anchors.join(reach, "anchor", "left").fillna({"low": float("-inf")}).withColumn("high", free)
        far = join_rings(reaching, packed, space, False, positives, found_as)
        first = cut(nearest(near.drop("rank").unionByName(far), ["anchor"], POSITIVES), "positives")

        # negatives: the same, between shares of the positives' scores
        given = first.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("positive"))
        worst, top = F.element_at("positive", -1), F.element_at("positive", 1)
        asking = cut(anchors.join(given, "anchor").withColumns({"low": worst.cast("double") * LOW / 100, "high": top.cast("double") * HIGH / 100}), "asking")
        near = cut(nearest(join_rings(asking, packed, space, True, negatives, kind), ["anchor", "nth"], NEGATIVES), "near")
        # an anchor's lower bound rises only if all its positives have enough negatives
        full = near.where(F.col("rank") == NEGATIVES).groupBy("anchor").agg(F.count("*").alias("full"), F.min("score").cast("double").alias("raised"))
        raised = asking.join(full, "anchor", "left").withColumn("low", F.when(F.col("full") == F.size("positive"), F.greatest("low", "raised")).otherwise(F.col("low"))).drop("full", "raised")
        far = join_rings(raised, packed, space, False, negatives, kind)
        hard = nearest(near.drop("rank").unionByName(far), ["anchor", "nth"], NEGATIVES).select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        chosen = first.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = hard.join(chosen, ["anchor", "nth"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        return kept(pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", relabelled), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": OP13_SQL}
