"""Pairs of similar sets, by prefixes, places and sketches; what is left is compared in full."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.sources.steps import bounded, cut

CELLS = 2048


def sketches(tokens: str) -> Column:
    """Parities of a set's tokens in ``CELLS`` cells: two sketches differ in no more cells than the sets in tokens."""

    @F.pandas_udf("array<long>")
    def drawn(tokens: pd.Series) -> pd.Series:
        parity = lambda t: np.bincount(np.asarray(t, np.int64) & (CELLS - 1), minlength=CELLS).astype(np.uint8) & 1
        return tokens.map(lambda t: np.packbits(parity(t)).view(np.int64))

    return drawn(tokens)


def set_pairs(sets: DataFrame, percent: int, by: str) -> DataFrame:
    """sets(id, by, words: a set) -> (id, other, shared, n, m): those of equal ``by``, id < other, of which 100 * shared >= percent * the words of both together.

    Similar sets share a token among the first of each, in an order by rarity. They
    meet at such tokens if sizes and places leave room. Near copies agree in many
    tokens and would meet at each; where both have a token in common at one of the two
    places before, they met there and don't meet again. The first token in
    common has none before it, so no pair is lost. Pairs are then held against
    sketches, and last compared by their words themselves.
    """
    made = cut(sets.where(F.col(by).isNotNull()).select("id", F.transform("words", lambda x: F.xxhash64(F.col(by), x)).alias("tokens")), "sets")
    met = cut(meetings(postings(made, percent), percent), "met")
    drawn = cut(named(made, met).select("id", F.size("tokens").alias("n"), sketches("tokens").alias("sketch")), "sketches")
    side = lambda c: drawn.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    pairs = cut(met.join(side("id"), "id").join(side("other"), "other").where(near(percent)).select("id", "other"), "pairs")
    held = cut(named(sets.select("id", "words"), pairs), "held")
    j = pairs.join(held.withColumnRenamed("words", "w"), "id").join(held.select(F.col("id").alias("other"), F.col("words").alias("v")), "other")
    j = j.select("id", "other", F.size("w").alias("n"), F.size("v").alias("m"), F.size(F.array_intersect("w", "v")).alias("shared"))
    return j.where(100 * F.col("shared") >= percent * (F.col("n") + F.col("m") - F.col("shared")))


def named(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the sets that are in pairs(id, other)."""
    ids = cut(pairs.select(F.explode(F.array("id", "other")).alias("p_id")).distinct(), "named")
    return sets.join(bounded(ids), F.col("id") == F.col("p_id"), "left_semi")


def postings(made: DataFrame, percent: int) -> DataFrame:
    """made(id, tokens) -> (id, n, pos, t, t1, t2): the first tokens of each set that others have too, their places and the two before them. Written.

    A token goes by 15 bits of how many sets have it and 48 of its hash, which is
    what the order needs; two that fall together only meet once too often.
    """
    t = made.select("id", F.explode("tokens").alias("token"))
    often = t.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.shiftleft(F.least("df", F.lit((1 << 15) - 1)), 48).bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << 48) - 1)))
    first = t.join(often, "token").groupBy(F.col("id").alias("f_id")).agg(F.sort_array(F.collect_list(rank)).alias("a"))
    first = made.select("id", F.size("tokens").alias("n")).join(first, F.col("id") == F.col("f_id"))
    # tokens of one set come before all others, and need no place
    alone = F.col("n") - F.size("a")
    last = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    first = first.select("id", "n", alone.alias("alone"), F.slice("a", 1, F.greatest(last, F.lit(0))).alias("a"))
    posts = first.select("id", "n", "alone", "a", F.posexplode("a").alias("k", "t"))
    return cut(posts.select("id", "n", (F.col("alone") + F.col("k")).alias("pos"), "t", *(F.get("a", F.col("k") - b).alias(f"t{b}") for b in (1, 2))), "posts")


def meetings(posts: DataFrame, percent: int) -> DataFrame:
    """(id, other) of sets that share a token and none of the two before it, and whose sizes and places leave room."""
    one, other = (posts.select(*(F.col(c).alias(f"{c}_{x}") for c in posts.columns)) for x in "ab")
    n, m = F.col("n_a"), F.col("n_b")
    left = F.least(n - F.col("pos_a"), m - F.col("pos_b"))
    room = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m))
    again = F.coalesce(*(F.when(F.col(f"t{i}_a") == F.col(f"t{j}_b"), F.lit(True)) for i in (1, 2) for j in (1, 2)), F.lit(False))
    met = one.join(other, (F.col("t_a") == F.col("t_b")) & (F.col("id_a") < F.col("id_b")) & room & ~again)
    return met.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).distinct()


def near(percent: int) -> Column:
    """A bound: similar sets differ in at most (1 - t) / (1 + t) of their tokens together, and their sketches in no more cells."""
    apart = F.aggregate(F.zip_with("sketch_id", "sketch_other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (100 + percent) * apart <= (100 - percent) * (F.col("n_id") + F.col("n_other"))
