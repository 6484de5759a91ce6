"""Pairs of similar sets against brute force, and how often near copies meet."""

from __future__ import annotations

import random

from attestor.operators import similar

SETS = "id long, source string, words array<string>"


def test_set_pairs_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{min(rng.randrange(900), rng.randrange(900))}"
    rows = []
    for n, size, edits in ((16, 60, 6), (14, 200, 22), (9, 5, 1), (10, 1200, 125)):
        start = [word() if size < 900 else f"v{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(n):
            copy = list(start)
            for k in rng.sample(range(size), edits):
                copy[k] = word()
            rows.append((len(rows), rng.choice("ab"), sorted(set(copy))))
    rows += [(500 + k, "a", [word() for _ in range(1)] + ["x", "y"]) for k in range(20)] + [(600, None, rows[0][2]), (601, None, rows[0][2])]
    rows = [(i, s, sorted(set(w))) for i, s, w in rows]
    got = sorted(tuple(r[c] for c in ("id", "other", "shared", "n", "m")) for r in similar.set_pairs(spark.createDataFrame(rows, SETS), 65, "source").collect())
    want = []
    for i, s, w in rows:
        for j, z, v in rows:
            both = len({*w} & {*v})
            if i < j and s == z and s is not None and 100 * both >= 65 * (len(w) + len(v) - both):
                want.append((i, j, both, len(w), len(v)))
    assert got == sorted(want) and len(got) > 50


def test_near_copies_do_not_meet_at_each_token(spark):
    rows = [(k, "a", [f"w{n}" for n in range(300)] + [f"own{k}"]) for k in range(20)]
    made = spark.createDataFrame(rows, SETS).selectExpr("id", "transform(words, x -> xxhash64(x)) AS tokens")
    posts = similar.postings(made, 65)
    joined = posts.alias("a").join(posts.alias("b"), "t").where("a.id < b.id").count()
    assert joined > 19_000 and similar.meetings(posts, 65).count() == 190
    again = posts.where("t1 IS NULL").count()
    assert again == 20  # the only places where these meet
