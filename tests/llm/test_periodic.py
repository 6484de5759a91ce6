"""Runs of words against a direct search over all periods and places."""

import random
import zlib

from pyspark.sql import functions as F

from attestor.llm import periodic


def by_hand(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    runs = sorted((s, n, q) for (s, n), q in found.items())
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng, out = random.Random(5), []
    for k in range(300):
        words = [rng.choice("a b c dd".split()[: 1 + k % 4]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice("a b c dd e".split()) for _ in range(rng.randrange(1, 7))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 9)[: rng.randrange(len(unit) * 9)]
        out.append(rng.choice([" ", "\n", " \t", "\r\x0b"]).join(words))
    return [*out, None, "", " \n ", "é é " * 7, "x " * 5000, "one two " * 3, "n" * 50_000, out[0]]


def test_runs_equal_a_direct_search(spark):
    rows = [(k, t, k) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs int").repartition(3)
    got = {r["doc_id"]: r for r in periodic.periodic_runs(docs).collect()}
    assert len(got) == len(rows) and got[3]["Runs"] == 3
    for k, text, _ in rows:
        runs, collapsed = by_hand([w.decode() for w in (text or "").encode().split()])
        assert [tuple(r) for r in got[k]["runs_"]] == runs, text
        assert got[k]["collapsed"] == collapsed
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_documents_searched_together_stay_apart(spark, monkeypatch):
    few = [w.encode().split() for w in ("a b " * 4, "a b " * 4, "b a", "", "a " * 6, "a " * 6)]
    alone = [tuple(map(str, r)) for t in few for r in periodic.search([t])]
    assert [tuple(map(str, r)) for r in periodic.search(few)] == alone


def test_planted_repeats(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 90))) for k in range(400)]
    docs = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string")
    for r in periodic.planted(docs).collect():
        if r["doc_id"] is None:
            assert r["text"] == "a b"
            continue
        words, h = dict(rows)[r["doc_id"]].split(), zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        assert r["text"].split() == words


def test_an_id_that_repeats_is_a_row_each(spark):
    docs = spark.createDataFrame([(1, "a " * 9, 0), (1, "b " * 3, 0)], "doc_id long, text string, start int")
    assert sorted(len(r["runs"]) for r in periodic.periodic_runs(docs).select("doc_id", F.col("runs")).collect()) == [0, 1]
