"""Repeated lines against a dictionary of keys, with the filter sent to all tasks and joined by page."""

import random
import string
from collections import defaultdict

import pytest

from attestor.llm import line_dedup

GAPS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def by_hand(rows):
    key = lambda line: line.strip(GAPS).translate(LOWER)
    holders = defaultdict(list)
    for k, text in rows:
        for x in {key(x) for x in (text or "").split("\n")}:
            holders[x].append(k)
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        less = lambda a, b: a is not None and (b is None or a < b)
        last = lambda ks: max((x for x in ks if x is not None), default=None)
        gone = lambda x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and last(holders[key(x)]) != k
        stay = [x for x in lines if not gone(x)]
        out.append((k, text if len(stay) == len(lines) else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def rows():
    rng = random.Random(3)
    pool = [f"a line of some length {k}" for k in range(30)] + ["short", "", "exactly twenty chars", "nineteen characters", "é" * 19, "é" * 20, "Ünïcode İ line of length", "ünïcode i̇ line of length"]
    vary = lambda x: rng.choice(["", " ", "\t\r", "\x0b"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "])
    out = [(k, "\n".join(vary(rng.choice(pool[: rng.choice([3, 38])])) for _ in range(rng.randrange(12)))) for k in range(60)]
    out += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 100_000), (104, "x" * 100_000), (105, "x" * 100_000)]
    out += [(k, "everywhere in all of them\nown line number %d of it" % k) for k in range(200, 500)]
    return [*out, out[0], (200, "another text with this id\neverywhere in all of them"), (None, "everywhere in all of them\nleft"), (2**60 + 1, "everywhere in all of them")]


@pytest.mark.parametrize("filter_mb", [64, 0])
def test_lines_equal_a_dictionary(spark, filter_mb):
    docs = spark.createDataFrame([(*r, 7, "y") for r in rows()], "doc_id long, text string, n_lines int, Version string").repartition(5)
    got = line_dedup.drop_lines(docs, filter_mb=filter_mb)
    assert got.columns == ["doc_id", "text", "n_lines", "Version", "n_lines_", "n_dropped"]
    have = sorted(((r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"]) for r in got.collect()), key=repr)
    assert have == sorted(by_hand(rows()), key=repr)


def test_no_repeated_key_escapes_the_filter(spark):
    docs = spark.createDataFrame([(k, "\n".join(f"line number {j} of a document" for j in range(k % 7, 400, 7))) for k in range(21)], "doc_id long, text string").repartition(6)
    for pages in (1, 3):
        found = line_dedup.suspected(docs, pages, 20, 64)
        assert found.select("k1", "k2").distinct().count() == 400


def test_no_documents(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
