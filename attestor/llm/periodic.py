"""Periodic runs of words, by Karp, Miller and Rosenberg's names for stretches of 2^k words.

A run is a stretch of words with smallest period q that is at least ``TIMES`` * q
words long and that no neighbouring word extends. Two stretches of 2^k words are
equal if they have one name; a level's names are ranks of pairs of names of the
level below, and only stretches whose halves both occur elsewhere are ranked at
all, so the levels thin out quickly and end where every stretch is unique.

Of a run with period p and at least 4 p words, the first multiple of p in it,
together with the next, begins two equal stretches of 2 p words, and the multiple
before doesn't. So for each p one comparison of the names at the multiples of p
gives the candidates, one for each run. They are extended to both sides by
descending name levels. No word is hashed into a fingerprint and no suffix is sorted.

Documents are taken together, each closed by a word of its own that equals no
other, until they have ``TOGETHER`` words; then all of them share the NumPy calls.
A document is worked on by one task and nothing is shuffled; memory follows the
longest document.

Defined results: a null, empty or blank text has no runs and an empty collapsed
text; equal texts have equal results; an empty table gives an empty result; other
columns are handed on, and new ones get an underscore where a name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, table

MIN_WORDS = 6
#: How often the period fits into a run at least; the grid of candidates needs 4 or more.
TIMES = 4
#: Words of the documents that are searched together.
TOGETHER = 200_000


def ranked(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names for n places: below n and shared where codes are equal, n + place (its own) elsewhere."""
    out = np.arange(n, 2 * n)
    order = np.argsort(codes)
    in_order = codes[order]
    new = np.append(True, in_order[1:] != in_order[:-1]) if len(codes) else np.zeros(0, bool)
    rank = np.cumsum(new) - 1
    shared = np.bincount(rank)[rank] > 1 if len(codes) else new
    out[at[order[shared]]] = rank[shared]
    return out


def name_levels(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Level k names the stretches of 2^k words; the last level is the highest that has two equal stretches (level 0 is always there)."""
    n = len(words)
    levels = [ranked(words, np.arange(n), n)]
    while 2 << (len(levels) - 1) <= longest:
        below, half = levels[-1], 1 << (len(levels) - 1)
        at = np.flatnonzero((below[: n - half] < n) & (below[half:] < n))
        above = ranked(below[at] * n + below[at + half], at, n)
        if not (above < n).any():
            break
        levels.append(above)
    return levels


def extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words after (from) and before the places a and b are equal."""
    after, before = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        after += (name[a + after] == name[b + after]).astype(np.int64) << k
        left = a - before - (1 << k)
        before += ((left >= 0) & (name[np.maximum(left, 0)] == name[np.maximum(left, 0) + b - a])).astype(np.int64) << k
    return after, before


def find_runs(words: np.ndarray, longest: int, min_words: int = MIN_WORDS, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start and period; ``words`` are numbers, those that close a document occur once, the last closes one."""
    levels = name_levels(words, longest)
    places, periods = [], []
    for p in range(1, longest // times + 1):
        k = (2 * p).bit_length() - 1  # p < 2^k <= 2 p
        if k >= len(levels):
            break
        grid = levels[k][::p]
        hit = np.flatnonzero(grid[1:] == grid[:-1])
        if len(hit):
            hit = hit[np.append(True, hit[1:] - hit[:-1] > 1)]
            places.append(hit * p)
            periods.append(np.full(len(hit), p))
    if not places:
        return (np.zeros(0, np.int64),) * 3
    at, p = np.concatenate(places), np.concatenate(periods)
    after, before = extend(levels, at, at + p)
    start, end = at - before, at + p + after
    long = end - start >= np.maximum(min_words, times * p)
    start, end, p = start[long], end[long], p[long]
    # a stretch is found under multiples of its period too; periods ascend, so the first is the smallest
    first = np.unique(start * (len(words) + 1) + end, return_index=True)[1]
    order = first[np.lexsort((p[first], start[first]))]
    return start[order], end[order], p[order]


def search(texts: list[list[bytes]], min_words: int = MIN_WORDS, times: int = TIMES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
    """For each list of words its runs (starts, lengths, periods) and the words that stay, joined by spaces."""
    number: dict[bytes, int] = {}
    ids, ends = [], []
    for k, words in enumerate(texts):
        ids += [number.setdefault(w, len(number)) for w in words]
        ids.append(-k - 1)
        ends.append(len(ids))
    begins = np.append(0, ends[:-1]).astype(np.int64)
    start, end, p = find_runs(np.array(ids, np.int64), max(map(len, texts)), min_words, times)
    edge = np.bincount(start + p, minlength=len(ids) + 1) - np.bincount(end, minlength=len(ids) + 1)
    gone = np.cumsum(edge) > 0
    bound = np.searchsorted(start, np.append(begins, len(ids)))
    for k, words in enumerate(texts):
        own = slice(bound[k], bound[k + 1])
        if bound[k] < bound[k + 1]:
            words = [words[i] for i in np.flatnonzero(~gone[begins[k] : begins[k] + len(words)])]
        yield start[own] - begins[k], end[own] - start[own], p[own], b" ".join(words).decode("utf-8", "replace")


def _columns(min_words: int, times: int):
    @F.pandas_udf("starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found, held, size = [], [], 0
            for t in texts:
                held.append(t.split() if t else [])  # bytes.split() takes space, \t, \n, \v, \f and \r for gaps
                size += len(held[-1])
                if size >= TOGETHER:
                    found += search(held, min_words, times)
                    held, size = [], 0
            if held:
                found += search(held, min_words, times)
            yield pd.DataFrame(found, columns=["starts", "lengths", "periods", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """All columns of docs(text), with runs (array of start, length, period; by start, then period) and collapsed (the text without what a run repeats)."""
    if times < 4:
        raise ValueError("candidates come from a grid that finds runs of at least four periods")
    found, runs = fresh("_found", docs.columns), fresh("runs", docs.columns)
    collapsed = fresh("collapsed", [*docs.columns, runs])
    at = F.col(found)
    zipped = F.transform(F.arrays_zip(at["starts"], at["lengths"], at["periods"]), lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")))
    searched = docs.withColumn(found, _columns(min_words, times)(F.col("text").cast("binary")))
    return searched.select(*docs.columns, zipped.alias(runs), at["collapsed"].alias(collapsed))


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which one document in ten repeats a stretch to its end; documents without doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n, a, p, w = F.floor(F.col("h") / 10), F.col("n"), F.col("a"), F.col("p"), F.col("words")
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    repeated = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i))))
    shaped = docs.select("doc_id", "text", h.alias("h"))
    shaped = shaped.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    shaped = shaped.withColumn("n", F.when(F.size("words") > 0, F.size("words").cast("long")))
    shaped = shaped.withColumn("a", g % n).withColumn("p", 1 + F.floor((n - a) / (3 + g % 8)))
    return shaped.select("doc_id", F.coalesce(F.when(n.isNotNull(), repeated), F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(planted(docs))
    best = F.aggregate("runs", F.expr("CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"), lambda b, r: F.when(b.isNull() | (r["length"] > b["length"]), r).otherwise(b))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return found.select("doc_id", "collapsed", "runs", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words q apart; an unbroken row of them is a stretch with period q. The CRC-32 is made bit by bit from its polynomial.
OP12_SQL = r"""
WITH RECURSIVE crc_byte(b, c, k) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_byte WHERE k < 8),
crc_table AS (SELECT b, c FROM crc_byte WHERE k = 8),
crc(doc_id, s, k, c) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, k + 1, xor(crc.c >> 8, t.c) FROM crc JOIN crc_table t ON t.b = xor(crc.c, ascii(substr(s, k + 1, 1))) & 255 WHERE k < length(s)),
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
seeded AS (SELECT d.doc_id, d.ws, len(d.ws) AS n, xor(c.c, 4294967295) AS h FROM split d JOIN crc c ON c.doc_id = d.doc_id AND c.k = length(c.s)),
shaped AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM seeded),
cut AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM shaped),
word AS (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM cut)),
pair AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
listed AS (SELECT doc_id, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, max(length) AS length, arg_min(period, (-length, start, period)) AS period,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM run GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS said FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(l.said, '')) AS runs_sha256, sha256(coalesce(k.said, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES = {"op12_periodic_runs": OP12_SQL}
