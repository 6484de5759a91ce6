"""Line deduplication with two Bloom filters: only lines that may repeat are shuffled.

A line's key is the line without gaps at its ends, A-Z in lower case. Keys of at
least ``MIN_CHARS`` code points that ``MIN_DOCS`` documents hold lose their lines
everywhere but in the document with the largest doc_id.

Every task sets each document's keys in a pair of filters: bits set once, and bits
set by two or more. Pairs merge without order: what either has twice or both have
once is twice. No key is lost by that, as each of a repeated key's bits ends up in
the second filter. The filters are cut into pages by the hash's first bits. What a
task sends of a page is the places of its bits, so a merging task holds a page
and what was sent of it, whatever the number of tasks; the number of pages follows
the number of lines, at ``BITS_PER_LINE``.

Then each line is tested against the second filter. Pages of at most ``FILTER_MB``
together are sent to all tasks, and lines that aren't in them go no further.
Beyond that the tests are a join by page, and digests of all lines are shuffled.

What is left is confirmed exactly: 128-bit BLAKE2 digests of the keys are counted
by document, with partial counts, so a key that is everywhere costs a row a task.
Lines to drop are gathered by document and texts meet them once.

Defined results: a null or empty text is one empty line and stays empty; a row is a
document, also if rows or ids repeat (equal rows have equal results, and a key stays
in all rows with its largest doc_id); a null doc_id is smaller than any; lines are
parted by \\n alone, so a \\r is a gap of its line; an empty table gives an empty
result; other columns are handed on, and new ones get an underscore where a name is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, fresh, passing, table

MIN_CHARS, MIN_DOCS = 20, 3
#: A page has 2^PAGE_BITS bits, a key two of them; a line that is alone is then suspected once in some 70 times.
BITS_PER_LINE, PAGE_BITS = 16, 22
PAGE = 1 << PAGE_BITS
#: Size of the second filter up to which it is sent to all tasks.
FILTER_MB = 64
#: Hashes that a task gathers before it writes down their bits.
TOGETHER = 1 << 20


def keys_of(text: bytes | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Numbers and keys of a text's lines whose keys are long enough."""
    for at, line in enumerate((text or b"").lower().split(b"\n")):  # bytes: A-Z only, and strip() takes space, \t, \n, \v, \f and \r
        key = line.strip()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            yield at, key


def places(hashes: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each 64-bit hash, counted through all pages: page * 2^22 + place."""
    page = ((hashes >> np.uint64(44)) * np.uint64(pages)) >> np.uint64(20)
    base = (page << np.uint64(PAGE_BITS)).astype(np.int64)
    mask = np.uint64(PAGE - 1)
    return base + (hashes & mask).astype(np.int64), base + ((hashes >> np.uint64(PAGE_BITS)) & mask).astype(np.int64)


def page_count(docs: DataFrame) -> int:
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)) + 1
    n = docs.agg(F.coalesce(F.sum(lines), F.lit(0))).first()[0]
    return max(1, min(1 << 20, -(-n * BITS_PER_LINE // PAGE)))


def repeated_pages(docs: DataFrame, pages: int, min_chars: int) -> DataFrame:
    """docs(text) -> page, bits (of the filter of what two or more documents set, as longs); pages without such bits are left out."""

    def parts(hashes: list[int]) -> pd.DataFrame:
        a, b = places(np.array(hashes, np.uint64), pages)
        bits, n = np.unique(np.concatenate([a, b[a != b]]), return_counts=True)
        page = bits >> PAGE_BITS
        begin = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
        rows = []
        for lo, hi in zip(begin, np.append(begin[1:], len(bits)), strict=True):
            place = (bits[lo:hi] & (PAGE - 1)).astype(np.uint32)
            rows.append((int(page[lo]), place.tobytes(), place[n[lo:hi] > 1].tobytes()))
        return pd.DataFrame(rows, columns=["page", "once", "twice"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = []
        for b in batches:
            for text in b["text"]:
                held += {xxhash.xxh64_intdigest(key) for _, key in keys_of(text, min_chars)}
                if len(held) >= TOGETHER:
                    yield parts(held)
                    held = []
        if held:
            yield parts(held)

    def merge(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(PAGE, bool), np.zeros(PAGE, bool)
        for once, twice in zip(sent["once"], sent["twice"], strict=True):
            place = np.frombuffer(once, np.uint32)
            again[place[seen[place]]] = True
            seen[place] = True
            again[np.frombuffer(twice, np.uint32)] = True
        if not again.any():
            return pd.DataFrame({"page": [], "bits": []})
        return pd.DataFrame({"page": [key[0]], "bits": [np.packbits(again, bitorder="little").view(np.int64)]})

    sent = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(run, "page int, once binary, twice binary")
    return sent.groupBy("page").applyInPandas(merge, "page int, bits array<long>")


def digests(key: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def suspected(docs: DataFrame, pages: int, min_chars: int, filter_mb: float) -> DataFrame:
    """docs(doc_id, text) -> doc_id, version (of the text), line, first (the key's first line in the text), k1, k2 of lines that may repeat in others."""
    twice = cut(repeated_pages(docs, pages, min_chars), "pages")
    small = pages * PAGE / 8 <= filter_mb * (1 << 20)
    known = None
    if small:
        bits = np.zeros((pages, PAGE // 64), np.int64)
        for r in twice.toLocalIterator():
            bits[r["page"]] = r["bits"]
        known = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1).view(np.uint64))

    @F.pandas_udf("line array<int>, first array<boolean>, k1 array<long>, k2 array<long>, page array<int>, a array<int>, b array<int>")
    def tested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lines, hashes, keys, row = [], [], [], []
            for k, text in enumerate(texts):
                for at, key in keys_of(text, min_chars):
                    row.append(k)
                    lines.append(at)
                    hashes.append(xxhash.xxh64_intdigest(key))
                    keys.append(key)
            a, b = places(np.array(hashes, np.uint64), pages)
            on = np.arange(len(row))
            if known is not None:
                has = lambda p: (known.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
                on = np.flatnonzero((has(a) & has(b)).astype(bool))
            row = np.array(row, np.int64)[on]
            ks = np.array([digests(keys[i]) for i in on], np.int64).reshape(-1, 2)
            order = np.lexsort((on, ks[:, 1], ks[:, 0], row))
            again = (row[order][1:] == row[order][:-1]) & (ks[order][1:] == ks[order][:-1]).all(1)
            first = np.ones(len(on), bool)
            first[order[1:]] = ~again
            bounds = np.searchsorted(row, np.arange(1, len(texts)))
            of = {"line": np.array(lines, np.int32)[on], "first": first, "k1": ks[:, 0], "k2": ks[:, 1], "page": (a[on] >> PAGE_BITS).astype(np.int32), "a": (a[on] & (PAGE - 1)).astype(np.int32), "b": (b[on] & (PAGE - 1)).astype(np.int32)}
            yield pd.DataFrame({c: pd.Series(np.split(v, bounds) if len(texts) else [], dtype=object) for c, v in of.items()})

    versioned = docs.select("doc_id", F.xxhash64("text").alias("version"), tested(F.col("text").cast("binary")).alias("t"))
    names = ["line", "first", "k1", "k2", *([] if small else ["page", "a", "b"])]
    found = versioned.select("doc_id", "version", F.inline(F.arrays_zip(*(F.col(f"t.{c}") for c in names))))
    if not small:
        on = lambda p: F.getbit(F.element_at("bits", F.shiftright(p, 6) + 1), F.col(p).bitwiseAND(63)) == 1
        found = found.join(twice, "page").where(on("a") & on("b")).drop("page", "a", "b")
    return found


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_mb: float = FILTER_MB) -> DataFrame:
    """All columns of docs(doc_id, text), the text without the lines that go, with n_lines (before) and n_dropped."""
    n_lines, n_dropped = fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)
    version, d_id, d_version, gone = (fresh(c, [*docs.columns, n_lines, n_dropped]) for c in ("_version", "_d_id", "_d_version", "_gone"))
    spark = docs.sparkSession
    with passing(spark) as kept:
        own = docs.select("doc_id", "text")
        lines = cut(suspected(own, page_count(own), min_chars, filter_mb), "suspected")
        repeated = lines.where("first").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
        repeated = bounded(cut(repeated.select("k1", "k2", "keeper"), "repeated")) if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "string") else cut(repeated.select("k1", "k2", "keeper"), "repeated")
        others = lines.join(repeated, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        drops = kept(others.groupBy(F.col("doc_id").alias(d_id), F.col("version").alias(d_version)).agg(F.collect_set("line").alias(gone)))

    @F.pandas_udf("string")
    def without(text: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for t, ls in zip(text, lines, strict=True):
            leave = set() if t is None else set(ls.tolist())
            out.append(None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in leave))
        return pd.Series(out, dtype=object)

    # texts are hashed by the lines to drop, not sorted
    met = docs.withColumn(version, F.xxhash64("text")).join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(d_id)) & (F.col(version) == F.col(d_version)), "left")
    text = F.coalesce("text", F.lit(""))
    size = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    left = F.coalesce(without(F.when(F.col(gone).isNotNull(), F.col("text")), F.col(gone)), F.col("text"))
    same = [left.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return met.select(*same, size.alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH line AS (SELECT doc_id, k, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
repeated AS (SELECT key, max(doc_id) AS keeper FROM line WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT line.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM line LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": OP11_SQL}
