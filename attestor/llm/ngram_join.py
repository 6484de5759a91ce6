"""N-gram Jaccard join: documents whose word-shingle sets overlap, and the groups they form.

Multiple global orders. If two sets are similar enough, they share a token among
the first few of each, under any order of all tokens; how few follows from the
threshold. Candidates must do so under three different orders:

- order 1 has tokens of more than ``FREQUENT`` sets last, and else goes by hash.
  Only tokens of the lowest part of the hash range are counted and can be
  frequent, as prefixes seldom reach further. Its prefixes are posted and joined,
  with their positions: a first common token that stands late in both sets
  leaves too few tokens for a link.
- orders 2 and 3 are other hashes of the same tokens. Their prefixes stand beside
  each set as short arrays, and a candidate whose arrays have nothing in common
  under one of them goes no further; nor does one whose parity sketches differ
  in more cells than similar sets can.

What is left is verified on the whole texts, exactly.

Copies and large groups. Documents with equal sets are one class from the start.
In a group of thousands of near copies nearly every pair is linked, so pairs
aren't listed: each token names a hub among its rows, and each row is held
against the hubs of its tokens first. Links found are contracted, and a further
round of hubs goes on between groups only. In the end every pair that still lies
in two groups and is a candidate is verified. A pair inside one group can't
change the groups. So the groups are those of all links.

Defined results: null and wordless texts have an empty set and are linked with
nothing; of one to three words, the whole sequence is the only shingle; very
long texts count whole; a null doc_id is never a component's name unless alone;
rows that repeat are in one class; an empty table gives an empty result; other
columns are ignored. Shingles are counted and compared as 63-bit hashes: two of a
text's n shingles fall together with a chance of n^2 / 2^64, which is 1 in 18
million for a text of a million words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, fresh, passing, table

BITS = 63
FREQUENT = 50
#: Hubs that each token names in each round, before all further candidates between groups are compared.
HUBS = (1, 5)
SKETCH_WORDS = 8
#: Words whose hashes a task keeps.
MAX_WORDS = 200_000
#: Pairs whose texts a worker has as Python strings at once.
PAIRS_AT_ONCE = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
#: Odd factors that give orders 2 and 3.
ORDERS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _WordHashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, width: int, hashes: _WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and at ASCII gaps
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(a) - width + 1) if len(a) else 0
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(a))):
            h += (a[k : k + n] ^ (a[k : k + n] >> np.uint64(31))) * _STEPS[k % 4] * np.uint64(2 * (k // 4) + 1)
        h += np.uint64(min(len(a), width))
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return np.unique((h >> np.uint64(64 - BITS)).astype(np.int64))


def sketch(tokens: np.ndarray, cells: int = 64 * SKETCH_WORDS) -> np.ndarray:
    """Parities of the tokens in that many cells: two sketches differ in no more cells than the sets in tokens."""
    bits = np.bincount(tokens & (cells - 1), minlength=cells).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """How many first tokens of a set of n must meet those of a similar set."""
    return n - -(-n * percent // 100) + 1 if n else 0


def low_bound(percent: int) -> int:
    """Hashes below this are counted: so many that most prefixes lie below it even where a quarter of the tokens is frequent."""
    return (1 << BITS) * (100 - percent) * 7 // 500


def prefix_under(tokens: np.ndarray, factor: np.uint64, percent: int) -> np.ndarray:
    """The prefix under an order by another hash, as its upper 32 bits; two prefixes that share a token share one of these."""
    with np.errstate(over="ignore"):
        key = tokens.astype(np.uint64) * factor
    p = prefix_size(len(key), percent)
    first = np.partition(key, p - 1)[:p] if p < len(key) else key
    return (first >> np.uint64(32)).astype(np.uint32).view(np.int32)


def shingle_sets(numbered: DataFrame, width: int, percent: int) -> DataFrame:
    """numbered(row, text) -> row, n, cls (of equal sets; null if empty), n_low, head (first tokens by hash), p2, p3 (prefixes under orders 2 and 3), sketch. Written."""
    low = low_bound(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                sets = [shingle_hashes(t, width, hashes) for t in part["text"]]
                n_low = [int(np.searchsorted(s, low)) for s in sets]
                yield pd.DataFrame({
                    "row": part["row"].to_numpy(),
                    "n": [len(s) for s in sets],
                    "cls": pd.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets], dtype="Int64"),
                    "n_low": n_low,
                    "head": [s[: max(m, prefix_size(len(s), percent))] for s, m in zip(sets, n_low, strict=True)],
                    "p2": [prefix_under(s, ORDERS[0], percent) for s in sets],
                    "p3": [prefix_under(s, ORDERS[1], percent) for s in sets],
                    "sketch": [sketch(s) for s in sets],
                })

    return cut(numbered.select("row", "text").mapInPandas(run, "row long, n long, cls long, n_low int, head array<long>, p2 array<int>, p3 array<int>, sketch array<long>"), "sets")


def prefix_length(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100) + 1


def postings(reps: DataFrame, percent: int) -> DataFrame:
    """reps(row, n, n_low, head) -> (row, n, token, pos, c): prefix tokens under order 1 that several rows have, their places in it, and how many sets have them at most. Written.

    Tokens are counted with partial sums and the counts joined back, so the rows
    of a token in a third of all sets are never gathered in one task.
    """
    heads = reps.select("row", "n_low", F.posexplode("head").alias("rank", "token"))
    low = heads.where("rank < n_low").select("row", "rank", "token")
    counts = low.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = low.join(counts, "token").select("row", "rank", "token", "c")
    sizes = reps.select(F.col("row").alias("s_row"), "n", "n_low")
    late = F.col("c") > FREQUENT
    before = Window.partitionBy("row").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = shared.join(sizes, F.col("row") == F.col("s_row"))
    placed = placed.withColumn("late_before", F.coalesce(F.count_if(late).over(before), F.lit(0))).withColumn("n_late", F.count_if(late).over(Window.partitionBy("row")))
    pos = F.when(late, F.col("n_low") - F.col("n_late") + F.col("late_before")).otherwise(F.col("rank") - F.col("late_before"))
    placed = placed.withColumn("pos", pos.cast("int")).where(F.col("pos") < prefix_length(F.col("n"), percent)).select("row", "n", "token", "pos", "c")
    # sets with few tokens in the counted range: the next ones by hash
    rest = heads.where("rank >= n_low").select("row", "rank", "token")
    again = rest.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    rest = rest.join(again, "token").join(sizes, F.col("row") == F.col("s_row")).select("row", "n", "token", F.col("rank").alias("pos"), "c")
    return cut(placed.unionByName(rest), "postings")


def meet(percent: int) -> Column:
    """Rows of two groups share a token, and sizes and the token's places, if it's the first common one, leave room for a link."""
    n, m = F.col("n_a"), F.col("n_b")
    left = F.least(n - F.col("pos_a"), m - F.col("pos_b"))
    return (F.col("token_a") == F.col("token_b")) & (F.col("comp_a") != F.col("comp_b")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m))


def near(percent: int) -> Column:
    """A bound: similar sets differ in at most (1 - t) / (1 + t) of their tokens together, and their sketches in no more cells."""
    apart = sum((F.bit_count(F.get("sketch_a", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))) for k in range(SKETCH_WORDS)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def of_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``rows`` that pairs(a, b) name: while these are few, the others don't move."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("i_row")).distinct()
    return rows.join(bounded(involved), F.col("row") == F.col("i_row"), "left_semi")


def candidates(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) that share a prefix token under order 1, those that do so under orders 2 and 3, and whose sketches leave room for a link. Written."""
    pairs = cut(pairs, "met")
    named = of_rows(reps.select("row", "n", "p2", "p3", "sketch"), pairs)
    side = lambda c: named.select(F.col("row").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "p2", "p3", "sketch")))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").where(near(percent) & F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b"), "pairs")


def verified(pairs: DataFrame, numbered: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs(a, b) of rows, those whose whole sets are linked. Written."""
    texts = cut(of_rows(numbered.select("row", "text"), pairs), "texts")
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = _WordHashes(), {}
        for batch in batches:
            on = []
            for k in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(k, PAIRS_AT_ONCE)
                for b, x, y in zip(*(part.column(c).to_pylist() for c in ("b", "x", "y")), strict=True):
                    if b not in kept:  # a hub's pairs follow one another
                        kept = {b: shingle_hashes(y, width, hashes)}
                    on.append(is_linked(shingle_hashes(x, width, hashes), kept[b], percent))
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def is_linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x and y| >= percent * |x or y|."""
    shared = np.intersect1d(x, y, assume_unique=True).size
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (row, comp): the smallest row that links reach, for rows with links. Written.

    Each round takes the smallest label among neighbours, then the label of that label.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("row")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("row").alias("b"), "comp"), "b").groupBy(F.col("a").alias("row")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "row").select("row", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("row").alias("to"), F.col("comp").alias("further"))
        step = cut(step.join(jump, "to").select("row", F.least("to", "further").alias("comp"), "was"), "labels")
        if step.where("comp <> was").isEmpty():
            return step.select("row", "comp")
        labels = step.select("row", "comp")


def groups_of(reps: DataFrame, numbered: DataFrame, width: int, percent: int) -> DataFrame:
    """reps(row, n, n_low, head, p2, p3, sketch) -> (row, comp) of rows with links; comp is the smallest row of the group."""
    posts = postings(reps, percent)
    links = comps = None
    for k, n_hubs in enumerate(HUBS):
        # a token of two sets is done with when its one pair has been compared
        one, other = _sides(_grouped(posts.where("c > 2") if k else posts, comps))
        hubs = [F.min_by(F.struct("row_b", "n_b", "pos_b", "comp_b"), F.xxhash64("row_b", "token_b", F.lit(10 * k + n))).alias(f"hub{n}") for n in range(n_hubs)]
        other = other.groupBy("token_b").agg(*hubs).select("token_b", F.inline(F.array_distinct(F.array(*(f"hub{n}" for n in range(n_hubs))))))
        links, comps = _linked(one.join(other, meet(percent)), links, reps, numbered, width, percent)
    # what is left: pairs of two groups that share one of the other tokens
    named = _grouped(posts.where("c > 2"), comps)
    between = named.groupBy("token").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other").select("token")
    named = cut(named.join(between, "token", "left_semi").join(reps.select("row", "sketch"), "row"), "open")
    one, other = _sides(named)
    return _linked(one.join(other, meet(percent) & (F.col("row_a") < F.col("row_b")) & near(percent)), links, reps, numbered, width, percent)[1]


def _grouped(posts: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Postings with the group of their row; rows without links are their own."""
    if comps is None:
        return posts.withColumn("comp", F.col("row"))
    known = bounded(comps.select(F.col("row").alias("k_row"), "comp"))
    return posts.join(known, F.col("row") == F.col("k_row"), "left").drop("k_row").withColumn("comp", F.coalesce("comp", "row"))


def _sides(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same rows with columns named for either side of a pair."""
    return tuple(named.select(*(F.col(c).alias(f"{c}_{x}") for c in named.columns)) for x in "ab")


def _linked(pairs: DataFrame, links: DataFrame | None, reps: DataFrame, numbered: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links, with those among pairs(row_a, row_b), and the groups that they make."""
    pairs = pairs.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct()
    found = verified(candidates(pairs, reps, percent), numbered, width, percent)
    links = found if links is None else links.unionByName(found)
    return links, components(links)


def join_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id. Written; the steps before are removed."""
    with passing(docs.sparkSession) as kept:
        numbered = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
        return kept(row_groups(numbered, width, percent).select("doc_id", "n_shingles", "component_id"))


def row_groups(numbered: DataFrame, width: int, percent: int) -> DataFrame:
    """A written table numbered(row, doc_id, text) -> row, doc_id, n_shingles, component_id, comp: the group by one of its rows, null for empty sets."""
    sets = shingle_sets(numbered, width, percent)
    ids = sets.select("row", "n", "cls").join(numbered.select("row", F.col("doc_id").cast("long").alias("doc_id")), "row")
    classes = cut(ids.where("n > 0").groupBy("cls").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    copies = sets.where("n > 0").select("row", "cls").join(classes.where("copies > 1").select("cls", "rep"), "cls").where("row <> rep").select(F.col("row").alias("c_row"))
    reps = sets.where("n > 0").join(bounded(cut(copies, "copies")), F.col("row") == F.col("c_row"), "left_anti")
    comps = groups_of(reps, numbered, width, percent)

    named = comps.join(classes.select(F.col("rep").alias("row"), "first_id"), "row").groupBy("comp").agg(F.min("first_id").alias("lowest"))
    named = comps.join(named, "comp").select(F.col("row").alias("rep"), "comp", "lowest")
    named = classes.join(named, "rep", "left").select("cls", F.coalesce("lowest", "first_id").alias("component_id"), F.coalesce("comp", "rep").alias("comp"))
    return ids.join(named, "cls", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "comp")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents (five words, 0.8): of the smallest doc_id, nulls last; of repeated ids the first row.

    Null, empty and wordless texts stay; ids may repeat or be null, so rows are
    numbered, and written with their number; an empty table stays empty; other
    columns, whatever their names, are handed on.
    """
    number = fresh("_row", docs.columns)
    numbered = cut(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    with passing(spark) as kept:
        groups = row_groups(numbered.select(F.col(number).alias("row"), "doc_id", "text"), 5, 80)
        groups = cut(groups.where("comp IS NOT NULL").select("row", "doc_id", "component_id", "comp"), "groups")
        first = groups.groupBy("comp").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row"))).alias("first_row"))
        others = kept(groups.join(first, F.col("row") == F.col("first_row"), "left_anti").select(F.col("row").alias("_other_row")))
    others = bounded(others)
    return numbered.join(others, numbered[number] == others["_other_row"], "left_anti").select(*docs.columns)


NGRAM_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE 100 * n >= 85 * (len(p.sh) + len(q.sh) - n)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.sh"""

QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLES = {"op2_ngram_join": NGRAM_SQL}
