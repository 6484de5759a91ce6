"""Approximate nearest neighbours by additive quantisation, with exact reranking.

A vector is coded as a sum of one full-dimensional entry from each of several
codebooks. The codebooks are fitted one after the other, each to what the ones
before leave of a bounded sample. Encoding keeps a beam: the best few sums so
far are extended by every entry of the next codebook.

An index row has the codes, the vector's norm and the norm of its sum. A query's
products with all entries make a lookup table; a row's score is the sum of what
its codes look up, scaled by the ratio of the two norms, so that what
quantisation takes from a vector's length is given back. In each block of the
index a query's best distinct codes are reranked by exact products in double
precision, with ties to smaller ids, and the blocks' best are merged.

Queries and index meet in blocks: every query block with every index block,
neither larger than its bound, so no task grows with the data. A query's rows
leave a block already cut to what the result can hold.

Equal vectors are one entry of a block, whose ids come in order; of these only
the first ``k`` + 1 can be in a result. So copies neither crowd out others nor
are lost.

Defined results: vectors that are null, zero, of a length other than the most
frequent, or hold null or non-finite components take no part; fewer candidates
than k give as many rows; a vec_id that repeats is as many candidates, but never
its own query's; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Vectors that the codebooks are fitted to, at most: the first in hash order.
SAMPLE = 20_000
N_BOOKS, N_ENTRIES, BEAM, ROUNDS = 12, 256, 4, 8
#: A block's best distinct codes that are reranked for each query.
SHORTLIST = 160
QUERY_BLOCK, INDEX_BLOCK = 2_048, 8_192


def usable(vector: Column) -> Column:
    """Whether a vector is not null or zero, and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of x; a centre without points moves to a random point."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each vector by beam search, and the norms of their sums."""
    n, norms = len(x), (books**2).sum(2)
    left = x[:, None, :].copy()  # what each sum of the beam leaves over
    codes = np.zeros((n, 1, 0), np.uint8)
    for m, book in enumerate(books):
        gain = 2 * left @ book.T - norms[m]  # how much an entry takes from the squared rest
        cost = ((left**2).sum(2)[:, :, None] - gain).reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, entry = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        left = left[rows, parent] - book[entry]
        codes = np.concatenate([codes[rows, parent], entry[:, :, None].astype(np.uint8)], axis=2)
    best = (left**2).sum(2).argmin(1)
    rest = left[np.arange(n), best]
    return codes[np.arange(n), best], np.linalg.norm(x - rest, axis=1)


def fit(vectors: DataFrame, n_books: int = N_BOOKS, n_entries: int = N_ENTRIES, sample: int = SAMPLE) -> np.ndarray | None:
    """Codebooks (n_books, n_entries, dimension) from at most ``sample`` of vectors(vec_id, embedding)."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(rows):
        return None
    x, rng, books = np.stack(rows.to_list()).astype(np.float32), np.random.default_rng(7), []
    for _ in range(n_books):
        books.append(k_means(x, n_entries, ROUNDS, rng))
        near = (x @ books[-1].T - (books[-1] ** 2).sum(1) / 2).argmax(1)
        x = x - books[-1][near]
    return np.stack(books).astype(np.float32)


def index_blocks(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vectors(vec_id, embedding) -> packed blocks: ids, vectors, codes, scale (norm over norm of sum)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in blocks(batches, INDEX_BLOCK):
            codes, norms = zip(*(encode(x[k : k + 512].astype(np.float32), shared.value) for k in range(0, len(x), 512)), strict=True)
            codes, norms = np.concatenate(codes), np.concatenate(norms)
            scale = (np.linalg.norm(x, axis=1) / np.maximum(norms, 1e-30)).astype(np.float32)
            yield pd.DataFrame({"ids": [ids.tobytes()], "vectors": [x.tobytes()], "codes": [codes.tobytes()], "scale": [scale.tobytes()]})

    return vectors.mapInPandas(run, "ids binary, vectors binary, codes binary, scale binary")


def query_blocks(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in blocks(batches, QUERY_BLOCK):
            yield pd.DataFrame({"q_ids": [ids.tobytes()], "q_vectors": [x.tobytes()]})

    return vectors.mapInPandas(run, "q_ids binary, q_vectors binary")


def blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A partition's ids and vectors, in blocks of at most ``size`` rows."""
    ids, rows = [], []
    for b in batches:
        ids += b["vec_id"].tolist()
        rows += b["embedding"].tolist()
        while len(ids) >= size:
            yield np.array(ids[:size], np.int64), np.stack(rows[:size]).astype(np.float32 if rows[0].dtype == np.float32 else np.float64)
            ids, rows = ids[size:], rows[size:]
    if ids:
        yield np.array(ids, np.int64), np.stack(rows).astype(np.float32 if rows[0].dtype == np.float32 else np.float64)


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, books: np.ndarray, k: int, shortlist: int) -> Iterator[tuple]:
    """Of one index block the k nearest to each query: query id, id, exact score."""
    order = np.lexsort((ids, *x.T[::-1])) if len(x) else np.arange(0)
    x, ids, codes, scale = x[order], ids[order], codes[order], scale[order]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))  # of each distinct vector
    last = np.append(first[1:], len(x))
    exact = x[first].astype(np.float64)
    lut = np.einsum("med,qd->meq", books, q.astype(np.float32))
    for at in range(0, len(q), 256):
        part = np.ascontiguousarray(lut[:, :, at : at + 256])
        score = np.zeros((len(first), part.shape[2]), np.float32)
        for m in range(len(books)):
            score += part[m][codes[first, m]]
        score *= scale[first, None]
        for j in range(part.shape[2]):
            s = score[:, j]
            near = np.argpartition(-s, shortlist - 1)[:shortlist] if shortlist < len(s) else np.arange(len(s))
            true = exact_products(exact[near], q[at + j])
            best = np.argsort(-true, kind="stable")
            taken: list[tuple[float, int]] = []
            for b in best.tolist():
                if len(taken) >= k and true[b] < taken[k - 1][0]:
                    break
                own = ids[first[near[b]] : min(last[near[b]], first[near[b]] + k + 1)]
                taken += [(float(true[b]), int(i)) for i in own if i != q_ids[at + j]]
            for value, i in sorted(taken, key=lambda t: (-t[0], t[1]))[:k]:
                yield int(q_ids[at + j]), i, value


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of components, so that no blocking changes a bit of them."""
    return np.cumsum(x * q.astype(np.float64), axis=1)[:, -1]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, vec_id, score by inner product."""
    clean = lambda df: df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors, queries = clean(vectors), clean(queries)
    size = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = size["d"] if size else 0
    vectors, queries = (df.where(F.size("embedding") == d) for df in (vectors, queries))
    books = fit(vectors)
    schema = "query_id long, vec_id long, score double"
    if books is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = np.float64 if dict(vectors.dtypes)["embedding"] == "array<double>" else np.float32
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    index = cut(index_blocks(vectors, books), "index")
    asked = cut(query_blocks(queries), "queries")
    # each index block once for each query block: the blocks are numbered, and meet by number
    n_asked = asked.count()
    keys = asked.select(F.md5("q_ids").alias("key"))
    keys = keys.withColumn("number", F.row_number().over(Window.orderBy("key")) - 1)  # one short row for each query block
    numbered = asked.withColumn("key", F.md5("q_ids")).join(keys, "key")
    pairs = index.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_asked - 1))))).join(numbered, "number")
    pairs = pairs.repartition(max(8, min(2_000, index.count() * n_asked)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                q_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, x = np.frombuffer(r.q_vectors, kind).reshape(-1, d), np.frombuffer(r.vectors, kind).reshape(-1, d)
                codes, scale = np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1), np.frombuffer(r.scale, np.float32)
                found = list(search_block(q, q_ids, x, ids, codes, scale, shared.value, k, shortlist))
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = pairs.select("q_ids", "q_vectors", "ids", "vectors", "codes", "scale").mapInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {"op6_ann": op6_ann}
ORACLES: dict[str, str] = {}
