"""Byte-level BPE encoding and decoding: speculate and verify.

A text is cut into words by the tokenizer's pattern. For each distinct word,
greedy longest match proposes tokens. A sequence of tokens is what BPE makes of
its bytes if every two neighbours are: if encoding the bytes of the two gives
back just these two. So all adjacent pairs of all proposals of a batch are
tested at once against a table of pairs, to which the verdicts of new pairs are
added. Only words with a failing pair go through exact merging.

A word's ids never depend on its neighbours, so workers keep the words they have
met; that table and the table of pairs start anew when they reach their bound,
which changes no result. Decoding joins the bytes of ids and reads them as
UTF-8, replacing what is invalid.

Defined results: null is the empty text; an empty text has no ids; the strings
of special tokens in a text become their ids, as the tokenizers library does;
very long texts are encoded whole; rows that repeat give rows that repeat;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.json"
#: The split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pairs that a worker keeps; it stays for the steps that follow.
MAX_WORDS = 200_000
MAX_PAIRS = 200_000
#: Words of more bytes are merged by passes.
LONG_WORD = 256
#: First bytes of a token by which it is looked up.
START = 4
#: Failing words of at most so many bytes are merged together.
WIDTHS = (12, 24)
#: Characters whose new words are learnt together.
CHUNK = 500_000


def byte_of_character() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: bytes that print stand for themselves, the others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def latin_pattern() -> str:
    """``PATTERN`` for texts of code points under 256, with the classes spelt out, which is faster."""
    of = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    s = " \\t\\n\\r\\x0b\\x0c\\x85\\xa0"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{of['L']}]+| ?[{of['N']}]+| ?[^{s}{of['L']}{of['N']}]+|[{s}]+(?![^{s}])|[{s}]+"


class Codec:
    """Encodes and decodes with one vocabulary file, whose contents are ``spec``.

    A text is encoded as runs: for each of its words the ids, joined by commas.
    """

    def __init__(self, spec: str):
        data = json.loads(spec)
        to_byte, ids = byte_of_character(), data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.id_of = {bytes(to_byte[c] for c in t): i for t, i in ids.items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.find, self.find_latin = regex.compile(PATTERN).findall, re.compile(latin_pattern()).findall
        halves = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])]
        self.rank = {a << 32 | b: k for k, (a, b, _) in enumerate(halves)}
        self.made = [c for _, _, c in halves]
        self.id_of_byte = [self.id_of[bytes([b])] for b in range(256)]
        # of tokens, by their first bytes and no longer than what is left, longest first
        by_start: dict[bytes, set[int]] = {}
        for b in self.id_of:
            for k in range(1, min(len(b), START) + 1):
                by_start.setdefault(b[:k], set()).add(len(b))
        for b, n in by_start.items():
            n.update(k for k in range(1, len(b) + 1) if b[:k] in self.id_of)
        self.lengths = {b: tuple(sorted((k for k in n if len(b) == START or k <= len(b)), reverse=True)) for b, n in by_start.items()}
        # for the test of pairs: when each token is formed, and of what
        n = max(self.bytes_of) + 1
        self.formed, self.left, self.right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        for k, (a, b, c) in enumerate(halves):
            if self.formed[c] < 0:
                self.formed[c], self.left[c], self.right[c] = k, a, b
        order = np.argsort(keys := np.array([a << 32 | b for a, b, _ in halves], np.int64))
        self.merge_key, self.merge_rank = keys[order], order
        self.made_of, byte = np.array(self.made), np.array(self.id_of_byte)
        rank = self._rank_of(np.repeat(byte, 256), np.tile(byte, 256))
        self.byte_ids, self.byte_ranks = byte, np.where(rank < 0, len(halves), rank).reshape(256, 256)
        self.runs: dict[str, str] = {}
        self.bytes_of_run: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.written = {i: str(i) for i in self.bytes_of}
        self.start()

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE: always the pair of lowest rank, the leftmost first."""
        ids, get, none = list(map(self.id_of_byte.__getitem__, word)), self.rank.get, len(self.made)
        if len(ids) > LONG_WORD:
            return self._merged_long(ids)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            k = ranks.index(r)
            ids[k : k + 2] = [self.made[r]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same for very long words: all places of the lowest rank in one pass."""
        none = len(self.made)
        while len(ids) > 1:
            ranks = [self.rank.get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
            if (r := min(ranks)) == none:
                break
            out, k = [], 0
            while k < len(ids):
                if k < len(ranks) and ranks[k] == r:
                    out.append(self.made[r])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """``merged`` for many short words at once: a row for each, a merge of each in a pass; what is merged away leaves a gap."""
        n, none, width = len(words), len(self.made), max(map(len, words), default=0)
        if not width:
            return [[] for _ in words]
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        ids, rank = np.full((n, width + 1), -1), np.full((n, width + 1), none)
        ids[row, place] = self.byte_ids[flat]
        inside = place[:-1] + 1 < size[row[:-1]]
        rank[row[:-1][inside], place[:-1][inside]] = self.byte_ranks[flat[:-1][inside], flat[1:][inside]]
        after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))

        def again(rows: np.ndarray, left: np.ndarray, right: np.ndarray, there: np.ndarray) -> None:
            rows, left, right = rows[there], left[there], right[there]
            r = self._rank_of(ids[rows, left], ids[rows, right])
            rank[rows, left] = np.where(r < 0, none, r)

        live = np.arange(n)
        while live.size:
            k = rank[live].argmin(1)  # the first of the lowest
            r = rank[live, k]
            go = r < none
            live, k, r = live[go], k[go], r[go]
            gone = after[live, k]
            then = after[live, gone]
            ids[live, k], ids[live, gone] = self.made_of[r], -1
            rank[live, k] = rank[live, gone] = none
            after[live, k], before[live, np.minimum(then, width)] = then, k
            again(live, k, then, then < size[live])
            again(live, before[live, k], k, before[live, k] >= 0)
        stay = ids >= 0
        out, end = ids[stay].tolist(), np.cumsum(stay.sum(1)).tolist()
        return [out[a:b] for a, b in zip([0, *end], end, strict=False)]

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        out, at, n, get, lengths = [], 0, len(word), self.id_of.get, self.lengths
        while at < n:
            start = word[at : at + START]
            sizes = lengths.get(start)
            while sizes is None:
                start = start[:-1]
                sizes = lengths.get(start)
            for k in sizes:
                if at + k <= n and (i := get(word[at : at + k])) is not None:
                    out.append(i)
                    at += k
                    break
        return out

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
        return np.where(self.merge_key[at] == key, self.merge_rank[at], -1)

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of a and b comes before both are formed, for all pairs at once.

        Goes back in time: x and y are what stands at the border, and until_x
        and until_y the ranks at which they are merged into more. A merge of x
        and y comes first if its rank is under until_x, where a tie goes to the
        left, and at most until_y.
        """
        good, live = np.ones(len(a), bool), np.arange(len(a))
        never = len(self.merge_rank) + 1
        x, y, until_x, until_y = a.copy(), b.copy(), np.full(len(a), never), np.full(len(a), never)
        while live.size:
            r = self._rank_of(x, y)
            clash = (r >= 0) & (r < until_x) & (r <= until_y)
            good[live[clash]] = False
            fx, fy = self.formed[x], self.formed[y]
            go = ~clash & ((fx >= 0) | (fy >= 0))
            live, x, y, until_x, until_y, fx, fy = (v[go] for v in (live, x, y, until_x, until_y, fx, fy))
            of_x = fx > fy
            until_x, until_y = np.where(of_x, fx, until_x), np.where(of_x, until_y, fy)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return good

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each two neighbours, whether BPE of their joined bytes gives these two again."""
        distinct, back = np.unique(left << 32 | right, return_inverse=True)
        if len(self.pairs) + len(distinct) > MAX_PAIRS:
            self.pairs.clear()
        new = np.array([k for k in distinct.tolist() if k not in self.pairs], np.int64)
        self.pairs.update(zip(new.tolist(), self._test(new >> 32, new & 0xFFFFFFFF).tolist(), strict=True))
        return np.fromiter(map(self.pairs.__getitem__, distinct.tolist()), bool, len(distinct))[back]

    def propose(self, words: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """Greedy proposals for words, and which of them have a failing pair."""
        proposed = [self.greedy(w) for w in words]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[1:] == owner[:-1]
        wrong = np.zeros(len(words), bool)
        wrong[owner[:-1][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])]] = True
        return proposed, wrong

    def learn(self, new: list[str]) -> None:
        """Encodes words that are new to this worker."""
        words = [w.encode() for w in new]
        proposed, wrong = self.propose(words)
        left, least = np.flatnonzero(wrong).tolist(), 0
        for most in WIDTHS:
            some = [k for k in left if least < len(words[k]) <= most]
            for k, ids in zip(some, self.merged_all([words[k] for k in some]), strict=True):
                proposed[k] = ids
            least = most
        for k in left:
            if len(words[k]) > least:
                proposed[k] = self.merged(words[k])
        written, of = self.written, self.bytes_of.__getitem__
        for w, ids in zip(new, proposed, strict=True):
            run = ",".join([written[i] for i in ids])
            self.runs[w] = run
            self.bytes_of_run[run] = b"".join(map(of, ids))

    def words(self, text: str) -> list[str]:
        """A text's words by the split pattern; special tokens stay whole."""
        out: list[str] = []
        for part in self.split_special(text) if self.split_special else [text]:
            if part in self.special:
                out.append(part)
                continue
            try:
                part.encode("latin-1")
                out += self.find_latin(part)
            except UnicodeEncodeError:
                out += self.find(part)
        return out

    def encode_batch(self, texts: Iterable[str]) -> Iterator[list[str]]:
        """The runs of each text; new words of about ``CHUNK`` characters at a time are learnt together."""
        texts = iter(texts)
        while True:
            found, size = [], 0
            for text in texts:
                found.append(self.words(text))
                if (size := size + len(text)) >= CHUNK:
                    break
            if not found:
                return
            distinct = set().union(*found)
            new = distinct.difference(self.runs)
            if len(self.runs) + len(new) > MAX_WORDS:
                self.runs.clear()
                self.bytes_of_run.clear()
                self.start()
                new = distinct.difference(self.runs)
            if new:
                self.learn(list(new))
            for words in found:
                yield list(map(self.runs.__getitem__, words))

    def encode(self, text: str) -> list[str]:
        """The runs of one text."""
        return next(self.encode_batch([text]))

    def start(self) -> None:
        """Special tokens are words that are known from the start."""
        for token, i in self.special.items():
            self.runs[token], self.bytes_of_run[str(i)] = str(i), token.encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_runs(self, runs: list[str]) -> str:
        """The text of runs; what a run of ids stands for is looked up once."""
        known = self.bytes_of_run
        for run in set(runs).difference(known):
            known[run] = b"".join(self.bytes_of[int(i)] for i in run.split(","))
        return b"".join(map(known.__getitem__, runs)).decode("utf-8", "replace")


def vocabulary(path: str | None = None) -> str:
    """The contents of a tokenizer file: 1.5 MB, whatever the data."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


_CODECS: dict[str, Codec] = {}


def _codec(spec: str) -> Codec:
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids: the ids of each text."""
    return digests(docs, path, with_ids=True).select("doc_id", "ids")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded(doc_id, ids) -> doc_id, text."""
    spec = coded.sparkSession.sparkContext.broadcast(vocabulary(path))

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        codec = _codec(spec.value)
        return ids.map(lambda i: None if i is None else codec.decode(list(i)))

    return coded.select("doc_id", text_of("ids").alias("text"))


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> number of ids, and digests of the ids and of the text decoded from them; the ids too, if asked for.

    Encodes and decodes where the text is, so that only results leave the worker.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec.value)
        for b in batches:
            for k in range(0, len(b), 500):
                part, rows = b.iloc[k : k + 500], []
                for doc_id, runs in zip(part["doc_id"], codec.encode_batch(t or "" for t in part["text"]), strict=True):
                    listed = ",".join(runs)
                    ids = [np.fromstring(listed, np.int32, sep=",") if runs else np.zeros(0, np.int32)] * with_ids
                    n = listed.count(",") + 1 if runs else 0
                    rows.append((doc_id, n, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(codec.decode_runs(runs).encode()).hexdigest(), *ids))
                yield pd.DataFrame(rows, columns=names)

    asked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # long with nulls would be float in pandas
    made = asked.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row of ``docs``, with the digests that show them to decode."""
    return digests(docs, with_ids=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLES: dict[str, str] = {}
