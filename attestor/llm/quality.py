"""Quality rules by distribution divergence.

A document's character classes and common words are two histograms. Each is
held against the reference of its language by Jensen-Shannon distance (base 2,
so from 0 to 1). A language's reference is the mean of its documents'
histograms over the whole table, every document counting alike, so long ones
do not rule; its common words are the ``N_COMMON`` in most documents, of any
length, if they are in a tenth of them.

A document fails by a histogram only if it is long enough for it to mean
something: ``MIN_CHARS`` characters, or ``MIN_WORDS`` words. Character classes
tell symbol noise, tables and shouting apart from prose; common words, and the
share of one word, tell apart repetition.

Before that come the base rules: at least 50 words, and at most half of the
words in 3-word windows that occur twice or more.

Defined results: a null text has no words and fails the base rules; documents
of a null language, or of one with fewer than ``MIN_DOCUMENTS`` long enough, have
no reference: their distances are null and only the base rules judge them, since
another language's letters and words say nothing about them. The same holds for
words alone where no word is common; an empty table gives an empty result; rows that repeat are judged alike; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

MIN_CHARS = 200
MIN_WORDS = 50
MIN_DOCUMENTS = 20
N_COMMON = 48
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.50
#: References of so many languages, the largest, go to every worker; those of further ones are joined.
MAX_BROADCAST = 5000
#: Words that a task sums before it hands the sums on.
MAX_SUMS = 100_000
#: Words whose plain form a task keeps at hand.
MAX_KEPT = 80_000
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
SYMBOLS = re.compile(r"[#*$%&|<>]")

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
split_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def base_stats(text: str | None, words: list[str]) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines that occurred before, and words in 3-word windows found twice or more."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0  # words up to here are counted
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeated += k + 3 - max(end, k)
                end = k + 3
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def base_failed(stats: tuple[int, int, int, int, int]) -> bool:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return stats[0] < 50 or 100 * stats[4] > 50 * stats[0]


_CLASS_OF = {c: 0 for c in "abcdefghijklmnopqrstuvwxyz"} | {c: 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: 2 for c in "0123456789"} | {c: 3 for c in " \t\n\r\x0b\x0c"} | {c: 4 for c in ".,;:'\"?()-"}


def _class(c: str) -> int:
    """Of any character: by its case, else whether it is a letter, a digit or a space."""
    if (k := _CLASS_OF.get(c)) is None:
        k = _CLASS_OF[c] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 6 if c.isalpha() else 5
    return k


_LOW_CLASSES = np.array([_class(chr(c)) for c in range(0x250)], np.uint8)


def char_histogram(text: str) -> np.ndarray:
    """Shares of the character classes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 0x250
    h = np.bincount(_LOW_CLASSES[codes[low]], minlength=len(CLASSES)).astype(float)
    if not low.all():
        for c, n in zip(*(x.tolist() for x in np.unique(codes[~low], return_counts=True)), strict=True):
            h[_class(chr(c))] += n
    return h / max(1.0, h.sum())


def word_histogram(times: Counter, common: dict[str, int]) -> np.ndarray:
    """Shares of a language's common words; in the last two places, of the most frequent other word and of all others."""
    h = np.zeros(len(common) + 2)
    most = rest = 0
    for w, n in times.items():
        if (k := common.get(w)) is not None:
            h[k] += n
        else:
            rest += n
            most = max(most, n)
    h[-2], h[-1] = most, rest - most
    return h / max(1.0, h.sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2."""
    m = (p + q) / 2
    total = 0.0
    for x in (p, q):
        on = x > 0
        total += float((x[on] * np.log2(x[on] / m[on])).sum()) / 2
    return math.sqrt(max(0.0, total))


class _Plain(dict):
    """Words without marks around them, in lower case; kept up to a bound."""

    def __missing__(self, word: str) -> str:
        if len(self) >= MAX_KEPT:
            self.clear()
        p = self[word] = word.strip(".,;:!?\"'()#*$%&|<>").lower()
        return p


_plain = _Plain()


def word_times(words: list[str]) -> Counter:
    """How often each plain word occurs."""
    times: Counter = Counter()
    for w, n in Counter(words).items():
        times[_plain[w]] += n
    return times


Reference = tuple[np.ndarray, dict[str, int] | None, np.ndarray | None]
REFERENCE = {"r_chars": "array<double>", "r_words": "array<string>", "r_shares": "array<double>"}


def references(docs: DataFrame, n_common: int = N_COMMON, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs(text, lang) -> lang, n_docs, r_chars, r_words, r_shares, for each language with ``min_documents`` documents. Written.

    The mean character histogram; the common words and their mean shares, null
    if fewer documents have ``MIN_WORDS`` words or no word is common.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a batch's sums leave the worker, not its documents: shares of words and of classes
        total: dict[tuple[str, str], list[float]] = {}
        classes: dict[str, np.ndarray] = {}

        def made() -> pd.DataFrame:
            rows = [(a, w, n, s) for (a, w), (n, s) in total.items()]
            rows += [(a, f"\n{k}", int(h[-2]), float(h[k])) for a, h in classes.items() for k in range(len(CLASSES))]
            rows += [(a, "\nwords", int(h[-1]), 0.0) for a, h in classes.items()]
            total.clear()
            classes.clear()
            return pd.DataFrame(rows, columns=["lang", "word", "n", "share"])

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                if text is None or len(text) < MIN_CHARS:
                    continue
                found = split_words(text)
                worded = len(found) >= MIN_WORDS
                classes[lang] = classes.get(lang, 0) + np.append(char_histogram(text), [1.0, float(worded)])
                if worded:
                    for w, n in word_times(found).items():
                        if w:
                            s = total.setdefault((lang, w), [0, 0.0])
                            s[0] += 1
                            s[1] += n / len(found)
                if len(total) >= MAX_SUMS:
                    yield made()
            yield made()

    known = docs.where("lang IS NOT NULL").select("lang", "text")
    counted = known.mapInPandas(sums, "lang string, word string, n long, share double").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    is_class = F.col("word").startswith("\n")
    # a word of fewer documents than a tenth of the smallest number isn't common anywhere
    counted = cut(counted.where(is_class | (F.col("n") * 10 >= min_documents)), "words")
    by_class = F.array_sort(F.collect_list(F.when(F.col("word") != "\nwords", F.struct(F.substr("word", F.lit(2)).cast("int").alias("k"), (F.col("share") / F.col("n")).alias("share")))))
    langs = counted.where(is_class).groupBy("lang").agg(F.max("n").alias("n_docs"), F.max(F.when(F.col("word") == "\nwords", F.col("n"))).alias("n_worded"), by_class.alias("c"))
    langs = cut(langs.where(F.col("n_docs") >= min_documents).select("lang", "n_docs", "n_worded", F.col("c.share").alias("r_chars")), "langs")
    common = counted.where(~is_class).join(langs.where(F.col("n_worded") >= min_documents).select("lang", "n_worded"), "lang").where(F.col("n") * 10 >= F.col("n_worded"))
    top = common.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((F.col("n") / F.col("n_worded")).alias("n"), "word", (F.col("share") / F.col("n_worded")).alias("share"))), asc=False), 1, n_common).alias("top"))
    return cut(langs.join(top, "lang", "left").select("lang", "n_docs", "r_chars", F.col("top.word").alias("r_words"), F.col("top.share").alias("r_shares")), "references")


def reference(chars: Sequence[float] | None, words: Sequence[str] | None, shares: Sequence[float] | None) -> Reference | None:
    """A row's reference as ``verdict`` reads it."""
    if chars is None:
        return None
    if words is None:
        return np.asarray(chars, float), None, None
    s = np.asarray(shares, float)
    rest = max(0.0, 1 - s.sum())
    # the most frequent other word has the place of one that is just not common
    other = min(rest, float(s.min()))
    return np.asarray(chars, float), {w: k for k, w in enumerate(words)}, np.append(s, [other, rest - other])


def with_references(docs: DataFrame, refs: DataFrame, most: int, columns: Sequence[str]) -> list[tuple[DataFrame, dict[str, Reference]]]:
    """Parts of ``docs`` that make up the whole, with further ``columns`` for the three of ``REFERENCE``, and the references that these leave null.

    Of up to ``most`` languages there is one part. Of more, documents of the
    largest and of none are one part, and the others join theirs: each of these
    languages has at most one ``most``-th of the documents.
    """
    largest = cut(refs.orderBy(F.desc("n_docs"), "lang").limit(most), "largest")
    held = {r["lang"]: reference(r["r_chars"], r["r_words"], r["r_shares"]) for r in largest.toLocalIterator()}
    none = {c: F.lit(None).cast(t) for c, t in zip(columns, REFERENCE.values(), strict=True)}
    if len(held) < most or refs.count() == len(held):
        return [(docs.withColumns(none), held)]
    own = fresh("r_lang", docs.columns)
    names = F.broadcast(largest.select(F.col("lang").alias(own)))
    here = docs.join(names, docs["lang"] == names[own], "left_semi").unionByName(docs.where("lang IS NULL"))
    others = docs.where("lang IS NOT NULL").join(names, docs["lang"] == names[own], "left_anti")
    joined = refs.select(F.col("lang").alias(own), *(F.col(r).alias(c) for c, r in zip(columns, REFERENCE, strict=True)))
    return [(here.withColumns(none), held), (others.join(joined, others["lang"] == joined[own], "left").drop(own), {})]


def verdict(text: str, words: list[str], ref: Reference | None, max_char: float, max_word: float) -> tuple[float | None, float | None, bool]:
    """Distances from the language's reference (null without one, and under the minimum length), and whether the document stays."""
    char_d = word_d = None
    if ref and len(text) >= MIN_CHARS:
        char_d = js_distance(char_histogram(text), ref[0])
    if ref and ref[1] is not None and len(words) >= MIN_WORDS:
        word_d = js_distance(word_histogram(word_times(words), ref[1]), ref[2])
    return char_d, word_d, not ((char_d or 0) > max_char or (word_d or 0) > max_word)


def judge(docs: DataFrame, refs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, most: int = MAX_BROADCAST) -> DataFrame:
    """docs(doc_id, text, lang) -> the base counts, base_failed, kept and both distances."""

    def part(asked: DataFrame, held: dict[str, Reference]) -> DataFrame:
        held_b = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for text, lang, *own in zip(b["text"], b["lang"], *(b[c] for c in REFERENCE), strict=True):
                    words = split_words(text or "")
                    stats = base_stats(text, words)
                    failed = base_failed(stats)
                    char_d, word_d, good = verdict(text or "", words, held_b.value.get(lang) or reference(*own), max_char, max_word)
                    rows.append((*stats, failed, good and not failed, char_d, word_d))
                out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"])
                out.insert(0, "doc_id", b["doc_id"].to_numpy())
                yield out

        asked = asked.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", *REFERENCE)  # long with nulls would be float in pandas
        return asked.mapInPandas(run, f"doc_id string, {STATS}, base_failed boolean, kept boolean, char_distance double, word_distance double")

    made = [part(*p) for p in with_references(docs.select("doc_id", "text", "lang"), refs, most, list(REFERENCE))]
    return reduce(DataFrame.unionByName, made).withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs`` that the rules keep; the references are those of ``docs``.

    Null, empty and short texts fail the base rules and go; rows that repeat are
    kept or go together; ids don't matter; an empty table stays empty; other columns, whatever their names, are handed on.
    """

    def part(asked: DataFrame, held: dict[str, Reference]) -> DataFrame:
        held_b = spark.sparkContext.broadcast(held)

        @F.pandas_udf("boolean")
        def good(text: pd.Series, lang: pd.Series, chars: pd.Series, words: pd.Series, shares: pd.Series) -> pd.Series:
            kept = []
            for t, of, *own in zip(text, lang, chars, words, shares, strict=True):
                found = split_words(t or "")
                kept.append(not base_failed(base_stats(t, found)) and verdict(t or "", found, held_b.value.get(of) or reference(*own), MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE)[2])
            return pd.Series(kept, dtype=bool)

        return asked.where(good("text", "lang", *columns)).select(*docs.columns)

    columns = [fresh(c, docs.columns) for c in REFERENCE]
    return reduce(DataFrame.unionByName, [part(*p) for p in with_references(docs, references(docs), most, columns)])


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}
