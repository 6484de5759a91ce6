"""Values of cases out of their lines: each case has its own values, and a value's forms give way to its reference."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.references import forms, pads, reference_under
from attestor.sources.steps import bounded, cut

#: A form counts where it stands alone; a percent-escape before it ends a word.
BEFORE, AFTER = r"(?:(?<![A-Za-z0-9_])|(?<=%[0-9A-Fa-f]{2}))", r"(?![A-Za-z0-9_])"
RUN, TRIPLE = "([a-z0-9_]+)", "(?=([^a-z0-9_]{3}))"


def dictionary(values: DataFrame, salts: DataFrame, words: tuple[str, ...] = (), case: str = "case") -> DataFrame:
    """values(case, value, ord), salts(case, salt) -> case, form (in lower case), ref, key: of values that share a form the first has it.

    ``key`` is a run of letters, digits and underscores that every text with the form has as a whole
    word: that which fewest forms of the case have, so that a domain that thousands of addresses share isn't where their lines meet; the
    first three characters of a form without one. Cases without salt have no references.
    """
    v = values.join(salts.select(case, pads(F.col("salt")).alias("pads")), case)
    each = v.select(case, "ord", "value", reference_under(F.col("value"), F.col("pads")).alias("ref"), F.explode(forms(F.col("value"), words)).alias("form"))
    first = each.groupBy(case, F.lower("form").alias("form")).agg(F.min_by("ref", F.struct("ord", "value")).alias("ref"))
    first = cut(first, "forms")
    runs = F.array_distinct(F.regexp_extract_all("form", F.lit(RUN), F.lit(1)))
    had = first.select(case, "form", F.explode(runs).alias("run"))
    shared = had.groupBy(case, "run").agg(F.count("*").alias("n"))
    rarest = had.join(shared, [case, "run"]).groupBy(case, "form").agg(F.min_by("run", F.struct("n", -F.length("run"), "run")).alias("run"))
    return first.join(rarest, [case, "form"], "left").select(case, "form", "ref", F.coalesce("run", F.left("form", F.lit(3))).alias("key"))


def text_keys(text: Column) -> Column:
    """All keys that a form in this text can have: its words, also without the escape that they follow, and its triples of other characters."""
    low = F.lower(text)
    escaped = F.regexp_extract_all(low, F.lit("%[0-9a-f]{2}([a-z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(RUN), F.lit(1)), escaped, F.regexp_extract_all(low, F.lit(TRIPLE), F.lit(1))))


@lru_cache(4096)
def _pattern(found: tuple[str, ...]) -> re.Pattern:
    longest_first = sorted(found, key=lambda f: (-len(f), f))
    return re.compile(f"{BEFORE}(?:{'|'.join(map(re.escape, longest_first))}){AFTER}", re.IGNORECASE)


def replaced(text: str, refs: dict[str, str]) -> str:
    """From left to right, the longest form at each place by its reference."""
    return _pattern(tuple(sorted(refs))).sub(lambda m: refs.get(m.group().lower(), "t:redacted"), text)


@F.pandas_udf(T.StringType())
def _scrubbed(texts: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or f is None else replaced(t, {x["form"]: x["ref"] for x in f}) for t, f in zip(texts, found)], dtype=object)


def scrubbed(lines: DataFrame, entries: DataFrame, text: str = "text", case: str = "case") -> DataFrame:
    """``lines`` with the forms of their case's values replaced; ``entries`` as ``dictionary`` gives them. Column ``replaced`` says whether any was.

    A line meets the few entries of its case that share a word with it, by equality, so that a case with any number of
    values costs one pass and its lines are in as many tasks as there are; only what a line met goes back to it. The dictionary
    is written once and, if it is small by measured bytes, sent to all tasks, so that words aren't shuffled. Equal lines of a case are looked up once. Null
    texts stay null; lines without case, or of one without values, stay as they are.
    """
    entries = cut(entries.select(F.col(case).alias("_case"), "form", "ref", "key"), "forms")
    digest = F.sha2(F.col(text), 256)
    words = lines.where(F.col(text).isNotNull() & F.col(case).isNotNull()).select(F.col(case).alias("_case"), digest.alias("_digest"), F.explode(text_keys(F.col(text))).alias("key"))
    met = words.join(bounded(entries), ["_case", "key"]).groupBy("_case", "_digest").agg(F.collect_set(F.struct("form", "ref")).alias("_found"))
    told = lines.withColumn("_line", digest).join(met, (F.col(case) == F.col("_case")) & (F.col("_line") == F.col("_digest")), "left")
    told = told.withColumn("_out", F.when(F.col("_found").isNull(), F.col(text)).otherwise(_scrubbed(F.col(text), F.col("_found"))))
    return told.select(*(F.col("_out").alias(text) if c == text else F.col(c) for c in lines.columns), (~F.col("_out").eqNullSafe(F.col(text))).alias("replaced"))
