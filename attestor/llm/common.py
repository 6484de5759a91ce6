"""What the operators of this subpackage share: reading, words, broadcasts within bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.sources.steps import cut, passing, remove, shared_dir

__all__ = ["GAP", "GAP_CHARS", "WORD", "bounded", "cut", "fresh", "n_words", "passing", "remove", "shared_dir", "table"]

#: A word: a run of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for null: a word begins wherever a non-gap follows a gap or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded(df: DataFrame, megabytes: int = 32) -> DataFrame:
    """Marks a written table for broadcast if its rows take at most so much as Spark holds them; beyond that it joins by shuffle.

    Numbers have a known width, strings are measured; tables with arrays are refused.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wide = [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType | T.BooleanType | T.StringType)]
    if wide:
        raise ValueError(f"the width of {wide} is not known")
    room, row = megabytes << 20, 16 + 8 * len(df.columns)
    chars = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    n, more = df.limit(room // row + 1).agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    return F.broadcast(df) if n * row + more <= room else df


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` is, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
