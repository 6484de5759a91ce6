"""Preference formatting: pairs of conversations as one prompt and two masked completions (DataFrame functions only).

The turns of a chosen and of a rejected conversation are compared from the
start. Their longest common prefix, cut back so that it doesn't end the chosen
answer, is rendered once as the prompt; what remains of each is a completion. A
turn is rendered as ``<|role|>`` and a line end, the text, ``<|end|>`` and a line
end. Masks are spans of code points in the completion, from and to, that are
trained on: the text and end mark of assistant turns.

A conversation's turns meet in one row, since the result is one row; no more
than that is gathered. Turns with null text are rendered empty, null roles as
"user"; turns that repeat are kept in the order of turn, role and text; turns
without a conv_id belong to no conversation and are left out, as are turns after
the last answer, on which nothing is trained; a pair without a rejected conversation isn't a pair, and has null completions; a pair
of equal conversations has the whole as prompt and two empty completions; an
empty table gives an empty result; other columns are ignored.

The table at hand has no pairs, so ``with_swapped_answers`` makes them of
neighbours: some differ in the last answer only, some part half-way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = "<|end|>\n"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(head(x["role"]), x["text"], F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """(from, to) of the assistant parts of the rendered turns, in code points."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(head(x["role"]))
        end = begin + F.length(x["text"]) + len(END)
        span = F.array(F.struct(begin.cast("long").alias("from"), end.cast("long").alias("to")))
        return F.struct(end.cast("long").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns are the same."""
    least = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, F.lit(1), least), F.slice(b, F.lit(1), least), lambda x, y: x != y)
    return F.when(F.array_contains(differs, True), F.array_position(differs, True) - 1).otherwise(least).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected: arrays of (role, text)) -> prompt, completions and their trained spans."""
    n = F.when(F.col("rejected").isNotNull(), common_turns(F.col("chosen"), F.col("rejected"))).otherwise(F.size("chosen"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    p = pairs.withColumn("n", n)
    p = p.select("pair_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("prompt"), F.when(F.col("rejected").isNotNull(), rest(F.col("chosen"))).alias("c"), F.when(F.col("rejected").isNotNull(), rest(F.col("rejected"))).alias("r"))
    return p.select("pair_id", F.col("n").cast("long").alias("prompt_turns"), rendered(F.col("prompt")).alias("prompt"), rendered(F.col("c")).alias("chosen"), trained_spans(F.col("c")).alias("chosen_spans"), rendered(F.col("r")).alias("rejected"), trained_spans(F.col("r")).alias("rejected_spans"))


def with_swapped_answers(turns: DataFrame) -> DataFrame:
    """Pairs from single conversations and their neighbours (conv_id xor 1): chosen is the conversation up to its last answer.

    Rejected is, where conv_id / 2 is even, the same with the neighbour's last
    answer; where it is odd, the first half of the turns before the answer, and
    then what the neighbour has from there up to its last answer. A conversation
    without an answer, or whose neighbour has none, has no rejected one. Both
    neighbours are gathered by one grouping, and no join.
    """
    own = F.struct("conv_id", F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    g = turns.where("conv_id IS NOT NULL").select(F.shiftright("conv_id", 1).alias("pair"), own.alias("x")).groupBy("pair").agg(F.array_sort(F.collect_list("x")).alias("all"))
    g = g.select("pair", "all", F.explode(F.array_distinct(F.transform("all", lambda x: x["conv_id"]))).alias("conv_id"))
    of = lambda mine: F.transform(F.filter("all", lambda x: (x["conv_id"] == F.col("conv_id")) == F.lit(mine)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    g = g.select("conv_id", "pair", of(True).alias("turns"), of(False).alias("others"))
    is_answer = lambda c: F.transform(c, lambda x: x["role"] == "assistant")
    last = lambda c: F.when(F.array_contains(is_answer(c), True), F.size(c) - F.array_position(F.reverse(is_answer(c)), True) + 1).cast("int")
    g = g.withColumns({"last": last("turns"), "other_last": last("others")})
    end, other_end = F.coalesce("last", F.lit(1)), F.coalesce("other_last", F.lit(1))
    chosen = F.when(F.col("last").isNotNull(), F.slice("turns", F.lit(1), end)).otherwise(F.col("turns"))
    half = F.floor((end - 1) / 2).cast("int")
    there = F.least(half, other_end - 1)
    swapped = F.concat(F.slice("turns", F.lit(1), end - 1), F.slice("others", other_end, F.lit(1)))
    parted = F.concat(F.slice("turns", F.lit(1), half), F.slice("others", there + 1, other_end - there))
    rejected = F.when(F.col("last").isNotNull() & F.col("other_last").isNotNull(), F.when(F.pmod("pair", F.lit(2)) == 0, swapped).otherwise(parted))
    return g.select(F.col("conv_id").alias("pair_id"), chosen.alias("chosen"), rejected.alias("rejected"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["from"].cast("string"), F.lit("-"), s["to"].cast("string"))), ",")


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_pairs(with_swapped_answers(table(spark, sf_dir, "conversations")))
    return made.withColumns({c: joined(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


PREFERENCES_SQL = """
WITH t AS (SELECT conv_id, list({'role': coalesce(role, 'user'), 'text': coalesce(text, '')} ORDER BY coalesce(turn, 0), coalesce(role, 'user'), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT conv_id, turns, (SELECT max(i) FROM range(1, len(turns) + 1) AS r(i) WHERE turns[i].role = 'assistant') AS last FROM t),
p AS (SELECT a.conv_id AS pair_id, CASE WHEN a.last IS NULL THEN a.turns ELSE a.turns[1:a.last] END AS c,
  CASE WHEN a.last IS NOT NULL AND b.last IS NOT NULL THEN CASE WHEN (a.conv_id >> 1) % 2 = 0 THEN list_concat(a.turns[1:a.last - 1], [b.turns[b.last]])
    ELSE list_concat(a.turns[1:(a.last - 1) // 2], b.turns[least((a.last - 1) // 2, b.last - 1) + 1:b.last]) END END AS r
  FROM a LEFT JOIN a b ON xor(a.conv_id, 1) = b.conv_id),
n AS (SELECT *, CASE WHEN r IS NULL THEN len(c) ELSE coalesce((SELECT min(i) - 1 FROM range(1, least(len(c), len(r)) + 1) AS q(i) WHERE c[i] <> r[i]), least(len(c), len(r))) END AS k FROM p),
s AS (SELECT pair_id, k, c[1:k] AS p, CASE WHEN r IS NOT NULL THEN c[k+1:] END AS c, CASE WHEN r IS NOT NULL THEN r[k+1:] END AS r FROM n),
l AS (SELECT *,
  list_transform(p, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS ps,
  list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS cs,
  list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS rs FROM s)
SELECT pair_id, k::BIGINT AS prompt_turns, coalesce(array_to_string(ps, ''), '') AS prompt,
  array_to_string(cs, '') AS chosen,
  array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: (length(array_to_string(cs[1:i-1], '')) + 14)::VARCHAR || '-' || length(array_to_string(cs[1:i], ''))::VARCHAR), ',') AS chosen_spans,
  array_to_string(rs, '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: (length(array_to_string(rs[1:i-1], '')) + 14)::VARCHAR || '-' || length(array_to_string(rs[1:i], ''))::VARCHAR), ',') AS rejected_spans
FROM l"""

QUERIES = {"op8_preferences": op8_preferences}
ORACLES = {"op8_preferences": PREFERENCES_SQL}
