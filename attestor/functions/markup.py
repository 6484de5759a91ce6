"""Columns over HTML: a page's tags as an array of tokens, and what is asked of them.

One pattern goes over a page from tag to tag: comments, elements whose text is no
markup, and tags, in whose attributes a quote counts only after an equals sign.
All loops of the pattern are possessive, so broken pages cost linear time.
"""

from __future__ import annotations

import html as entities
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+[^>=]*+)*+"""
REFERENCE = re.compile("&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)")
#: Elements whose text is not searched for tags.
RAW = ("script", "style", "textarea", "title")
TOKEN = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{t}(?=[\s/>]){ATTRIBUTES}>.*?(?:</{t}(?=[\s/>])[^>]*+>|\z)" for t in RAW) + rf"|<[a-z][^\s/>=]*+{ATTRIBUTES}>"
ATTRIBUTE = r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?"""


def let(value: Column, f) -> Column:
    """f(value), for which ``value`` is computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(html: Column, tags: tuple[str, ...]) -> Column:
    """The tags of these names, in order: array of (tag, names, values, body); names in lower case, body for elements without markup inside."""
    wanted = rf"(?i)^<(?:{'|'.join(tags)})[\s/>]"

    def token(t: Column) -> Column:
        opened = F.regexp_extract(t, rf"(?is)^<([a-z][^\s/>=]*+)({ATTRIBUTES})>", 2)
        unquoted = lambda v: F.when(v.rlike("""^["']"""), F.substr(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0)))).otherwise(v)
        return F.struct(
            F.lower(F.regexp_extract(t, r"^<([A-Za-z][^\s/>=]*)", 1)).alias("tag"),
            F.transform(F.regexp_extract_all(opened, F.lit(ATTRIBUTE), F.lit(1)), F.lower).alias("names"),
            F.transform(F.regexp_extract_all(opened, F.lit(ATTRIBUTE), F.lit(2)), unquoted).alias("values"),
            F.regexp_extract(t, rf"(?is)^<(?:{'|'.join(RAW)}){ATTRIBUTES}>(.*?)(?:</[a-z]+[^>]*>)?\z", 1).alias("body"),
        )

    return F.transform(F.filter(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(wanted)), token)


def attribute(token: Column, name: str) -> Column:
    """The first attribute of this name; null without one."""
    return F.get(token["values"], F.array_position(token["names"], name).cast("int") - 1)


def first_of(tokens: Column, tag: str, test, name: str) -> Column:
    """An attribute of the first ``tag`` for which the test holds."""
    return attribute(F.get(F.filter(tokens, lambda t: (t["tag"] == tag) & F.coalesce(test(t), F.lit(False))), F.lit(0)), name)


def meta(tokens: Column, name: str) -> Column:
    """The content of the first meta element with this property, else of the first with this name; null without one."""
    has = lambda key: F.exists(tokens, lambda t: (t["tag"] == "meta") & F.coalesce(attribute(t, key) == name, F.lit(False)))
    of = lambda key: first_of(tokens, "meta", lambda t: attribute(t, key) == name, "content")
    return F.trim(F.when(has("property"), of("property")).otherwise(of("name")))


def rel(token: Column, word: str) -> Column:
    """Whether one of the words of the token's ``rel`` is this, in any case."""
    return F.array_contains(F.split(F.lower(attribute(token, "rel")), r"\s+"), word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescaped(values: pd.Series) -> pd.Series:
    """Texts with their character references resolved; a name counts only with its semicolon, so what a text cut short or a URL's parameters begin with stays."""
    one = lambda m: html5.get(m[0][1:], m[0]) if m[0][1] != "#" else entities.unescape(m[0])
    return values.map(lambda vs: None if vs is None else [None if v is None else REFERENCE.sub(one, v) for v in vs])


def json_blocks(tokens: Column) -> Column:
    """JSON objects of the scripts with linked data: each block that parses is one, or a list of them."""
    scripts = F.filter(tokens, lambda t: (t["tag"] == "script") & F.coalesce(attribute(t, "type") == "application/ld+json", F.lit(False)))
    bodies = F.filter(F.transform(scripts, lambda t: t["body"]), lambda b: F.try_parse_json(b).isNotNull())
    return F.flatten(F.transform(bodies, lambda b: F.when(F.ltrim(b).startswith("["), F.from_json(b, "array<string>")).otherwise(F.array(b))))
