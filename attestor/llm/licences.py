"""Licence scans: units of text against licence templates by Dice coefficient over word bigrams (DataFrame functions only).

A unit is a line, or the whole text: licences are named in a line or given in
full. Units and templates are normalised alike: lower case, no marks, runs of
digits kept, single spaces. Dice of two sets A and B is 2 |A and B| / (|A| + |B|).

Size bounds: Dice of at least t needs |A| between t / (2 - t) and (2 - t) / t
times |B|. A unit whose size fits no template is dropped before its bigrams are
made, and of the others only those templates are compared whose bounds it fits
and of which it holds at least one word that no other wording could replace:
since A and B must share t |B| / (2 - t) bigrams, one of the template's first
words in a fixed order must occur in the unit, as in a prefix filter.

The result has a row for each document, with its best unit and template.

``op5_licence_passages`` finds licences of several lines inside longer texts, and
every licence of a text: its units are all runs of adjacent lines, word pairs
across line ends included, and its templates also whole licences and notices. A
run counts from 0.43 to 2.33 times the template's bigrams (the size bounds, with
repeated ones counted). It begins and ends in lines with a bigram of the
template, since other lines at its ends only lower the coefficient; and a text
must hold so many of the template's bigrams that a run can reach the threshold,
which few do. Of runs that overlap the better one holds.

Defined results: a null or empty text has no units, so no licence and 0 units;
a text of one line is one unit; units of one word have no bigrams and match
nothing; of equal coefficients the template first by name, then the first unit
holds; very long texts are read whole; rows that repeat give rows that repeat;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.6

#: Short wordings by which documents name their licence, and openings of full texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Whole licences and notices of several lines. Full texts of GPL and Apache quote their notice, and MPL its sentence, at the end.
_MIT = "to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = TEMPLATES["bsd-2-clause"] + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
WHOLE = TEMPLATES | {
    "apache-2.0-notice": TEMPLATES["apache-2.0-header"] + " See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause-full": _BSD + _BSD_END,
    "bsd-3-clause-full": _BSD + _BSD_3 + _BSD_END,
    "gpl-2.0-notice": _GPL.format(2),
    "gpl-3.0-notice": _GPL.format(3),
    "isc-full": TEMPLATES["isc"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-full": "Permission is hereby granted, free of charge, " + _MIT,
}


def normalised(text: Column) -> Column:
    """Lower case ASCII letters and digits, other runs as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def _bigrams(text: str) -> list[str]:
    w = _plain(text).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bigrams(norm: Column) -> Column:
    """The distinct word bigrams of a normalised text."""
    w = F.split(norm, " ")
    return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_units, licence, dice, unit (0: whole text, n: line n), unit_bigrams."""
    known = {name: _bigrams(text) for name, text in sorted(templates.items())}
    low = min(threshold / (2 - threshold) * len(b) for b in known.values())
    high = max((2 - threshold) / threshold * len(b) for b in known.values())

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.coalesce("text", F.lit(""))), lines)).otherwise(lines)
    numbered = F.transform(units, lambda u, n: F.struct(n.alias("unit"), u.alias("raw")))
    # what a unit must hold of each template: the words of the bigrams that can't all be missing
    must = "|".join(sorted({w for b in known.values() for w in _needed_words(b, threshold)}))
    fit = F.filter(numbered, lambda s: F.lower(s["raw"]).rlike(rf"(?<![a-z0-9])(?:{must})(?![a-z0-9])"))
    found = docs.select("doc_id", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, 0).otherwise(F.size(units)).alias("n_units"), fit.alias("fit"))

    def against(norm_bigrams: Column) -> Column:
        n = F.size(norm_bigrams)
        each = []
        for name, b in known.items():
            inside = n.between(F.lit(threshold / (2 - threshold) * len(b)), F.lit((2 - threshold) / threshold * len(b)))
            dice = F.when(inside, 2.0 * F.size(F.array_intersect(norm_bigrams, F.array(*map(F.lit, b)))) / (n + len(b))).otherwise(0.0)
            each.append(F.struct((-dice).alias("minus"), F.lit(name).alias("name")))
        return F.array_min(F.array(*each))

    made = F.transform("fit", lambda s: F.struct(s["unit"].alias("unit"), bigrams(normalised(s["raw"])).alias("b")))
    sized = F.filter(made, lambda s: F.size(s["b"]).between(F.lit(low), F.lit(high)))
    scored = F.transform(sized, lambda s: F.struct(against(s["b"]).alias("best"), s["unit"].alias("unit"), F.size(s["b"]).alias("n")))
    best = F.array_min(F.filter(scored, lambda s: s["best"]["minus"] <= -threshold))
    found = found.select("doc_id", "n_units", best.alias("best"))
    return found.select(
        "doc_id",
        F.col("n_units").cast("long").alias("n_units"),
        F.col("best.best.name").alias("licence"),
        F.round(-F.col("best.best.minus"), 6).alias("dice"),
        F.col("best.unit").cast("long").alias("unit"),
        F.col("best.n").cast("long").alias("unit_bigrams"),
    )


def _needed_words(b: list[str], threshold: float) -> list[str]:
    """Words of which a unit of Dice >= threshold has one: those of so many bigrams that not all can be missing.

    The unit lacks at most |B| - ceil(t |B| / (2 - t)) of the template's bigrams, so of any one more it has one,
    and both words of it. Bigrams with the longest words, which are the rarest, are chosen.
    """
    least = math.ceil(threshold * len(b) / (2 - threshold) - 1e-9)
    chosen = sorted(b, key=lambda g: (-max(map(len, g.split())), g))[: len(b) - least + 1]
    return sorted({max(g.split(), key=len) for g in chosen})


def _least(n: int, threshold: float) -> int:
    """How many of a template's n bigrams a unit of Dice >= threshold has."""
    return math.ceil(threshold * n / (2 - threshold) - 1e-9)


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with these columns, computed once a row: the optimiser moves no expression through an explode, so not into lambdas either."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("_made")).select(*df.columns, *(F.col(f"_made.{k}").alias(k) for k in made))


def passages(docs: DataFrame, templates: dict[str, str] = WHOLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, matches: array of (licence, dice, from_line, to_line, n_bigrams), not overlapping, best first."""
    known = [(name, _bigrams(text)) for name, text in sorted(templates.items())]
    must = "|".join(sorted({w for _, b in known for w in _needed_words(b, threshold)}))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(_least(len(b), threshold)).alias("least"), F.array(*map(F.lit, b)).alias("b")) for k, (_, b) in enumerate(known)))
    every = F.array(*map(F.lit, sorted({g for _, b in known for g in b})))
    names, grams, sizes = F.array(*(F.lit(n) for n, _ in known)), F.array(*(F.array(*map(F.lit, b)) for _, b in known)), F.array(*(F.lit(len(b)) for _, b in known))

    text = F.coalesce("text", F.lit(""))
    lines = F.when(F.lower(text).rlike(rf"(?<![a-z0-9])(?:{must})(?![a-z0-9])"), F.split(text, "\n")).otherwise(F.array().cast("array<string>"))
    # a word, its line, and how many words of the line are before and from it
    d = _once(docs.select("doc_id", "text"), ln=F.transform(lines, lambda x: F.filter(F.split(normalised(x), " "), lambda w: w != ""))).drop("text")
    in_line = lambda ws, n: F.transform(ws, lambda w, k: F.struct(w.alias("w"), n.alias("line"), k.alias("before"), (F.size(ws) - k).alias("rest")))
    d = _once(d, w=F.flatten(F.transform("ln", in_line))).drop("ln")
    n = F.greatest(F.size("w") - 1, F.lit(0))
    d = _once(d, g=F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat(a["w"], F.lit(" "), b["w"])))
    d = _once(d, mine=F.array_intersect("g", every))
    d = _once(d, held=F.filter(kinds, lambda t: F.size(F.array_intersect("mine", t["b"])) >= t["least"])["k"]).drop("mine")
    # where runs begin and end, as places of words, from 1
    hits = lambda k: F.filter(F.transform("g", lambda g, p: F.struct(F.array_contains(F.get(grams, k), g).alias("on"), p.alias("p"))), lambda x: x["on"])["p"]
    d = _once(d, at=F.transform("held", lambda k: F.struct(k.alias("k"), hits(k).alias("p"))))
    ends = F.transform("at", lambda t: F.struct(
        t["k"].alias("k"),
        F.array_distinct(F.transform(t["p"], lambda p: p + 1 - F.get("w", p)["before"])).alias("first"),
        F.array_distinct(F.transform(t["p"], lambda p: p + 1 + F.get("w", p + 1)["rest"])).alias("last"),
    ))
    d = _once(d, ends=ends).drop("at")
    fits = lambda t, i, j: (j - i).between(F.ceil(F.get(sizes, t["k"]) * low - 1e-9), F.floor(F.get(sizes, t["k"]) * high + 1e-9))
    runs = lambda t: F.flatten(F.transform(t["first"], lambda i: F.transform(F.filter(t["last"], lambda j: fits(t, i, j)), lambda j: F.struct(t["k"].alias("k"), i.alias("i"), j.alias("j")))))
    d = _once(d, runs=F.flatten(F.transform("ends", runs))).drop("ends")
    of = lambda r: F.slice("g", r["i"], r["j"] - r["i"])
    counted = F.transform("runs", lambda r: F.struct(r["k"].alias("k"), r["i"].alias("i"), r["j"].alias("j"), F.size(F.array_distinct(of(r))).alias("n"), F.size(F.array_intersect(of(r), F.get(grams, r["k"]))).alias("shared")))
    d = _once(d, counted=counted).drop("runs", "g")
    scored = F.transform("counted", lambda r: F.struct((-2.0 * r["shared"] / (r["n"] + F.get(sizes, r["k"]))).alias("minus"), F.get(names, r["k"]).alias("name"), r["i"].alias("i"), r["j"].alias("j"), r["n"].alias("n")))
    d = _once(d, good=F.array_sort(F.filter(scored, lambda r: r["minus"] <= -threshold))).drop("counted")
    none = F.array().cast("array<struct<minus:double,name:string,i:int,j:int,n:int>>")
    apart = lambda acc, r: ~F.exists(acc, lambda a: (a["i"] <= r["j"]) & (r["i"] <= a["j"]))
    d = _once(d, best=F.aggregate("good", none, lambda acc, r: F.when(apart(acc, r), F.concat(acc, F.array(r))).otherwise(acc))).drop("good")
    line = lambda p: (F.get("w", p - 1)["line"] + 1).cast("long")
    return d.select("doc_id", F.transform("best", lambda r: F.struct(r["name"].alias("licence"), F.round(-r["minus"], 6).alias("dice"), line(r["i"]).alias("from_line"), line(r["j"]).alias("to_line"), r["n"].cast("long").alias("n_bigrams"))).alias("matches"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_licence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def licences_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in sorted(TEMPLATES.items()))
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))"
    return f"""
WITH tw AS (SELECT name, string_split({norm.format("t")}, ' ') AS w FROM (VALUES {rows}) AS v(name, t)),
tpl AS (SELECT name, {grams} AS tb FROM tw),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, 0 AS unit, text AS raw FROM d UNION ALL
  SELECT r, CASE WHEN contains(text, chr(10)) THEN i ELSE 0 END, ls[i] FROM (SELECT r, text, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d) WHERE contains(text, chr(10))),
w AS (SELECT r, unit, string_split({norm.format("raw")}, ' ') AS w FROM u),
b AS (SELECT r, unit, {grams} AS ub FROM w),
x AS (SELECT r, unit, name, len(ub) AS n, 2.0::DOUBLE * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) AS dice FROM b, tpl WHERE 2.0 * least(len(ub), len(tb)) >= {THRESHOLD} * (len(ub) + len(tb))),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, name, unit) AS k FROM x WHERE dice >= {THRESHOLD})
SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 WHEN contains(text, chr(10)) THEN len(string_split(text, chr(10))) + 1 ELSE 1 END::BIGINT AS n_units,
  name AS licence, round(dice, 6) AS dice, unit::BIGINT AS unit, n::BIGINT AS unit_bigrams
FROM d LEFT JOIN best ON best.r = d.r AND k = 1"""


QUERIES = {"op5_licences": op5_licences, "op5_licence_passages": op5_licence_passages}
ORACLES = {"op5_licences": licences_sql()}
