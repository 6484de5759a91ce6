"""Result lists out of search pages: each result's link and snippet, read in one pass."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Results(HTMLParser):
    """Elements of class ``result``, in the order in which they begin; within each the first link and the first snippet, with their texts."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.open: list[tuple[str, list]] = []  # an element's name and what ends with it
        self.names: Counter = Counter()
        self.inside: list[dict] = []
        self.texts: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes, ends = (attrs.get("class") or "").split(), []
        # what is in a result belongs to it, so a result's own classes don't count for itself
        for part, wanted in (("title", tag == "a" and "result__a" in classes), ("snippet", "result__snippet" in classes)):
            waiting = [r for r in self.inside if part not in r] if wanted else []
            if waiting:
                text: list[str] = []
                for row in waiting:
                    row[part] = text
                    if part == "title":
                        row["href"] = attrs.get("href") or ""
                if tag not in VOID:
                    self.texts.append(text)
                    ends.append(self.texts)
        if "result" in classes:
            row = {}
            self.rows.append(row)
            if tag not in VOID:
                self.inside.append(row)
                ends.append(self.inside)
        if tag not in VOID:
            self.open.append((tag, ends))
            self.names[tag] += 1

    def handle_endtag(self, tag):
        while self.names[tag]:  # an end tag ends all that is open inside; one without a beginning ends nothing
            name, ends = self.open.pop()
            self.names[name] -= 1
            for stack in ends:
                stack.pop()
            if name == tag:
                break

    def handle_data(self, data):
        if self.texts and data.strip() and not (self.open and self.open[-1][0] in ("script", "style")):
            for text in self.texts:
                text.append(data.strip())


def results(html: str) -> list[dict]:
    page = _Results()
    page.feed(html)
    page.close()
    joined = lambda row, part: " ".join(row[part]) if part in row else None
    return [{"title": joined(r, "title"), "href": r.get("href"), "snippet": joined(r, "snippet")} for r in page.rows]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "href", "snippet")])))
def result_list(pages: pd.Series) -> pd.Series:
    """The results of a search page, in order; one without a link has no href and no title."""
    return pages.map(lambda p: results(p) if p else [])
