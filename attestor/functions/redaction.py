"""Secrets out of texts and out of JSON of any shape and depth.

Spark's functions need a schema to walk a tree, so JSON goes to Python in Arrow
batches; a walk keeps its own stack, so deep documents don't end it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.text import SECRETS, SENSITIVE_KEYS, SENSITIVE_TOKENS

_FORMS = [re.compile(p) for p in SECRETS.values()]


def masked(value: str, keep: int = 2) -> str:
    """A secret with its ends kept and at least four stars between; one of at most both ends is all stars."""
    n = len(value)
    return "*" * n if n <= 2 * keep else value[:keep] + "*" * max(4, n - 2 * keep) + value[-keep:]


def redact(text: str) -> str:
    """All forms of secrets masked, one form after the other: the last group of a form with groups, what stands between groups goes."""
    for form in _FORMS:
        text = form.sub(lambda m: "".join(m.groups()[:-1]) + masked(m.groups()[-1]) if m.lastindex and m.lastindex >= 2 else masked(m.group()), text)
    return text


def sensitive(key: str) -> bool:
    low = key.lower()
    return low in SENSITIVE_KEYS or any(t in low for t in SENSITIVE_TOKENS)


def stripped_key(key: str) -> bool:
    low = key.lower()
    return low in SENSITIVE_KEYS or "cookie" in low


def _mask_key(key: str, value: Any) -> tuple[bool, Any]:
    return sensitive(key), None if value is None else masked(str(value))


def rewritten(tree: Any, by_key: Callable[[str, Any], tuple[bool, Any]], drop: bool) -> Any:
    """A tree with redacted texts; what ``by_key`` says of a key's value stands in its place, or the key is dropped."""
    top = [tree]
    open_: list[tuple[Any, Any]] = [(top, 0)]
    while open_:
        holder, at = open_.pop()
        node = holder[at]
        if isinstance(node, str):
            holder[at] = redact(node)
        elif isinstance(node, list):
            open_ += [(node, k) for k in range(len(node))]
        elif isinstance(node, dict):
            for key in list(node):
                hit, instead = by_key(key, node[key])
                if not hit:
                    open_.append((node, key))
                elif drop:
                    del node[key]
                else:
                    node[key] = instead
    return top[0]


def _on_json(by_key, drop: bool):
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            tree = json.loads(text)
            return json.dumps(rewritten(tree, by_key, drop), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return redact(text)  # no JSON, or deeper than Python reads: a text

    return one


@F.pandas_udf(T.StringType())
def redacted_text(texts: pd.Series) -> pd.Series:
    """Texts with all forms of secrets masked."""
    return texts.map(lambda t: None if t is None else redact(t))


@F.pandas_udf(T.StringType())
def redacted_json(texts: pd.Series) -> pd.Series:
    """JSON with masked values under sensitive keys, at any depth, and redacted texts; keys stay in their order. What isn't JSON is a text."""
    return texts.map(_on_json(_mask_key, False))


@F.pandas_udf(T.StringType())
def stripped_json(texts: pd.Series) -> pd.Series:
    """JSON without what authenticates anyone, at any depth, and redacted texts."""
    return texts.map(_on_json(lambda key, _: (stripped_key(key), None), True))
