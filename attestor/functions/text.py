"""Columns over free text: excerpts, redaction, mail records, HTML."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAIL_IN_TEXT = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
#: The same matches for Spark's expressions, which look for one only where a run of its characters begins, or where the last match ended.
EMAIL_RUN = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IPV4_IN_TEXT = r"(?:^|[^0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})"
HANDLE_IN_TEXT = r"(?:^|[^A-Za-z0-9_])@([A-Za-z0-9_]{3,32})\b"
HEX_IN_TEXT = r"\b[A-Fa-f0-9]{32,128}\b"

#: Forms of secrets in text, in the order in which they are masked.
SECRETS = {
    "assigned": r"(?i)(api[_-]?key|token|secret|authorization|bearer)([\"'\s:=]+)([^\s\"'&,]+)",
    "query": r"(?i)([?&](?:api[_-]?key|key|token|secret|password)=)([^&]+)",
    "sk": r"sk-[A-Za-z0-9_\-]{10,}",
    "ghp": r"ghp_[A-Za-z0-9]{20,}",
    "gho": r"gho_[A-Za-z0-9]{20,}",
    "github_pat": r"github_pat_[A-Za-z0-9_]{20,}",
    "slack": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[0-9A-Za-z\-_]{20,}",
    "session": r"(?i)(sessionid|csrftoken|auth_token|access_token|refresh_token)=([^\s;&]+)",
    "cookie": r"(?i)(cookie|set-cookie)([\"'\s:=]+)([^\s\"']+)",
}
#: Keys whose values are secret.
SENSITIVE_KEYS = """
    api_key apikey x-apikey authorization proxy-authorization cookie set-cookie token access_token refresh_token secret password passwd
    pass hibp-api-key x-otx-api-key key session sessionid csrf csrftoken csrf_token auth_token bearer cookies storage_state storagestate
""".split()
#: Keys that contain one of these are secret too.
SENSITIVE_TOKENS = "password secret token cookie bearer csrf".split()

#: Mail services by what their hosts contain.
MAIL_PROVIDERS = {
    "outlook.com": "Microsoft 365",
    "google.com": "Google Workspace",
    "googlemail.com": "Google Workspace",
    "protonmail.ch": "Proton",
    "proton.me": "Proton",
    "zoho.com": "Zoho",
    "zoho.eu": "Zoho",
    "amazonses.com": "AWS SES",
    "sendgrid.net": "SendGrid",
    "mailgun.org": "Mailgun",
    "emailsrvr.com": "Rackspace",
    "pphosted.com": "Proofpoint",
    "mimecast.com": "Mimecast",
    "messagelabs.com": "Symantec / MessageLabs",
}
#: What in headers or body tells of a delivery network or host.
TECH_HINTS = {
    "Cloudflare": ("cloudflare", "cf-ray", "__cf_bm"),
    "CloudFront": ("cloudfront", "x-amz-cf-id"),
    "Fastly": ("fastly", "x-served-by"),
    "Akamai": ("akamai", "x-akamai"),
    "AWS": ("awselb", "x-amz-id", "amazon"),
    "Azure": ("azure", "x-azure", "ms-azure"),
    "GCP": ("google frontend", "gws", "x-cloud-trace"),
    "Vercel": ("vercel", "x-vercel"),
    "Netlify": ("netlify", "x-nf-"),
    "GitHub Pages": ("github.com", "x-github"),
}


def squeezed(text: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, needle: Column, width: int = 90) -> Column:
    """The first place of ``needle``, in any case, with half of ``width`` around it and ellipses where text is cut off; the beginning of a text without it."""
    flat = F.coalesce(squeezed(text), F.lit(""))
    at = F.instr(F.lower(flat), F.lower(needle))
    start = F.greatest(F.lit(1), at - F.lit(width // 2))
    end = F.least(F.length(flat), at - 1 + F.length(needle) + F.lit(width // 2))
    part = F.substr(flat, start, end - start + 1)
    around = F.concat(F.when(start > 1, "…").otherwise(""), part, F.when(end < F.length(flat), "…").otherwise(""))
    return F.when(at > 0, around).otherwise(F.left(flat, F.lit(2 * width)))


def _marks() -> re.Pattern:
    """All characters that combine with the one before, from the Unicode tables at hand."""
    return re.compile("[" + "".join(chr(k) for k in range(0x300, 0x1F000) if unicodedata.combining(chr(k))) + "]")


MARKS = _marks()


@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def bare(text: str) -> str:
    return text if text.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", text))


@F.pandas_udf(T.StringType())
def _bare(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else bare(t))


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(bare(t).split()))


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD): ligatures, wide and raised forms are opened, marks follow their letters in canonical order.

    Spark has no function for it, so texts go to Python in Arrow batches, here and below.
    """
    return _nfkd(text)


def unmarked(text: Column) -> Column:
    """Decomposed, without marks."""
    return _bare(text)


def folded(text: Column) -> Column:
    """Decomposed, without marks, with single spaces; case is kept. Gaps are those of Unicode."""
    return _folded(text)


def folded_latin(text: Column) -> Column:
    """As ``folded``, for letters that Latin scripts write with marks only; for use inside of array functions."""
    return squeezed(F.regexp_replace(F.translate(text, MARKED, UNMARKED), r"\p{M}", ""))


def _marked() -> tuple[str, str]:
    letters = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if bare != c and len(bare) == 1:
            letters[c] = bare
    return "".join(letters), "".join(letters.values())


MARKED, UNMARKED = _marked()


def secret_counts(text: Column) -> dict[str, Column]:
    """How many places of each form of secret a text has."""
    return {name: F.regexp_count(text, F.lit(p)) for name, p in SECRETS.items()}


def sensitive_key(key: Column) -> Column:
    k = F.lower(key)
    out = k.isin(SENSITIVE_KEYS)
    for token in SENSITIVE_TOKENS:
        out = out | k.contains(token)
    return out


def title_of(html: Column) -> Column:
    """The text of the first title element, with single spaces."""
    return squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def anchors(html: Column) -> Column:
    """The targets of links, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))


def meta_content(html: Column, name: str) -> Column:
    """The content of a meta element by its name or property."""
    return F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)


def tech_hints(blob: Column) -> Column:
    """Names whose hints a lower-case text contains, in a fixed order."""
    found = []
    for name, needles in TECH_HINTS.items():
        any_of = F.lit(False)
        for n in needles:
            any_of = any_of | blob.contains(n)
        found.append(F.when(any_of, name))
    return F.array_compact(F.array(*found))


def mail_provider(host: Column) -> Column:
    out = F.lit(None).cast("string")
    for needle, name in reversed(MAIL_PROVIDERS.items()):
        out = F.when(F.lower(host).contains(needle), name).otherwise(out)
    return out


def spf_terms(txt: Column) -> Column:
    """(qualifier, mechanism, value) of an SPF record; a missing qualifier is +."""
    found = F.regexp_extract_all(txt, F.lit(r"(?i)([+\-~?]?(?:include|exists|redirect|ip4|ip6|all|ptr|exp|mx|a)\b(?::\S+)?)"), F.lit(1))
    first = lambda t: F.regexp_extract(t, r"^([+\-~?])", 1)
    terms = F.transform(found, lambda t: F.struct(F.when(first(t) == "", "+").otherwise(first(t)).alias("qualifier"), F.lower(F.regexp_extract(t, r"^[+\-~?]?([A-Za-z0-9]+)", 1)).alias("mechanism"), F.regexp_extract(t, r":(\S+)$", 1).alias("value")))
    return F.when(F.lower(txt).startswith("v=spf1"), terms)


def dmarc_tags(txt: Column) -> Column:
    """The tags of a DMARC record, keys in lower case."""
    parts = F.filter(F.split(txt, ";"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), F.trim(F.split_part(p, F.lit("="), F.lit(2))).alias("v")))
    return F.when(F.lower(txt).startswith("v=dmarc1"), F.map_from_entries(pairs))
