"""Observed profile fields with their provenance, and the indicators that profiles give.

A field that is present but breaks its contract counts as nothing, without
falling back; one that is absent may be filled from elsewhere. Inference names
what it is derived from, and what an operator typed in is no observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALARS = ("display_name", "bio", "website", "location", "organization", "public_email", "public_id", "avatar_url")
LISTS = ("external_links", "social_links")
#: Where titles come from that are no one's name.
TITLE_METHODS = ("html_title", "html_og.title")
#: Wordings of page titles that name no person.
GENERIC_NAMES = [
    r"music\s+profile",
    r"user\s+profile",
    r"wordpress\s+user\s+profile",
    r"['’]s\s+profile(?:\s+on\s+.+)?$",
    r"profile\s+on\s+.+$",
    r"\bprofile\b",
    r"cyber\s*security(?:\s+training)?",
    r"(?:online\s+)?(?:security\s+)?training",
    r"(?:online\s+)?courses?",
    r"learn(?:ing)?\s+(?:online|cybersecurity|code|coding|programming)",
    r"build\s+software(?:\s+faster)?",
    r"where\s+(?:the\s+)?world\s+builds\s+software",
    r"let['’]s\s+build\s+from\s+here",
    r"container\s+image\s+library",
    r"developer\s+community",
    r"official\s+(?:site|website|page)",
    r"home(?:\s+page)?$",
]
#: Names of platforms that stand as titles, besides those of the site catalog.
PLATFORM_NAMES = """
    github;gitlab;tryhackme;docker;docker hub;instagram;threads;tiktok;x;twitter;reddit;pinterest;steam;steam community;telegram;last.fm;
    replit;pypi;kofi;ko-fi;chess.com;gog;wordpress;dev community;dev.to
""".replace("\n    ", "").strip().split(";")
#: What a title that also holds the handle says about its page.
TITLE_TOKENS = "profile last.fm wordpress gog gitlab github docker tryhackme".split()
TITLE_PARTS = r"\s*[|·•—–:]\s*|\s+-\s+"
HANDLE = r"(?<![A-Za-z0-9_])@([A-Za-z0-9_]{3,32})\b"


def generic_name(name: Column, handle: Column, platform: Column) -> Column:
    """Whether a display name says nothing: empty, the handle, a platform, or a page's title."""
    n = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    h = F.lower(F.regexp_replace(F.trim(F.coalesce(handle, F.lit(""))), "^@+", ""))
    known = lambda c: c.isin(PLATFORM_NAMES) | F.coalesce(c == F.lower(F.trim(platform)), F.lit(False))
    worded = lambda c: c.rlike("|".join(GENERIC_NAMES))
    titled = F.lit(False)
    for token in TITLE_TOKENS:
        titled = titled | n.contains(token)
    as_word = F.regexp_like(n, F.concat(F.lit(r"\b\Q"), h, F.lit(r"\E\b")))
    parts = F.filter(F.split(n, TITLE_PARTS), lambda x: F.trim(x) != "")
    of_parts = (F.size(parts) >= 2) & F.forall(parts, lambda x: known(F.trim(x)) | worded(F.trim(x)))
    of_handle = (h != "") & ((n == h) | (F.replace(n, F.lit(" "), F.lit("")) == h) | (titled & as_word))
    return F.coalesce((n == "") | of_handle | known(n) | of_parts | worded(n), F.lit(True))


def valid(rows: DataFrame) -> DataFrame:
    """rows(field, value, values, source, source_url, method, derived_from, rejected_by) with ``reason``, null if the contract holds."""
    reason = (
        F.when(F.col("source").isNull(), "no_source")
        .when(F.col("field").isin(*SCALARS) & F.col("values").isNotNull(), "scalar_as_list")
        .when(F.col("field").isin(*LISTS) & F.col("value").isNotNull(), "list_as_scalar")
        .when((F.col("method") == "INPUT") & F.col("source_url").isNotNull(), "input_with_url")
        .when((F.col("method") == "DERIVED") & F.col("derived_from").isNull(), "derived_from_nothing")
    )
    return rows.withColumn("reason", reason)


def active(rows: DataFrame) -> DataFrame:
    """Rows that hold: contract kept, not rejected, and no name from a title."""
    return valid(rows).where("reason IS NULL AND rejected_by IS NULL").where(~((F.col("field") == "display_name") & F.coalesce(F.col("method").isin(*TITLE_METHODS), F.lit(False)))).drop("reason")


def enrich(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates(keys, field, prio, value, source) -> for each field the first value, or of lists all values, in order of priority."""
    c = candidates.where(F.coalesce(F.trim("value"), F.lit("")) != "")
    scalar = c.where(F.col("field").isin(*SCALARS)).groupBy(*keys, "field").agg(F.min_by("value", "prio").alias("value"), F.min_by("source", "prio").alias("source"), F.count("*").alias("n"))
    first = c.where(F.col("field").isin(*LISTS)).groupBy(*keys, "field", "value").agg(F.min("prio").alias("prio"), F.min_by("source", "prio").alias("source"))
    lists = first.groupBy(*keys, "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prio", "value"))), lambda x: x["value"]), ",").alias("value"), F.min_by("source", "prio").alias("source"), F.count("*").alias("n"))
    return scalar.unionByName(lists)


def flatten(fields: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each profile, one column for each field."""
    return fields.groupBy(*keys).pivot("field", [*SCALARS, *LISTS]).agg(F.first("value"))


def indicators(profiles: DataFrame) -> DataFrame:
    """profiles(id, profile_url, website, public_email, bio, links) -> (id, kind, value, rule), each once."""
    from attestor.functions.urls import host_of

    one = lambda kind, c, rule: F.struct(F.lit(kind).alias("kind"), c.alias("value"), F.lit(rule).alias("rule"))
    each = lambda kind, values, rule: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: one(kind, v, rule))
    found = F.concat(
        F.array(one("url", F.col("profile_url"), "profile_url"), one("domain", host_of(F.col("profile_url")), "profile_host"), one("url", F.col("website"), "website"), one("domain", host_of(F.col("website")), "personal_domain"), one("email", F.lower("public_email"), "public_email")),
        each("url", F.col("links"), "external_links"),
        each("username", F.regexp_extract_all("bio", F.lit(HANDLE), F.lit(1)), "bio_handle"),
    )
    rows = profiles.select("id", F.posexplode(found).alias("ord", "i")).select("id", "ord", "i.*").where("value <> ''")
    return rows.groupBy("id", "kind", F.lower("value").alias("key")).agg(F.min_by(F.struct("value", "rule"), "ord").alias("r")).select("id", "kind", "r.value", "r.rule")
