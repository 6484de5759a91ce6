"""Flat views of findings, groups of mentions, coverage, and what a case knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.ids import plain_name
from attestor.functions.urls import host_of, path_of, query_of
from attestor.sources.steps import cut

SUMMARIES = ("Username sweep", "Identity correlation")
RELEVANCE = {"DIRECT": 0, "ASSOCIATED": 1, "AMBIGUOUS": 2}
#: Names of mention services as reports show them.
LABELS = {
    "duckduckgo-html": "DuckDuckGo",
    "google-cse": "Google CSE",
    "hn-algolia": "Hacker News",
    "github-search": "GitHub",
    "reddit-search": "Reddit",
    "public-documents": "Public documents",
}


def _field(*names: str) -> Column:
    """The first of several fields of the data that isn't empty."""
    values = [F.get_json_object("data", f"$.{n}") for n in names]
    return F.coalesce(*(F.when(v != "", v) for v in values))


def flat_rows(findings: DataFrame) -> DataFrame:
    """findings(case_id, ord, target, module, title, status, confidence, summary, ts, data: JSON text) -> a row for each checked site, missing fields filled as reports show them."""
    f = findings.where((F.col("module") == "username") & ~F.col("title").isin(*SUMMARIES))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return f.select(
        "case_id",
        "ord",
        F.coalesce(_field("platform"), "title").alias("platform"),
        F.coalesce(_field("username"), "target").alias("username"),
        F.coalesce(_field("check_status", "verification_status", "status"), "status").alias("status"),
        F.col("status").alias("finding_status"),
        empty(F.col("confidence")).alias("confidence"),
        empty(_field("profile_url", "final_url")).alias("profile_url"),
        F.coalesce(_field("reason", "error"), "summary").alias("detail"),
        _field("http_status").cast("int").alias("http_status"),
        F.when(F.col("status") == "FOUND", "yes").otherwise("").alias("evidence"),
        F.coalesce(_field("checked_at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("checked_at"),
        "summary",
        F.coalesce(_field("access_mode"), F.lit("ANONYMOUS_PUBLIC")).alias("access_mode"),
        F.coalesce(_field("cache_state"), F.lit("LIVE")).alias("cache_state"),
        *(empty(_field(c)).alias(c) for c in ("anonymous_status", "authenticated_status", "session_status")),
        _field("cache_age_seconds").cast("double").alias("cache_age_seconds"),
    )


def eligible_records(findings: DataFrame) -> DataFrame:
    """Records to compare, from checked profiles that are there: names, places and texts in the form that is compared."""
    f = findings.where((F.col("module") == "username") & ~F.col("title").isin(*SUMMARIES))
    f = f.where(_field("check_status").isin("CONFIRMED", "LIKELY") & _field("not_profile").isNull() & ~F.coalesce(_field("kind"), F.lit("")).isin("name", "email", "domain"))
    text = lambda n: F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(_field(n), F.lit("")))), r"\s+", " "))
    name = lambda n: plain_name(F.coalesce(_field(n), F.lit("")))
    return f.select(
        "case_id",
        "ord",
        F.coalesce(_field("platform"), "title").alias("platform"),
        F.lower(F.regexp_replace(F.trim(F.coalesce(_field("username"), F.lit(""))), "^@+", "")).alias("username"),
        F.coalesce(_field("profile_url", "final_url"), F.lit("")).alias("profile_url"),
        name("display_name").alias("display_name"),
        name("organization").alias("organization"),
        name("location").alias("location"),
        text("bio").alias("bio"),
        text("public_email").alias("email"),
    )


def mention_key(url: Column) -> Column:
    """A mention's URL without fragment and last slashes, its host in lower case; the query stays."""
    u = F.trim(url)
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    path = F.regexp_replace(path_of(u), "/+$", "")
    query = query_of(u)
    whole = F.concat(F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), F.lower(authority), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(authority != "", whole).otherwise(F.lower(F.regexp_replace(u, "/+$", "")))


def label(provider: Column) -> Column:
    out = F.when(F.trim(provider) == "", "unknown").otherwise(F.trim(provider))
    for name, shown in LABELS.items():
        out = F.when(F.trim(provider) == name, shown).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def mention_cards(mentions: DataFrame) -> DataFrame:
    """mentions(query, kind, url, title, relevance, provider, ord) -> one card for each query and URL, with its sources in order and its place in the group; those without URL stay apart."""
    key = F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))
    first = F.min_by(F.struct("kind", "url", "title", "relevance"), "ord").alias("m")
    # a source counts once, where it comes first
    by_source = mentions.groupBy("query", key.alias("key"), "provider").agg(F.min("ord").alias("at"), first)
    cards = by_source.groupBy("query", "key").agg(F.min_by("m", "at").alias("m"), F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "provider"))).alias("s"))
    rank = F.lit(9)
    for name, k in RELEVANCE.items():
        rank = F.when(F.col("m.relevance") == name, k).otherwise(rank)
    place = F.row_number().over(Window.partitionBy("query").orderBy(rank, F.coalesce("m.title", F.lit("")), "at"))
    return cards.select("query", "m.*", F.array_join(F.transform("s", lambda x: label(x["provider"])), ", ").alias("observed_by"), F.size("s").cast("long").alias("sources"), place.cast("long").alias("place"))


def coverage(hits: DataFrame, cap: int = 5) -> DataFrame:
    """hits(provider, kind, url, query, matched: null if nothing matches, ord) -> for each provider what was parsed, matched, kept and rejected, and why.

    Keys are taken in order over all providers: of equal ones the first may be kept; a provider keeps ``cap``.
    """
    valid = F.trim("url").rlike("^https?://[^/]")
    h = hits.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("hit", F.col("valid") & F.col("matched").isNotNull())
    key = F.struct(mention_key(F.col("url")).alias("u"), F.lower(F.trim("query")).alias("q"), F.lower(F.trim("matched")).alias("m"))
    h = h.withColumn("key", F.when(F.col("hit"), key))
    first = h.where("hit").groupBy("key").agg(F.min("ord").alias("first"))
    h = h.join(first, "key", "left").withColumn("fresh", F.col("hit") & (F.col("ord") == F.col("first")))
    n = h.groupBy("provider", "kind").agg(
        F.count("*").alias("raw"),
        F.count_if("valid").alias("parsed"),
        F.count_if("hit").alias("matched"),
        F.least(F.count_if("fresh"), F.lit(cap)).alias("deduped"),
        F.count_if(F.col("valid") & ~F.col("hit")).alias("rejected_no_exact_match"),
        F.count_if(~F.col("valid")).alias("rejected_invalid_url"),
        F.count_if(F.col("hit") & ~F.col("fresh")).alias("rejected_duplicate"),
    )
    return n


def unique_in_order(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The distinct values of a group in any case, each in its first spelling, in the order of their first places."""
    first = rows.where(F.trim(value) != "").groupBy(*keys, F.lower(F.trim(value)).alias("low")).agg(F.min(order).alias("at"), F.min_by(F.trim(value), order).alias("v"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), ",").alias("values"))


def summary(findings: DataFrame, mentions: DataFrame) -> DataFrame:
    """What a case knows: places of at least two profiles, sites, counts, how mentions relate, and up to six next steps."""
    f = flat_rows(findings).join(findings.select("case_id", "ord", F.get_json_object("data", "$.location").alias("location"), F.get_json_object("data", "$.website").alias("website")), ["case_id", "ord"])
    there = F.col("status").isin("CONFIRMED", "LIKELY")
    place = f.where(there & (F.col("location") != "")).groupBy("case_id", F.lower("location").alias("low")).agg(F.count("*").alias("n"), F.min_by("location", "ord").alias("location"), F.min("ord").alias("at"))
    place = place.groupBy("case_id").agg(F.max_by(F.struct("location", "n"), F.struct("n", -F.col("at"))).alias("p"))
    counts = f.groupBy("case_id").agg(F.count("*").alias("profile_checks"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("status") == "LIKELY").alias("likely"), F.count_if(there & (host_of(F.coalesce("website", F.lit(""))) != "")).alias("with_domain"))
    said = mentions.groupBy("case_id").agg(F.count("*").alias("mentions_total"), F.count_if(F.col("relevance") == "DIRECT").alias("direct"))
    j = counts.join(place, "case_id", "left").join(said, "case_id", "left").fillna(0, ["mentions_total", "direct"])
    found = F.col("confirmed") + F.col("likely")
    steps = F.array_compact(F.array(F.when(found < 3, "exact full-name search"), F.when(F.col("mentions_total") == 0, "search outside known platforms"), F.when(F.col("with_domain") > 0, "inspect public profile links")))
    steps = F.when(F.size(steps) == 0, F.array(F.lit("insufficient evidence for a further public pivot"))).otherwise(steps)
    return j.select("case_id", "profile_checks", "confirmed", "likely", F.when(F.col("p.n") >= 2, F.col("p.location")).alias("geographic_indicator"), "mentions_total", "direct", ((found == 0) & (F.col("mentions_total") == 0)).alias("insufficient_evidence"), F.array_join(steps, "; ").alias("next_steps"))


def with_known_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose ends are entities at hand; the others are left out."""
    ends = entities.select("id").distinct()
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def run_chains(runs: DataFrame) -> DataFrame:
    """runs(run_id, parent_run_id) -> run_id, the run that its chain of parents begins with, how many steps that is, and whether the chain runs in a circle.

    Each round doubles the steps that are taken at once and is written, until no
    chain goes on; what still does after as many rounds as the number of runs has
    binary digits has taken more steps than there are runs, so it is in a circle or
    leads to one: it has no root and no steps. A parent that isn't there ends a chain.
    """
    once = runs.groupBy("run_id").agg(F.max("parent_run_id").alias("parent"))
    known = once.select(F.col("run_id").alias("p"))
    at = cut(once.join(known, F.col("parent") == F.col("p"), "left").select("run_id", F.coalesce("p", "run_id").alias("root"), F.col("p").isNotNull().cast("long").alias("steps")), "chains")
    most = at.count()
    for _ in range(most.bit_length() + 1):
        further = at.select(F.col("run_id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        at = cut(at.join(further, "root").select("run_id", F.col("next").alias("root"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "chains")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    endless = F.col("steps") > most
    return at.select("run_id", F.when(~endless, F.col("root")).alias("root"), F.when(~endless, F.col("steps")).alias("steps"), endless.alias("circular"))
