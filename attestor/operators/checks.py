"""What a landed page says about a profile: rules as rows of a site table, in order; the first that holds decides."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import title_of
from attestor.functions.urls import bare_host, path_of, path_segments, query_of

from .observed import generic_name

#: How much of a page's source is searched for patterns.
SEARCHED = 12_000
MOST_PATTERNS = 100_000
LOGIN_PARTS = ("/login", "/signin", "/sign-in", "accounts/login", "/passport")
SEARCH_PARTS = ("/search", "q=", "query=", "/explore")
#: What a site's row may hold; patterns are regular expressions, tried in their order, in any case.
SITE = """name string, check_method string, requires_auth boolean, expected_status array<int>, not_found_status array<int>, captcha_patterns array<string>, challenge_patterns array<string>,
  blocked_patterns array<string>, login_patterns array<string>, not_found_patterns array<string>, soft_404_patterns array<string>, profile_markers array<string>, redirect_home string, redirect_search string, confidence_strategy string"""


def needle(handle: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(handle, F.lit(""))), "^@+", ""))


def token_in(text: Column, handle: Column) -> Column:
    """Whether a text names a handle, after an @ or as a word of its own."""
    t = F.lower(F.coalesce(text, F.lit("")))
    alone = F.regexp_like(t, F.concat(F.lit(r"(?<![a-z0-9_.-])\Q"), handle, F.lit(r"\E(?![a-z0-9_.-])")))
    return (handle != "") & (t.contains(F.concat(F.lit("@"), handle)) | alone)


def named_by_url(url: Column, handle: Column) -> Column:
    """Whether a whole part of the path, or the value of a parameter, is the handle."""
    u = F.lower(F.coalesce(url, F.lit("")))
    plain = lambda x: F.regexp_replace(x, "^@+", "")
    values = F.transform(F.split(query_of(u), "&"), lambda p: plain(F.try_url_decode(F.substring_index(p, "=", -1))))
    return (handle != "") & (F.array_contains(F.transform(path_segments(u), plain), handle) | F.coalesce(F.array_contains(values, handle) & query_of(u).contains("="), F.lit(False)))


def redirect_class(asked: Column, final: Column, handle: Column) -> Column:
    """Where a request ended: at the same place, a login, a search, the front page, elsewhere."""
    path = lambda u: F.regexp_replace(path_of(u), "/+$", "")
    low = F.lower(F.concat_ws(" ", path(final), query_of(final), final))
    holds = lambda parts: sum((low.contains(p).cast("int") for p in parts), F.lit(0)) > 0
    missing = (F.coalesce(asked, F.lit("")) == "") | (F.coalesce(final, F.lit("")) == "")
    return (
        F.when(missing | ((bare_host(asked) == bare_host(final)) & (path(asked) == path(final))), "same")
        .when(holds(LOGIN_PARTS), "login")
        .when(holds(SEARCH_PARTS), "search")
        .when((path(final) == "") & ~named_by_url(final, handle), "home")
        .otherwise("other")
    )


def tag_value(html: Column, tag: str, key: str, name: str, value: str) -> Column:
    """The attribute ``value`` of the first ``tag`` whose attribute ``key`` is or holds ``name``, in either order."""
    one = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*\b(?:{key})=[\"'][^\"']*{name}[^\"']*[\"'][^>]*\b{value}=[\"']([^\"']*)[\"']", 1)
    other = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*\b{value}=[\"']([^\"']*)[\"'][^>]*\b(?:{key})=[\"'][^\"']*{name}[^\"']*[\"']", 1)
    return F.when(one != "", one).otherwise(other)


def names_person(html: Column, handle: Column) -> Column:
    """Whether structured data of a person names the handle."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    each = F.flatten(F.transform(blocks, lambda b: F.when(F.ltrim(b).startswith("["), F.from_json(b, "array<string>")).otherwise(F.array(b))))
    kind = lambda b: F.lower(F.coalesce(F.get_json_object(b, "$['@type']"), F.get_json_object(b, "$.type"), F.lit("")))
    return F.coalesce(F.exists(each, lambda b: kind(b).contains("person") & token_in(b, handle)), F.lit(False))


def hit(haystack: Column, patterns: Column) -> Column:
    """The first pattern that is found; empty if none is."""
    return F.coalesce(F.get(F.filter(patterns, lambda p: F.regexp_like(haystack, F.concat(F.lit("(?i)"), p))), F.lit(0)), F.lit(""))


def searchable(sites: DataFrame) -> DataFrame:
    """Sites in which each pattern that is none stands for its own text, as one such pattern would end the whole job.

    The patterns of a catalog are compiled once, where the job begins; a catalog of more than ``MOST_PATTERNS`` is refused.
    """
    lists = [f.name for f in sites.schema if f.name.endswith(("_patterns", "_markers"))]
    used = sites.select(F.explode(F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in lists)))).alias("p")).distinct().limit(MOST_PATTERNS + 1).collect()
    if len(used) > MOST_PATTERNS:
        raise ValueError(f"a catalog of more than {MOST_PATTERNS} patterns")
    compiled = sites.sparkSession._jvm.java.util.regex.Pattern
    broken = []
    for r in used:
        try:
            compiled.compile(r["p"])
        except (Py4JJavaError, IllegalArgumentException):
            broken.append(r["p"])
    if not broken:
        return sites
    plain = lambda p: F.when(p.isin(broken), F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))).otherwise(p)
    return sites.withColumns({c: F.transform(c, plain) for c in lists})


def with_sites(pages: DataFrame, sites: DataFrame, megabytes: int = 32) -> DataFrame:
    """Pages with their site's row. A catalog of at most so many bytes goes to all tasks, so that a site of many pages isn't one task's; of a larger one each row is there once for each share of its pages."""
    size = sites.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= megabytes << 20:
        return pages.join(F.broadcast(sites), F.col("site") == F.col("name"))
    shares = 3 * pages.sparkSession.sparkContext.defaultParallelism
    dealt = pages.withColumn("_share", F.pmod(F.xxhash64(*(F.col(c) for c in ("url", "final_url", "handle", "html"))), F.lit(shares)))
    each = sites.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.join(each, (F.col("site") == F.col("name")) & (F.col("_share") == F.col("_of"))).drop("_share", "_of")


def page_signals(pages: DataFrame) -> DataFrame:
    """pages(url, final_url, html, handle, ...) with title, og_title, identity (where the handle is named), redirect and haystack."""
    h = needle(F.col("handle"))
    html = F.coalesce("html", F.lit(""))
    p = pages.withColumns({"h": h, "title": title_of(html), "canonical": tag_value(html, "link", "rel", "canonical", "href"), "og_url": tag_value(html, "meta", "property|name", "og:url", "content"), "og_title": tag_value(html, "meta", "property|name", "og:title", "content")})
    h = F.col("h")
    tests = {"canonical_match": named_by_url(F.col("canonical"), h), "og_url_match": named_by_url(F.col("og_url"), h), "title_match": token_in(F.col("title"), h), "og_title_match": token_in(F.col("og_title"), h), "jsonld_person": names_person(html, h)}
    identity = F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))
    hay = F.lower(F.concat_ws(" ", "title", F.left(html, F.lit(SEARCHED)), "final_url"))
    return p.withColumns({"identity": identity, "haystack": hay, "redirect": redirect_class(F.coalesce("url", "final_url"), F.col("final_url"), h)})


def _row(status: str, reason, confidence: str | None = None) -> Column:
    return F.struct(F.lit(status).alias("check_status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(confidence).cast("string").alias("confidence"))


def overlays() -> Column:
    """Rules of six sites whose pages need their own; null where none of them decides."""
    home, search, login = (F.col("redirect") == r for r in ("home", "search", "login"))
    has = lambda n: F.array_contains("identity", n)
    by_title, by_url = has("title_match") | has("og_title_match"), has("canonical_match") | has("og_url_match")
    marker = F.col("profile_marker") != ""
    titles = F.lower(F.concat_ws(" ", "title", "og_title"))
    photo = marker | titles.contains("tgme_page_photo")
    rules = {
        "PyPI": F.when(home, _row("NOT_FOUND", "pypi redirected to homepage")).when(has("canonical_match") & by_title, _row("LIKELY", "pypi profile canonical + title", "HIGH")),
        "Replit": F.when(home | search, _row("NOT_FOUND", F.concat(F.lit("replit redirect_"), "redirect")))
        .when(F.trim(titles).isin("", "replit", "replit – build software faster"), _row("INCONCLUSIVE", "replit generic shell", "LOW"))
        .when(by_url & by_title, _row("LIKELY", "replit canonical/og:url + title", "HIGH")),
        "Pinterest": F.when(login, _row("LOGIN_REQUIRED", "pinterest redirect_login")).when(home | search, _row("NOT_FOUND", F.concat(F.lit("pinterest redirect_"), "redirect"))).when(by_url & by_title, _row("LIKELY", "pinterest profile url + title", "HIGH")),
        "Steam": F.when(F.lower(path_of(F.col("final_url"))).rlike(r"/profiles/[0-9]+"), _row("LIKELY", "steam custom url resolved to /profiles/", "HIGH")).when(home, _row("NOT_FOUND", "steam redirected to homepage")).when(by_url & (by_title | marker), _row("LIKELY", "steam profile url + title/marker", "HIGH")),
        "Last.fm": F.when(home, _row("NOT_FOUND", "last.fm redirected to homepage")).when(by_url & by_title, _row("LIKELY", "last.fm /user canonical + title", "HIGH")),
        "Telegram": F.when(~photo, _row("INCONCLUSIVE", "telegram contact shell without profile photo", "LOW")).when(by_title, _row("LIKELY", "telegram tgme_page_photo + username title", "MEDIUM")).otherwise(_row("INCONCLUSIVE", "telegram photo without username title", "LOW")),
    }
    return F.coalesce(*(F.when(F.col("name") == n, r) for n, r in rules.items()))


def classify_pages(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """pages(site, url, final_url, status, html, handle), sites(``SITE``) -> check_status, reason, confidence. A page alone never confirms."""
    p = with_sites(page_signals(pages), searchable(sites))
    markers = {m: hit(F.col("haystack"), F.col(m)) for m in ("captcha_patterns", "challenge_patterns", "blocked_patterns", "login_patterns", "not_found_patterns", "soft_404_patterns")}
    p = p.withColumns({f"hit_{m}": c for m, c in markers.items()}).withColumn("profile_marker", hit(F.col("haystack"), F.col("profile_markers")))
    on = lambda m: F.col(f"hit_{m}_patterns") != ""
    status, code = F.col("status"), F.concat(F.lit("HTTP "), F.col("status").cast("string"))
    wall = F.col("check_method") == "login_wall"
    has = lambda n: F.array_contains("identity", n)
    by_title, by_url = has("title_match") | has("og_title_match"), has("canonical_match") | has("og_url_match")
    marker, found = F.col("profile_marker") != "", F.array_join("identity", ",")
    shown = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("og_title"))
    generic = (shown == "") | (~token_in(shown, F.col("h")) & generic_name(shown, F.col("h"), F.col("name")))
    tags = F.concat("identity", F.array_compact(F.array(
        F.when(marker, F.concat(F.lit("profile_marker:"), "profile_marker")), F.when(on("not_found"), "not_found_marker"), F.when(on("soft_404"), "soft_404_marker"), F.when(on("login"), "login_marker"), F.when(F.col("redirect") != "same", F.concat(F.lit("redirect_"), "redirect")),
    )))
    tags = F.when(F.size(tags) > 0, tags).otherwise(F.array(F.when(named_by_url(F.col("final_url"), F.col("h")), "final_url_only").otherwise("http_200_not_proof")))
    tags = F.when(generic & (shown != ""), F.array_append(tags, "generic_platform_title")).otherwise(tags)
    never = F.when(F.col("confidence_strategy") == "never_confirmed", " (never_confirmed)").otherwise("")
    told = lambda reason, confidence: _row("LIKELY", F.concat(reason if isinstance(reason, Column) else F.lit(reason), never), confidence)
    unnamed = F.size("identity") == 0
    verdict = (
        F.when(status == 429, _row("RATE_LIMITED", "HTTP 429"))
        .when(on("captcha"), _row("CAPTCHA_REQUIRED", "captcha presented — not solved"))
        .when(on("challenge"), _row("CHALLENGE_REQUIRED", "challenge presented — not bypassed"))
        .when((status.isin(401, 403) | on("blocked")) & (on("login") | wall | F.col("requires_auth")), _row("LOGIN_REQUIRED", F.concat(code, F.lit(" login/wall"))))
        .when(status.isin(401, 403) | on("blocked"), _row("BLOCKED", F.concat(code, F.lit(" blocked"))))
        .when((status == 408) | (status >= 500), _row("PROVIDER_UNAVAILABLE", code))
        .when(F.array_contains("not_found_status", status), _row("NOT_FOUND", code))
        .when(wall, F.when(on("not_found"), _row("NOT_FOUND", "not_found_pattern")).otherwise(_row("LOGIN_REQUIRED", "login wall / no public profile API")))
        .when(on("login"), _row("LOGIN_REQUIRED", "login_pattern"))
        .when(on("not_found"), _row("NOT_FOUND", "soft-404 / not_found_pattern"))
        .when(~F.array_contains("expected_status", status), _row("INCONCLUSIVE", F.concat(F.lit("Unexpected "), code, F.lit(" for HTML check")), "LOW"))
        .when(on("soft_404"), _row("NOT_FOUND", "soft_404_marker"))
        .when(F.col("redirect") == "login", _row("LOGIN_REQUIRED", "redirect_login"))
    )
    policy = (
        F.when((F.col("redirect") == "home") & (F.col("redirect_home") == "not_found") & unnamed, _row("NOT_FOUND", "redirect_home"))
        .when((F.col("redirect") == "search") & (F.col("redirect_search") == "not_found") & unnamed, _row("NOT_FOUND", "redirect_search"))
        .when(by_title & by_url & ~generic, told(F.concat(F.lit("title + canonical/og:url: "), found), "HIGH"))
        .when(by_title & ~generic, told("username in title/og:title", "MEDIUM"))
        .when(by_url & marker & ~generic, told("canonical/og:url + profile marker", "MEDIUM"))
        .when((F.size("identity") >= 2) & ~generic, told(F.concat(F.lit("two identity signals: "), found), "MEDIUM"))
        .otherwise(_row("INCONCLUSIVE", F.concat(F.lit("HTTP 200 is not proof ("), F.array_join(tags, ","), F.lit(")")), "LOW"))
    )
    return p.withColumn("v", F.coalesce(verdict, overlays(), policy)).select(*pages.columns, "redirect", F.array_join("identity", ",").alias("identity"), "v.check_status", "v.reason", "v.confidence")


def classify_json(landed: DataFrame) -> DataFrame:
    """landed(status, body, id_path, handle) -> CONFIRMED only where the named field is the handle.

    A body is parsed once, and what is found in it is looked up once, each behind a generator.
    """
    own = landed.columns
    one = lambda df, name, c: df.select("*", F.explode(F.array(c)).alias(name))
    j = one(landed, "_tree", F.try_parse_json("body"))
    j = one(j, "_at", F.when(F.col("id_path").rlike(r"^\$[A-Za-z0-9_.\[\]]*$"), F.try_variant_get("_tree", F.col("id_path"), "variant")))
    # texts and whole numbers name someone; true and false, lists and objects don't
    j = one(j, "_value", F.trim(F.when(F.schema_of_variant("_at").isin("STRING", "BIGINT"), F.try_variant_get("_at", F.lit("$"), "string"))))
    value = F.col("_value")
    same = F.lower(value) == F.lower(F.regexp_replace("handle", "^@", ""))
    status = F.col("status")
    check = (
        F.when(status == 429, "RATE_LIMITED")
        .when(status.isin(401, 403), "BLOCKED")
        .when((status == 408) | (status >= 500), "PROVIDER_UNAVAILABLE")
        .when(status.isin(404, 410), "NOT_FOUND")
        .when(F.col("_tree").isNull(), "INCONCLUSIVE")
        .when(F.coalesce(value, F.lit("")) == "", "NOT_FOUND")
        .when(same, "CONFIRMED")
        .otherwise("LIKELY")
    )
    return j.select(*own, value.alias("observed"), check.alias("check_status"))


def handles_by_site(handles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each handle at each enabled site: profile URLs from templates. The catalog is a table of some dozen sites, so it is sent to every task."""
    if catalog.limit(10_001).count() > 10_000:
        raise ValueError("a catalog of more than 10,000 sites has to be joined by category")
    sites = F.broadcast(catalog.where("enabled"))
    return handles.join(sites).withColumn("profile_url", F.replace(F.col("url_template"), F.lit("{username}"), F.lower(F.regexp_replace("handle", "^@", ""))))
