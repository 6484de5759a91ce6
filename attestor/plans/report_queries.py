"""Queries over flat views, mentions, coverage, the site catalog, and chains of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import ids, times, urls
from attestor.operators import catalog, reports

from . import views
from .page_queries import HOST, _in
from .views import table

V = f"WITH RECURSIVE {views.FINDINGS}"


def _findings(s, d):
    """Findings with data as JSON text; fields are missing now and then."""
    f = views.findings(s, d)
    k = F.col("ord")
    n = lambda m: (k % m).cast("string")
    has = lambda m, c: F.when(k % m != 0, c)
    data = F.to_json(F.struct(
        has(3, F.concat(F.lit("Site"), n(9))).alias("platform"), has(5, F.concat(F.lit("@User"), n(40))).alias("username"), F.col("check_status"), has(4, F.lit("pattern")).alias("reason"),
        has(6, F.concat(F.lit("https://s.example/u"), n(40))).alias("profile_url"), F.when(k % 2 == 0, 200).alias("http_status"), F.when(k % 7 == 0, F.lit("")).otherwise("CACHED").alias("cache_state"),
        has(2, F.concat(F.lit("Zoë  Name-"), n(4))).alias("display_name"), has(3, F.element_at(F.array(*map(F.lit, ("Berlin", "BERLIN", "Paris"))), (k % 3 + 1).cast("int"))).alias("location"),
        has(5, F.lit(" Some  Bio ")).alias("bio"), F.when(k % 11 == 0, "name").alias("kind"), F.when(k % 13 == 0, "x").alias("not_profile"), has(2, F.lit("https://w.example/")).alias("website"),
    ))
    return f.select("case_id", "ord", F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("target"), "module", "title", "status", "confidence", F.concat(F.lit("s"), n(8)).alias("summary"), "ts", data.alias("data"))


SITE = "module = 'username' AND title NOT IN ('Username sweep', 'Identity correlation')"
FLAT = f"""v_flat AS (SELECT case_id, ord, CASE WHEN ord % 3 <> 0 THEN 'Site' || ord % 9 ELSE title END AS platform, CASE WHEN ord % 5 <> 0 THEN '@User' || ord % 40 ELSE 't' || user_id END AS username, check_status AS status, status AS finding_status, coalesce(confidence, '') AS confidence,
  CASE WHEN ord % 6 <> 0 THEN 'https://s.example/u' || ord % 40 ELSE '' END AS profile_url, CASE WHEN ord % 4 <> 0 THEN 'pattern' ELSE 's' || ord % 8 END AS detail, CASE WHEN ord % 2 = 0 THEN 200 END AS http_status, CASE WHEN status = 'FOUND' THEN 'yes' ELSE '' END AS evidence, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS checked_at, 's' || ord % 8 AS summary,
  'ANONYMOUS_PUBLIC' AS access_mode, CASE WHEN ord % 7 = 0 THEN 'LIVE' ELSE 'CACHED' END AS cache_state, '' AS anonymous_status, '' AS authenticated_status, '' AS session_status, NULL::DOUBLE AS cache_age_seconds FROM v_findings WHERE {SITE})"""


def _mentions(s, d):
    """Orders as mentions: some URLs repeat within a query, some are missing."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    relevance = F.element_at(F.array(*map(F.lit, ("AMBIGUOUS", "DIRECT", "ASSOCIATED"))), (k % 3 + 1).cast("int"))
    provider = F.element_at(F.array(*map(F.lit, ("duckduckgo-html", "reddit-search", "other"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    url = F.when(k % 10 != 0, F.concat(F.lit("http://m.example/"), (k % 7).cast("string")))
    return o.select((F.col("o_custkey") % 50).alias("query"), F.lit("name").alias("kind"), url.alias("url"), F.col("o_orderpriority").alias("title"), relevance.alias("relevance"), provider.alias("provider"), k.alias("ord"))


CARDS = """v_m AS (SELECT o_custkey % 50 AS query, CASE WHEN o_orderkey % 10 <> 0 THEN 'http://m.example/' || o_orderkey % 7 END AS url, o_orderpriority AS title, ['AMBIGUOUS', 'DIRECT', 'ASSOCIATED'][o_orderkey % 3 + 1] AS relevance, ['DuckDuckGo', 'Reddit', 'other'][o_custkey % 3 + 1] AS provider, o_orderkey AS ord FROM orders),
v_c AS (SELECT query, coalesce(url, '#' || ord) AS key, min(ord) AS seen, arg_min_null(url, ord) AS url, min_by(title, ord) AS title, min_by(relevance, ord) AS relevance FROM v_m GROUP BY ALL),
v_s AS (SELECT query, key, string_agg(provider, ', ' ORDER BY seen) AS observed_by, count(*) AS sources FROM (SELECT query, coalesce(url, '#' || ord) AS key, provider, min(ord) AS seen FROM v_m GROUP BY ALL) GROUP BY ALL)"""


def _hits(s, d):
    """Events as hits of providers; some URLs are invalid, some hits match nothing."""
    k = F.col("event_id")
    url = F.when(k % 9 == 0, F.lit("ftp://x/")).when(k % 11 == 0, F.lit("http:///no")).otherwise(F.concat(F.lit("HTTP://M.Example/p"), (k % 60).cast("string"), F.when(k % 2 == 0, "/").otherwise("?q=1#f")))
    url = F.regexp_replace(url, "^HTTP", "http")
    return table(s, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("provider"), F.col("event_type").alias("kind"), url.alias("url"), F.concat(F.lit(" Q"), (k % 4).cast("string")).alias("query"), F.when(k % 5 != 0, F.lit("Name")).alias("matched"), k.alias("ord"))


def _sites(s, d):
    """Parts as rows of a site catalog, some of them unfit."""
    p = F.col("p_partkey")
    url = F.when(p % 17 == 0, F.lit("nowhere")).when(p % 19 == 0, F.lit("https://s.example/")).otherwise(F.concat(F.lit("https://s"), p.cast("string"), F.lit(".example/{username}")))
    return table(s, d, "part").select(
        F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("name"), F.col("p_brand").alias("category"), F.lower(F.substring_index("p_type", " ", 1)).alias("strategy"), (p % 6 == 0).alias("sensitive"), (p % 4 != 0).alias("enabled"), url.alias("profile_url"),
        F.when(p % 23 == 0, F.array().cast("array<int>")).when(p % 29 == 0, F.array(F.lit(200), F.lit(429))).when(p % 31 == 0, F.array(F.lit(99))).otherwise(F.array(F.lit(200))).alias("expected_status"),
        F.when(p % 37 == 0, F.array(F.lit(503))).otherwise(F.array(F.lit(404), F.lit(410))).alias("not_found_status"), F.when(p % 13 == 0, F.lit(" Not_Found ")).when(p % 41 == 0, F.lit("home")).alias("redirect_home"), F.when(p % 43 == 0, F.lit(" ")).alias("json_id_field"), p.alias("ord"),
    )


SITES = """v_s AS (SELECT *, p_partkey AS p, trim(regexp_replace(lower(p_brand || ' ' || p_size), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part),
v_r AS (SELECT *, CASE WHEN p % 17 = 0 THEN 'no URL' WHEN p % 19 = 0 THEN 'no place for the handle' WHEN p % 23 = 0 THEN 'expected_status is empty' WHEN p % 29 = 0 THEN 'expected_status has a reserved code' WHEN p % 31 = 0 THEN 'expected_status has no status code' WHEN p % 37 = 0 THEN 'not_found_status has a reserved code' WHEN p % 13 <> 0 AND p % 41 = 0 THEN 'unknown redirect policy' WHEN p % 43 = 0 THEN 'empty id field' END AS r FROM v_s),
v_judged AS (SELECT *, CASE WHEN r IS NULL AND p <> min(p) FILTER (r IS NULL) OVER (PARTITION BY slug) THEN 'slug is taken' ELSE r END AS reject FROM v_r)"""


def site_catalog(s, d):
    return catalog.judged(_sites(s, d)).select("ord", "slug", "reject")


def site_filter(s, d):
    fit = catalog.judged(_sites(s, d)).where("reject IS NULL")
    return catalog.chosen(fit, without=["brand#11 "], sensitive=False, strategies=["Standard", "PROMO"]).select("slug", "category", "strategy")


def provider_routing(s, d):
    kinds = F.element_at(F.array(*map(F.lit, ("IP", "DOMAIN", "EMAIL", "USERNAME", "HASH", "PHONE", "URL"))), (F.col("c_custkey") % 7 + 1).cast("int"))
    return catalog.routed(table(s, d, "customer").select("c_custkey", kinds.alias("type")))


def _runs(s, d):
    """Orders as runs; each is followed by the next, but every 150th begins anew and some parents are missing."""
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("run_id"), F.when(k % 150 != 0, F.when(k % 997 == 0, -k).otherwise(k - 1)).alias("parent_run_id"))


def known_ends(s, d):
    from attestor.operators import graph

    g = graph.build(views.edges(s, d))
    ids = table(s, d, "pages").select(urls.host_of(F.col("url")).alias("h")).where("h <> ''").select(F.concat(F.lit("host:"), "h").alias("id")).unionByName(table(s, d, "pages").where("url LIKE 'https:%'").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id")))
    return reports.with_known_ends(g, ids).select("src", "dst", "relation")


def case_order(s, d):
    """Cases by their last change, and the place of each."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.max("o_orderdate").alias("updated_at"), F.count("*").alias("runs"))
    return o.orderBy(F.desc("updated_at"), "case_id").limit(100)


def website_forms(s, d):
    raw = F.array(F.col("url"), F.regexp_replace("url", "^https?:", ""), F.regexp_replace("url", "^https?://", " "), F.lit("https://github.com/x"), F.lit(" "), F.lit("//t.me/x"))
    t = table(s, d, "pages").select("page_id", F.posexplode(raw).alias("form", "raw"))
    wrapped = F.concat(F.lit("//duck.example/l/?a=1&uddg="), F.url_encode("raw"), F.lit("&rut=x"))
    return t.select("page_id", F.col("form").cast("long").alias("form"), urls.public_website(F.col("raw")).alias("website"), urls.unwrapped(wrapped).alias("unwrapped"), urls.unwrapped(F.col("raw")).alias("as_it_is"), reports.mention_key(F.concat("raw", F.lit("#part"))).alias("mention_key"))


def retry_waits(s, d):
    k = F.col("event_id")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), (k % 100).cast("string"))).when(k % 4 == 1, F.concat(F.lit("Mon, 01 Jan 2024 00:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(" GMT"))).when(k % 4 == 2, F.lit("Tue, 02 Jan 2024 00:00:00 GMT")).otherwise(F.lit("soon"))
    return table(s, d, "events").select("event_id", raw.alias("raw"), times.retry_after(raw, now).alias("wait"))


RAWS = "SELECT page_id, unnest([url, regexp_replace(url, '^https?:', ''), regexp_replace(url, '^https?://', ' '), 'https://github.com/x', ' ', '//t.me/x']) AS raw, unnest(range(0, 6)) AS form FROM pages"

_ALL = {
    "username_rows": (lambda s, d: reports.flat_rows(_findings(s, d)), f"{V}, {FLAT} SELECT * FROM v_flat"),
    "eligible_records": (
        lambda s, d: reports.eligible_records(_findings(s, d)),
        f"""{V} SELECT case_id, ord, CASE WHEN ord % 3 <> 0 THEN 'Site' || ord % 9 ELSE title END AS platform, CASE WHEN ord % 5 <> 0 THEN 'user' || ord % 40 ELSE '' END AS username, CASE WHEN ord % 6 <> 0 THEN 'https://s.example/u' || ord % 40 ELSE '' END AS profile_url,
  CASE WHEN ord % 2 <> 0 THEN 'zoe name ' || ord % 4 ELSE '' END AS display_name, '' AS organization, CASE WHEN ord % 3 <> 0 THEN lower(['Berlin', 'BERLIN', 'Paris'][ord % 3 + 1]) ELSE '' END AS location, CASE WHEN ord % 5 <> 0 THEN 'some bio' ELSE '' END AS bio, '' AS email
  FROM v_findings WHERE {SITE} AND check_status IN ('CONFIRMED', 'LIKELY') AND ord % 13 <> 0 AND ord % 11 <> 0""",
    ),
    "mention_groups": (
        lambda s, d: reports.mention_cards(_mentions(s, d)),
        f"WITH {CARDS} SELECT query, 'name' AS kind, url, title, relevance, observed_by, sources, row_number() OVER (PARTITION BY query ORDER BY CASE relevance WHEN 'DIRECT' THEN 0 WHEN 'ASSOCIATED' THEN 1 ELSE 2 END, title, v_c.seen) AS place FROM v_c JOIN v_s USING (query, key)",
    ),
    "mention_coverage": (
        lambda s, d: reports.coverage(_hits(s, d)),
        """WITH h AS (SELECT 'p' || user_id % 6 AS provider, event_type AS kind, event_id AS k, event_id % 9 <> 0 AND event_id % 11 <> 0 AS valid, event_id % 9 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0 AS hit FROM events),
f AS (SELECT *, hit AND k = min(k) FILTER (hit) OVER (PARTITION BY k % 60, k % 2, k % 4) AS fresh FROM h)
SELECT provider, kind, count(*) AS raw, count(*) FILTER (valid) AS parsed, count(*) FILTER (hit) AS matched, least(5, count(*) FILTER (fresh)) AS deduped, count(*) FILTER (valid AND NOT hit) AS rejected_no_exact_match, count(*) FILTER (NOT valid) AS rejected_invalid_url, count(*) FILTER (hit AND NOT fresh) AS rejected_duplicate FROM f GROUP BY ALL""",
    ),
    "unique_values": (
        lambda s, d: reports.unique_in_order(views.findings(s, d).select("case_id", "ord", F.when(F.col("ord") % 2 == 0, F.upper("title")).otherwise(F.concat(F.lit(" "), "title")).alias("v")), ["case_id"], "v", "ord"),
        f"{V}, t AS (SELECT case_id, ord, CASE WHEN ord % 2 = 0 THEN upper(title) ELSE title END AS v FROM v_findings), f AS (SELECT case_id, lower(v) AS low, min(ord) AS seen, min_by(v, ord) AS v FROM t GROUP BY ALL) SELECT case_id, string_agg(v, ',' ORDER BY seen) AS values FROM f GROUP BY case_id",
    ),
    "case_summary": (
        lambda s, d: reports.summary(_findings(s, d), _mentions(s, d).withColumnRenamed("query", "case_id")),
        f"""{V}, {FLAT}, l AS (SELECT case_id, ord, status, status IN ('CONFIRMED', 'LIKELY') AS there, CASE WHEN ord % 3 <> 0 THEN ['Berlin', 'BERLIN', 'Paris'][ord % 3 + 1] END AS location FROM v_flat),
g AS (SELECT case_id, lower(location) AS low, count(*) AS n, min_by(location, ord) AS location, min(ord) AS seen FROM l WHERE there AND location IS NOT NULL GROUP BY ALL), p AS (SELECT case_id, max_by(location, (n, -seen)) AS location, max(n) AS n FROM g GROUP BY case_id),
c AS (SELECT case_id, count(*) AS profile_checks, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'LIKELY') AS likely, count(*) FILTER (there AND ord % 2 <> 0) AS with_domain FROM l GROUP BY case_id),
m AS (SELECT o_custkey % 50 AS case_id, count(*) AS mentions_total, count(*) FILTER (o_orderkey % 3 = 1) AS direct FROM orders GROUP BY 1),
j AS (SELECT c.*, CASE WHEN n >= 2 THEN location END AS geographic_indicator, coalesce(mentions_total, 0) AS mentions_total, coalesce(direct, 0) AS direct FROM c LEFT JOIN p USING (case_id) LEFT JOIN m USING (case_id)),
s AS (SELECT *, list_filter([CASE WHEN confirmed + likely < 3 THEN 'exact full-name search' END, CASE WHEN mentions_total = 0 THEN 'search outside known platforms' END, CASE WHEN with_domain > 0 THEN 'inspect public profile links' END], lambda x: x IS NOT NULL) AS steps FROM j)
SELECT case_id, profile_checks, confirmed, likely, geographic_indicator, mentions_total, direct, confirmed + likely = 0 AND mentions_total = 0 AS insufficient_evidence, CASE WHEN len(steps) = 0 THEN 'insufficient evidence for a further public pivot' ELSE array_to_string(steps, '; ') END AS next_steps FROM s""",
    ),
    "site_catalog": (site_catalog, f"WITH {SITES} SELECT p AS ord, slug, reject FROM v_judged"),
    "site_filter": (site_filter, f"WITH {SITES} SELECT slug, p_brand AS category, lower(string_split(p_type, ' ')[1]) AS strategy FROM v_judged WHERE reject IS NULL AND p % 4 <> 0 AND p % 6 <> 0 AND lower(p_brand) <> 'brand#11' AND lower(string_split(p_type, ' ')[1]) IN ('standard', 'promo')"),
    "provider_routing": (
        provider_routing,
        "WITH k AS (SELECT c_custkey, ['IP', 'DOMAIN', 'EMAIL', 'USERNAME', 'HASH', 'PHONE', 'URL'][c_custkey % 7 + 1] AS type FROM customer), r AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, ts in catalog.SUPPORTED.items() for t in ts) + ") v(service, type)) SELECT c_custkey, type, service FROM k JOIN r USING (type)",
    ),
    "run_chains": (
        lambda s, d: reports.run_chains(_runs(s, d)),
        """WITH RECURSIVE r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 150 <> 0 THEN CASE WHEN o_orderkey % 997 = 0 THEN -o_orderkey ELSE o_orderkey - 1 END END AS p FROM orders),
c(run_id, root, steps) AS (SELECT run_id, run_id, 0::BIGINT FROM r UNION ALL SELECT c.run_id, r.p, c.steps + 1 FROM c JOIN r ON r.run_id = c.root JOIN orders o ON o.o_orderkey = r.p)
SELECT run_id, min_by(root, -steps) AS root, max(steps) AS steps, false AS circular FROM c GROUP BY run_id""",
    ),
    "known_ends": (
        known_ends,
        f"WITH RECURSIVE {views.EDGES}, g AS (SELECT src, dst, max_by(relation, ord) AS relation FROM v_edges GROUP BY ALL), n AS (SELECT 'host:' || {HOST} AS id FROM pages WHERE {HOST} <> '' UNION SELECT 'page:' || page_id FROM pages WHERE url LIKE 'https:%') SELECT * FROM g WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)",
    ),
    "case_order": (case_order, "SELECT o_custkey AS case_id, max(o_orderdate) AS updated_at, count(*) AS runs FROM orders GROUP BY 1 ORDER BY updated_at DESC, case_id LIMIT 100"),
    "website_forms": (
        website_forms,
        f"""WITH r AS ({RAWS}), t AS (SELECT *, trim(raw) AS x, CASE WHEN starts_with(trim(raw), '//') THEN 'https:' || trim(raw) ELSE trim(raw) END AS y FROM r), u AS (SELECT *, CASE WHEN regexp_matches(lower(y), '^https?://') THEN y ELSE 'https://' || y END AS url FROM t),
h AS (SELECT *, {HOST} AS h FROM u), k AS (SELECT *, regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS sch, regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS auth, regexp_replace(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+$', '') AS p, regexp_extract(x, '^[^?#]*\\?([^#]*)', 1) AS q FROM h)
SELECT page_id, form, CASE WHEN x <> '' AND h <> '' AND h NOT IN {_in(ids.PLATFORM_HOSTS)} THEN url END AS website, raw AS unwrapped, y AS as_it_is,
  CASE WHEN auth <> '' THEN lower(sch) || '://' || lower(auth) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE lower(regexp_replace(ltrim(raw) || '#part', '/+$', '')) END AS mention_key FROM k""",
    ),
    "retry_waits": (
        retry_waits,
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || event_id % 100 WHEN 1 THEN 'Mon, 01 Jan 2024 00:00:' || lpad((event_id % 60)::VARCHAR, 2, '0') || ' GMT' WHEN 2 THEN 'Tue, 02 Jan 2024 00:00:00 GMT' ELSE 'soon' END AS raw, CASE event_id % 4 WHEN 0 THEN least(60, event_id % 100) WHEN 1 THEN event_id % 60 WHEN 2 THEN 60 END::DOUBLE AS wait FROM events",
    ),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
