"""Queries over leads, indicators, runs and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import ids, text, urls
from attestor.operators import discovery, runs
from attestor.sources.steps import shares
from attestor.streaming import windows

from . import views
from .views import HOST_SQL, table

NOW = "2024-02-01 00:00:00"
V = f"WITH {views.FINDINGS}"


def _indicators(s, d):
    """Indicators from pages (hosts, URLs, anchors) and documents (addresses)."""
    p = table(s, d, "pages")
    a = p.select(F.lit("url").alias("kind"), F.col("url").alias("value"), F.when(F.col("page_id") % 3 == 0, "discovered_profile_url").otherwise("external_links").alias("rule"), F.lit("pages").alias("source"), (F.col("page_id") * 10).alias("ord"))
    b = p.where(urls.host_of(F.col("url")) != "").select(F.lit("domain").alias("kind"), urls.host_of(F.col("url")).alias("value"), F.lit("profile_host").alias("rule"), F.lit("pages").alias("source"), (F.col("page_id") * 10 + 1).alias("ord"))
    docs = table(s, d, "documents")
    mail = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({text.EMAIL_IN_TEXT})"), F.lit(1))).alias("p", "value"))
    c = mail.select(F.lit("email").alias("kind"), "value", F.lit("public_email").alias("rule"), F.lit("documents").alias("source"), (F.col("doc_id") * 100000 + F.col("p") + 100000000000).alias("ord"))
    e = table(s, d, "customer").select(F.lit("username").alias("kind"), F.concat(F.lit("@User"), (F.col("c_custkey") % 40).cast("string")).alias("value"), F.when(F.col("c_custkey") % 2 == 0, "bio_handle").otherwise("seen").alias("rule"), F.lit("customer").alias("source"), (F.col("c_custkey") + 200000000000).alias("ord"))
    return a.unionByName(b).unionByName(c).unionByName(e)


def _leads(s, d):
    """Some handles, and the hosts of four pages or more."""
    users = s.range(5).select(F.lit("username").alias("kind"), F.concat(F.lit("user"), F.col("id").cast("string")).alias("norm"))
    hosts = table(s, d, "pages").groupBy(urls.bare_host(F.col("url")).alias("norm")).agg(F.count("*").alias("n")).where("n >= 4")
    return users.unionByName(hosts.select(F.lit("domain").alias("kind"), "norm"))


def _known(s, d):
    """Pages in French are known."""
    return table(s, d, "pages").where("url LIKE '%/fr/%'").select("url")


def _annotated(s, d):
    return discovery.annotate(_indicators(s, d), _leads(s, d), _known(s, d))


HOST, BARE = HOST_SQL.format("url"), f"regexp_replace({HOST_SQL.format('url')}, '^www\\.', '')"
VHOST = f"CASE WHEN regexp_replace({HOST_SQL.format('value')}, '^www\\.', '') <> '' THEN regexp_replace({HOST_SQL.format('value')}, '^www\\.', '') ELSE regexp_replace(lower(split_part(value, '/', 1)), '^www\\.', '') END"
PLATFORMS = "[" + ", ".join(f"'{h}'" for h in ids.PLATFORM_HOSTS) + "]"
HUBS = "(" + ", ".join(f"'{h}'" for h in discovery.LINK_HUBS) + ")"
ON_PLATFORM = f"list_has_any(list_transform(range(1, greatest(2, len(string_split(host, '.')))), lambda k: array_to_string(string_split(host, '.')[k:], '.')), {PLATFORMS})"
ANNOTATED = f"""i AS (SELECT 'url' AS kind, url AS value, CASE WHEN page_id % 3 = 0 THEN 'discovered_profile_url' ELSE 'external_links' END AS rule, 'pages' AS source, page_id * 10 AS ord FROM pages
  UNION ALL SELECT 'domain', {HOST}, 'profile_host', 'pages', page_id * 10 + 1 FROM pages WHERE {HOST} <> ''
  UNION ALL SELECT 'email', unnest(regexp_extract_all(text, '{text.EMAIL_IN_TEXT}')), 'public_email', 'documents', doc_id * 100000 + unnest(range(0, len(regexp_extract_all(text, '{text.EMAIL_IN_TEXT}')))) + 100000000000 FROM documents
  UNION ALL SELECT 'username', '@User' || c_custkey % 40, CASE WHEN c_custkey % 2 = 0 THEN 'bio_handle' ELSE 'seen' END, 'customer', c_custkey + 200000000000 FROM customer),
h AS (SELECT *, {VHOST} AS vhost FROM i), n AS (SELECT *, CASE WHEN kind IN ('url', 'domain') THEN vhost WHEN kind = 'username' THEN lower(regexp_replace(trim(value), '^@+', '')) ELSE lower(trim(value)) END AS norm, CASE WHEN kind IN ('url', 'domain') THEN vhost ELSE '' END AS host FROM h),
leads AS (SELECT 'username' AS kind, 'user' || range AS norm FROM range(5) UNION ALL SELECT 'domain', {BARE} FROM pages GROUP BY 2 HAVING count(*) >= 4), known AS (SELECT DISTINCT lower(regexp_replace(url, '/+$', '')) AS u FROM pages WHERE url LIKE '%/fr/%'),
c AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM leads l WHERE l.kind = CASE WHEN n.kind = 'url' THEN 'domain' ELSE n.kind END AND l.norm = n.norm) THEN 'OPERATOR_INPUT'
  WHEN kind = 'url' AND lower(regexp_replace(value, '/+$', '')) IN (SELECT u FROM known) THEN 'KNOWN' WHEN kind IN ('url', 'domain') AND {ON_PLATFORM} AND host NOT IN {HUBS} THEN 'REDUNDANT'
  WHEN rule IN ({', '.join(f"'{r}'" for r in discovery.DERIVED_RULES)}) THEN 'DERIVED' WHEN starts_with(rule, 'discovered_') THEN CASE WHEN kind = 'username' THEN 'DERIVED' ELSE 'NOVEL' END ELSE 'NOVEL' END AS novelty FROM n WHERE norm <> ''),
g AS (SELECT kind, norm, max_by(novelty, CASE novelty WHEN 'NOVEL' THEN 5 WHEN 'DERIVED' THEN 4 WHEN 'OBSERVED' THEN 3 WHEN 'KNOWN' THEN 2 WHEN 'OPERATOR_INPUT' THEN 1 ELSE 0 END) AS novelty, min_by(value, ord) AS value, min_by(rule, ord) AS rule, min_by(host, ord) AS host, min(ord) AS ord, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n FROM c GROUP BY kind, norm),
annotated AS (SELECT kind, norm, ord, value, rule, novelty, CASE WHEN novelty IN ('REDUNDANT', 'OPERATOR_INPUT', 'KNOWN') THEN 0 WHEN kind IN ('email', 'username') THEN 100 WHEN kind IN ('domain', 'url') AND host <> '' AND (host IN {HUBS} OR NOT {ON_PLATFORM}) THEN 100 WHEN kind = 'url' THEN 50 ELSE 10 END::BIGINT AS priority, sources, n FROM g)"""


def _cased(s, d):
    """Indicators of three cases, a key now and then twice."""
    a = _annotated(s, d).select("kind", "norm", "novelty", "priority", "ord")
    two = a.withColumn("again", F.explode(F.when(F.col("ord") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return two.select((F.col("ord") % 3).alias("case_id"), "kind", "norm", "novelty", "priority", (F.col("ord") * 2 + F.col("again")).alias("ord"))


CASED = "cased AS (SELECT ord % 3 AS case_id, kind, norm, novelty, priority, ord * 2 + again AS ord FROM annotated, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR ord % 5 = 0)"
PIVOTS = f"""{CASED}, u AS (SELECT *, novelty IN ('NOVEL', 'DERIVED') AND priority > 0 AS useful FROM cased WHERE kind IN ('username', 'domain', 'email', 'url')),
f AS (SELECT *, (useful AND row_number() OVER (PARTITION BY case_id, kind, norm, useful ORDER BY priority DESC, kind, ord) = 1)::INT AS fresh FROM u),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY priority DESC, kind, ord ROWS UNBOUNDED PRECEDING) AS k FROM f),
m AS (SELECT *, max(CASE WHEN fresh = 1 AND k <= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, kind, norm) AS kept FROM k),
pivots AS (SELECT case_id, kind, norm, ord, CASE kind WHEN 'username' THEN 'search username' WHEN 'domain' THEN 'inspect domain' WHEN 'email' THEN 'search exact email' ELSE 'inspect public URL' END AS action,
  CASE WHEN NOT useful THEN CASE WHEN novelty = 'REDUNDANT' THEN 'redundant' ELSE 'not_novel' END WHEN fresh = 1 AND k > 25 THEN 'budget' WHEN fresh = 0 THEN CASE WHEN kept = 1 THEN 'duplicate' ELSE 'budget' END END AS reason FROM m)"""


def _pivots(s, d):
    return discovery.propose_pivots(_cased(s, d), "case_id", 25).drop("priority")


HANDLE_FORMS = ["user_{}", "User-{}", "user{}", "user_{}_real", "user_{}99", "{}.user", "user_{}-nyc", "@user_{}", "xuser_{}", "7user_{}", "21_user_{}", "the-user_{}", "a.user_{}"]


def username_match_class(s, d):
    """Handles of customers against variants of suppliers' handles."""
    n = F.col("s_suppkey").cast("string")
    forms = F.array(*(F.concat(F.lit(f.split("{}")[0]), n, F.lit(f.split("{}")[1])) for f in HANDLE_FORMS))
    obs = table(s, d, "supplier").select(F.explode(forms).alias("observed"))
    req = table(s, d, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("requested"))
    return discovery.similar_handles(req, obs)


LEADS = [("name", "name 1"), ("name", "the of"), ("name", "The  the"), ("name", "user1"), ("name", "and the"), ("name", "éle un"), ("username", "worthless"), ("username", "@the"), ("username", "ab"), ("username", "825"), ("domain", "mail5.example.com"), ("domain", "www.example.net"), ("domain", "example"), ("username", "$$$"), ("username", "&&&"), ("username", "été"), ("username", "öße")]


def _mention_leads(s, d):
    """Some handles, names and hosts, and all addresses in documents."""
    mails = table(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({text.EMAIL_RUN})"), F.lit(1))).alias("lead")).distinct()
    return s.createDataFrame(LEADS, "kind string, lead string").unionByName(mails.select(F.lit("email").alias("kind"), "lead"))


def _hits(s, d):
    """Documents, conversations and landed pages as what a search turns up."""
    docs = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("title"), F.col("text").alias("snippet"), F.lit("").alias("url"), F.col("source").alias("author"))
    turns = table(s, d, "conversations").select(F.concat(F.lit("c"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).alias("id"), F.lit("").alias("title"), F.col("text").alias("snippet"), F.lit("").alias("url"), F.col("role").alias("author"))
    pages = table(s, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), text.title_of(F.col("html")).alias("title"), F.lit("").alias("snippet"), "url", F.lit("").alias("author"))
    return docs.unionByName(turns).unionByName(pages)


def _found(s, d):
    return discovery.mention_matches(_hits(s, d), _mention_leads(s, d))


HIT_HOST = f"regexp_replace({HOST_SQL.format('url')}, '^www\\.', '')"
HIT_PATH, HIT_QUERY = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)", "regexp_extract(lower(url), '^[^?#]*\\?([^#]*)', 1)"
_FOLDED = "lower(trim(regexp_replace(strip_accents({}), '\\s+', ' ', 'g')))"


def _first(test: str, fields=discovery.FIELDS) -> str:
    """SQL for the first field that a test holds for."""
    return "CASE " + " ".join(f"WHEN {test.format(c=c)} THEN '{c}'" for c in fields) + " END"


def _edged(edge: str) -> str:
    # a quick test first, since patterns made for each row are slow
    return f"contains({{c}}_low, form) AND regexp_matches({{c}}_low, '(^|[^{edge}])' || regexp_escape(form) || '($|[^{edge}])')"


_TEXTS = ("title", "snippet", "author")
MENTIONS = f"""v_raw AS (SELECT 'd' || doc_id AS id, '' AS title, coalesce(text, '') AS snippet, '' AS url, coalesce(source, '') AS author FROM documents UNION ALL SELECT 'c' || (conv_id * 1000 + turn), '', coalesce(text, ''), '', role FROM conversations
  UNION ALL SELECT 'p' || page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '', url, '' FROM pages),
v_hits AS MATERIALIZED (SELECT *, {", ".join(f"lower({c}) AS {c}_low, {_FOLDED.format(c)} AS {c}_plain" for c in discovery.FIELDS)}, {HIT_HOST} AS host, list_transform(string_split({HIT_PATH}, '/'), lambda x: regexp_replace(x, '^@+', '')) AS parts, string_split({HIT_QUERY}, '&') AS asked FROM v_raw),
v_all AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{x}')" for k, x in LEADS)}) v(kind, lead) UNION SELECT 'email', unnest(regexp_extract_all(lower(text), '{text.EMAIL_IN_TEXT}')) FROM documents),
v_forms AS (SELECT kind, lead, CASE kind WHEN 'username' THEN lower(regexp_replace(lead, '^@+', '')) WHEN 'domain' THEN regexp_replace(lower(lead), '^www\\.', '') WHEN 'name' THEN {_FOLDED.format("lead")} ELSE lower(lead) END AS form FROM v_all),
v_leads AS MATERIALIZED (SELECT * FROM v_forms WHERE CASE kind WHEN 'username' THEN length(form) >= 3 WHEN 'name' THEN contains(form, ' ') WHEN 'domain' THEN contains(form, '.') ELSE true END),
v_found AS (
  SELECT id, kind, lead, CASE WHEN list_contains(parts, form) OR len(list_filter(asked, lambda q: q IN ('id=' || form, 'user=' || form, 'username=' || form, 'u=' || form))) > 0 THEN 'url' ELSE {_first(_edged("A-Za-z0-9_"), _TEXTS)} END AS field FROM v_hits, v_leads WHERE kind = 'username'
  UNION ALL SELECT id, kind, lead, CASE WHEN host = form OR ends_with(host, '.' || form) THEN 'url' ELSE {_first(_edged("A-Za-z0-9-"), _TEXTS)} END FROM v_hits, v_leads WHERE kind = 'domain'
  UNION ALL SELECT id, kind, lead, {_first("contains({c}_plain, form)")} FROM v_hits, v_leads WHERE kind = 'name'
  UNION ALL SELECT id, kind, lead, {_first("contains({c}_low, form)")} FROM v_hits, v_leads WHERE kind = 'email'),
v_typed AS (SELECT *, CASE kind WHEN 'username' THEN CASE WHEN field = 'url' THEN 'url_path_segment' ELSE 'exact_token' END WHEN 'name' THEN 'full_name' WHEN 'email' THEN 'exact_email' ELSE 'exact_host' END AS match_type FROM v_found WHERE field IS NOT NULL),
v_beside AS (SELECT id, coalesce(list_sort(list(DISTINCT lead) FILTER (kind = 'username')), []) AS u, coalesce(list_sort(list(DISTINCT lead) FILTER (kind = 'email')), []) AS e, coalesce(list_sort(list(DISTINCT lead) FILTER (kind = 'domain')), []) AS h FROM v_typed GROUP BY id),
v_related AS (SELECT t.*, CASE WHEN kind <> 'name' THEN 'DIRECT' WHEN len(u) + len(e) + len(h) > 0 THEN 'ASSOCIATED' ELSE 'AMBIGUOUS' END AS relevance,
  CASE WHEN kind <> 'name' THEN CASE match_type WHEN 'exact_token' THEN 'exact_username' WHEN 'url_path_segment' THEN 'username_path' WHEN 'exact_email' THEN 'exact_email' ELSE 'exact_domain' END WHEN len(u) > 0 THEN 'name_plus_username' WHEN len(e) > 0 THEN 'name_plus_email' WHEN len(h) > 0 THEN 'name_plus_domain' ELSE 'full_name_only' END AS reason,
  CASE WHEN kind = 'name' THEN array_to_string(u || e || h, ',') ELSE '' END AS associated FROM v_typed t JOIN v_beside USING (id))"""


def _lead_rows(s, d):
    """Leads of a case by customer: handles, addresses, names and domains, some of them repeated."""
    kind = F.element_at(F.array(*map(F.lit, ("username", "email", "name", "domain"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    k = (F.col("c_custkey") % 9).cast("string")
    lead = F.when(kind == "username", F.concat(F.lit("u"), k)).when(kind == "email", F.concat(F.lit("e"), k, F.lit("@x.example"))).when(kind == "name", F.concat(F.lit("Name "), k)).otherwise(F.concat(F.lit("d"), k, F.lit(".example")))
    rows = table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("case"), kind.alias("kind"), lead.alias("lead"), F.col("c_custkey").alias("ord"))
    return rows.groupBy("case", "kind", "lead").agg(F.min("ord").alias("ord"))


QUERY_PLAN = """v_base AS (SELECT c_nationkey::BIGINT AS "case", c_custkey AS ord, ['username', 'email', 'name', 'domain'][c_custkey % 4 + 1] AS kind, c_custkey % 9 AS k FROM customer),
v_lead AS (SELECT "case", kind, CASE kind WHEN 'username' THEN 'u' || k WHEN 'email' THEN 'e' || k || '@x.example' WHEN 'name' THEN 'Name ' || k ELSE 'd' || k || '.example' END AS lead, min(ord) AS ord FROM v_base GROUP BY ALL),
l AS (SELECT "case", kind, lead, row_number() OVER (PARTITION BY "case", kind ORDER BY ord) AS i, '"' || lead || '"' AS q FROM v_lead),
r AS (SELECT "case", lead, i, 0 AS j, CASE WHEN i = 1 THEN 0 ELSE 3 END AS tier, 'username' AS family, q AS text FROM l WHERE kind = 'username' UNION ALL SELECT "case", lead, i, CASE kind WHEN 'domain' THEN 1 ELSE 0 END, 1, kind, q FROM l WHERE kind IN ('email', 'domain')
  UNION ALL SELECT "case", lead, i, 0, 2, 'name', q FROM l WHERE kind = 'name' UNION ALL SELECT "case", lead, i, 0, 4, 'username', '@' || lead FROM l WHERE kind = 'username' UNION ALL SELECT "case", lead, i, 0, 5, 'username', 'inurl:' || lead FROM l WHERE kind = 'username'
  UNION ALL SELECT "case", lead, i, 0, 6, 'username', q || ' profile' FROM l WHERE kind = 'username'
  UNION ALL SELECT a."case", a.lead, a.i, b.i, CASE WHEN b.kind = 'name' THEN 7 WHEN a.kind = 'username' THEN 8 ELSE 9 END, CASE WHEN b.kind = 'name' THEN 'pair' ELSE 'domain' END, CASE WHEN b.kind = 'name' THEN b.q || ' ' || a.q ELSE a.q || ' ' || b.q END FROM l a JOIN l b ON a."case" = b."case" AND (a.kind, b.kind) IN (('username', 'name'), ('username', 'domain'), ('name', 'domain'))),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case", lower(text) ORDER BY tier, i, j) AS x FROM r) WHERE x = 1), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case", family, lead ORDER BY tier, i, j) AS y FROM o) WHERE y <= 4),
p AS (SELECT "case", family, lead, tier, text, row_number() OVER (PARTITION BY "case" ORDER BY tier, i, j) AS place FROM c)"""


def _orders(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("rolled_back").alias("status"), F.col("o_orderdate").alias("finished_at"))


def observation_status(s, d):
    last = runs.latest_run(_orders(s, d)).select("case_id", F.col("finished_at").alias("started_at"))
    seen = table(s, d, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("entity")).agg(F.max("o_orderdate").alias("last_seen"))
    return runs.observation_status(seen, last)


def rollback_view(s, d):
    facts = shares(table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_partkey"), "run_id")
    kept = runs.without_runs(facts, _orders(s, d).where("status = 'rolled_back'"))
    return kept.groupBy("run_id").agg(F.count("*").alias("facts"), F.countDistinct("l_partkey").alias("entities"))


def referenced_entities(s, d):
    facts = table(s, d, "lineitem").join(_orders(s, d).where("status = 'completed'").select(F.col("run_id").alias("l_orderkey")), "l_orderkey").select(F.col("l_partkey").alias("p_partkey"))
    return runs.referenced(table(s, d, "part").select("p_partkey", "p_name", "p_brand"), facts, "p_partkey")


def timeline(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("case_id"), F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("ts"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("label"), F.lit("events").alias("source"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("label"), F.lit("orders").alias("source"))
    return runs.timeline([e, o], NOW).withColumn("place", F.col("place").cast("long"))


def circuit_breaker(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").alias("ok"))
    return runs.failure_streaks(e, "user_id")


def spacing(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("ord"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return runs.spaced(e, "user_id", 600_000_000).withColumn("n", F.col("n").cast("long"))


def ttl_cache_latest(s, d):
    e = table(s, d, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 500).cast("string")).alias("key"), F.col("event_type").alias("kind"), (F.col("event_id") % 7 > 0).cast("int").alias("version"), "ts", F.col("event_id").alias("ord"), "value")
    ttl = s.createDataFrame([("view", 86400), ("click", 259200), ("signup", 604800), ("purchase", 1209600), ("error", 900)], "kind string, seconds long")
    return runs.cached(e, ttl, "2024-01-20 00:00:00", 1)


def catalog_rollup(s, d):
    p = table(s, d, "part")
    return p.groupingSets([[F.col("p_brand")], [F.col("p_type")], []], F.col("p_brand"), F.col("p_type")).agg(F.count("*").alias("sites"), F.sum(F.col("p_size").cast("long")).alias("size"))


_AFFIXED = " OR ".join(f"o = q || '_{a}' OR o = '{a}_' || q OR o = q || '-{a}' OR o = '{a}-' || q OR o = q || '.{a}'" for a in ids.AFFIXES)
MATCH_SQL = f"""WITH f AS (SELECT unnest([{", ".join("'" + f.replace("{}", "' || s_suppkey || '") + "'" for f in HANDLE_FORMS)}]) AS observed FROM supplier),
c AS (SELECT DISTINCT 'user_' || c_custkey AS requested, observed FROM f, customer),
m AS (SELECT *, lower(regexp_replace(trim(requested), '^@+', '')) AS q, lower(regexp_replace(trim(observed), '^@+', '')) AS o FROM c),
t AS (SELECT *, regexp_replace(q, '[-_.]+', '', 'g') AS jq, regexp_replace(o, '[-_.]+', '', 'g') AS jo, list_filter(string_split_regex(q, '[-_.]+'), lambda x: x <> '') AS tq, list_filter(string_split_regex(o, '[-_.]+'), lambda x: x <> '') AS tobs, length(o) - length(q) AS longer FROM m)
SELECT * FROM (SELECT requested, observed, CASE WHEN q = '' OR o = '' THEN 'UNRELATED' WHEN q = o THEN 'EXACT_MATCH'
  WHEN regexp_replace(q, '[-_.]+', '_', 'g') = regexp_replace(o, '[-_.]+', '_', 'g') OR (jq <> '' AND jq = jo)
    OR (starts_with(o, q) AND regexp_full_match(substr(o, length(q) + 1), '[_.-]?[0-9]+')) OR (ends_with(o, q) AND longer > 0 AND regexp_full_match(o[1:longer], '[0-9]+[_.-]?'))
    OR (jq <> '' AND starts_with(jo, jq) AND regexp_full_match(substr(jo, length(jq) + 1), '[0-9]+')) OR {_AFFIXED}
    OR (len(tq) >= 2 AND len(tobs) >= 2 AND len(list_filter(tq, lambda x: NOT list_contains(tobs, x))) = 0 AND (len(list_filter(tobs, lambda x: NOT list_contains(tq, x))) = 0 OR len(tobs) <= len(tq) + 2))
    OR (longer BETWEEN 1 AND 6 AND ((starts_with(o, q) AND substr(o, length(q) + 1, 1) IN ('_', '-', '.')) OR (ends_with(o, q) AND substr(o, longer, 1) IN ('_', '-', '.'))))
  THEN 'SIMILAR_CANDIDATE' ELSE 'UNRELATED' END AS match FROM t) WHERE match <> 'UNRELATED'"""

_ALL = {
    "novelty_annotate": (_annotated, f"WITH {ANNOTATED} SELECT * FROM annotated"),
    "pivot_propose": (_pivots, f"WITH {ANNOTATED}, {PIVOTS} SELECT case_id, kind, norm, ord, action, reason IS NULL AS accepted, reason FROM pivots"),
    "discovery_metrics": (
        lambda s, d: discovery.metrics(_cased(s, d), _pivots(s, d), "case_id"),
        f"""WITH {ANNOTATED}, {PIVOTS}, a AS (SELECT case_id, count(*) AS indicators_extracted, count(*) FILTER (novelty IN ('NOVEL', 'DERIVED')) AS novel_indicators, count(*) FILTER (novelty = 'REDUNDANT') AS redundant_indicators, count(*) FILTER (novelty IN ('NOVEL', 'DERIVED') AND priority > 0 AND kind = 'username') AS new_handles, count(*) FILTER (novelty IN ('NOVEL', 'DERIVED') AND priority > 0 AND kind = 'domain') AS new_domains FROM cased GROUP BY case_id)
SELECT * FROM a JOIN (SELECT case_id, count(*) AS pivots_proposed, count(*) FILTER (reason IS NULL) AS pivots_executed, count(*) FILTER (reason IS NOT NULL) AS pivots_suppressed FROM pivots GROUP BY case_id) USING (case_id)""",
    ),
    "username_match_class": (username_match_class, MATCH_SQL),
    "mention_match": (_found, f"WITH {MENTIONS} SELECT * FROM v_related"),
    "mention_relevance": (
        lambda s, d: _found(s, d).groupBy("relevance", "reason").agg(F.count("*").alias("mentions")),
        f"WITH {MENTIONS} SELECT relevance, reason, count(*) AS mentions FROM v_related GROUP BY ALL",
    ),
    "query_plan": (lambda s, d: discovery.query_plan(_lead_rows(s, d)).withColumns({"tier": F.col("tier").cast("long"), "place": F.col("place").cast("long")}), f"WITH {QUERY_PLAN} SELECT * FROM p WHERE place <= 12"),
    "latest_run": (lambda s, d: runs.latest_run(_orders(s, d)), "SELECT o_custkey AS case_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, max(o_orderdate) AS finished_at, count(*) AS completed FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"),
    "observation_status": (
        observation_status,
        "WITH l AS (SELECT o_custkey AS c, max(o_orderdate) AS started_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT o_custkey AS c, o_orderpriority AS entity, max(o_orderdate) AS last_seen FROM orders GROUP BY ALL) SELECT c AS case_id, entity, CASE WHEN last_seen < started_at THEN 'HISTORICAL' ELSE 'LATEST' END AS observation FROM s JOIN l USING (c)",
    ),
    "rollback_view": (rollback_view, "SELECT l_orderkey AS run_id, count(*) AS facts, count(DISTINCT l_partkey) AS entities FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) GROUP BY 1"),
    "referenced_entities": (referenced_entities, "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')"),
    "timeline": (
        timeline,
        f"WITH t AS (SELECT user_id AS case_id, CASE WHEN event_id % 13 <> 0 THEN ts END AS ts, event_type || '-' || event_id AS label, 'events' AS source FROM events UNION ALL SELECT o_custkey, o_orderdate, 'order-' || o_orderkey, 'orders' FROM orders) SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(ts, TIMESTAMP '{NOW}'), label, source) AS place FROM t",
    ),
    "circuit_breaker": (
        circuit_breaker,
        "WITH i AS (SELECT user_id, event_id AS ord, event_type = 'purchase' AS ok, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events), s AS (SELECT user_id, ord, ok, sum((NOT ok)::INT) OVER (PARTITION BY user_id, g ORDER BY ord)::BIGINT AS streak FROM i) SELECT *, streak >= 3 AS open FROM s",
    ),
    "spacing": (
        spacing,
        "WITH e AS (SELECT user_id, event_id AS ord, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (SELECT *, max(at_us - n * 600000000) OVER (PARTITION BY user_id ORDER BY at_us, ord ROWS UNBOUNDED PRECEDING) + n * 600000000 AS release FROM e) SELECT *, release - at_us AS wait FROM r",
    ),
    "ttl_cache_latest": (
        ttl_cache_latest,
        "WITH w AS (SELECT 'k' || event_id % 500 AS key, event_type AS kind, ts, value, event_id FROM events WHERE event_id % 7 > 0), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS k FROM w) WHERE k = 1), x AS (SELECT kind, key, ts, value, CASE kind WHEN 'view' THEN 86400 WHEN 'click' THEN 259200 WHEN 'signup' THEN 604800 WHEN 'purchase' THEN 1209600 ELSE 900 END::BIGINT AS seconds FROM l) SELECT *, floor(epoch(ts))::BIGINT + seconds AS expires FROM x WHERE floor(epoch(ts))::BIGINT + seconds >= epoch(TIMESTAMP '2024-01-20 00:00:00')::BIGINT",
    ),
    "catalog_rollup": (catalog_rollup, "SELECT p_brand, p_type, count(*) AS sites, sum(p_size)::BIGINT AS size FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())"),
    "stream_windows": (
        lambda s, d: windows.tumbling(table(s, d, "events"), "1 hour"),
        "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    ),
    "stream_sessions": (
        lambda s, d: windows.sessions(table(s, d, "events"), "30 minutes"),
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
    ),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items() if sql}
