"""Queries over profile fields read from landed pages and JSON answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import ids, urls
from attestor.operators import observed, profiles

from .views import HOST_SQL, table

#: What a landed page gets into its head, in turn: attributes in any order and quoting, comments, scripts, broken blocks.
HEADS = [
    '<meta property="og:title" content="Name{k} Lee &amp; Co - GitHub"><link rel="canonical" href="https://www.canon{k}.example/x/?utm_source=a&amp;q=1&amp;z=">',
    "<META content='Ann &quot;K{k}&quot; Bo · GitHub' PROPERTY=og:title><meta property=og:image content=//img.example/{k}.png>",
    '<!-- <meta property="og:title" content="Not This"> --><meta name="og:title" content="Second{k} Person | GitHub"><a rel="nofollow ME" href="https://www.site{k}.example/me/">x</a><a href=https://x.com/me{k} rel=me>y</a>',
    '<script type="application/ld+json">{"@type":"Person","name":"Json{k} Person","email":"J{k}@x.example","image":{"url":"https://img.example/j{k}.png"},"sameAs":["https://github.com/u{k}","https://own{k}.example/"]}</script><meta property="og:title" content="GitHub - Late{k} Name">',
    "<script>var s = \"<meta property='og:title' content='Inside'>\";</script><script type='application/ld+json'>[{\"@type\":\"Thing\",\"name\":\"no\"},{\"@type\":[\"Person\"],\"name\":\"List{k} Person\",\"url\":\"https://list{k}.example\",\"sameAs\":\"https://x.com/u{k}\"}]</script>",
    '<script type="application/ld+json">{broken</script><link href="{u}" rel="canonical"><meta property="og:title" content="u{k} profile">',
    '<meta property="og:title"><meta name="og:title" content="Never"><meta property="og:url" content="https://ogurl{k}.example:8080/a?b=c%20d&fbclid=1">',
]
PAYLOAD = '{"name":"Api{k} Name","blog":"blog{k}.example","bio":"Writes about {k} things","location":"Town{k}","id":{k},"company":"Org","email":"API{k}@x.example","twitter_username":"@tw{k}","avatar_url":"http://www.av.example/{k}?utm_medium=x"}'


def _profiles(s, d):
    """Landed pages with a head of their own each; one in five has a JSON answer too."""
    p = table(s, d, "pages")
    k = F.col("page_id").cast("string")
    fill = lambda c: F.replace(F.replace(c, F.lit("{k}"), k), F.lit("{u}"), F.col("url"))
    head = fill(F.element_at(F.array(*map(F.lit, HEADS)), (F.col("page_id") % len(HEADS) + 1).cast("int")))
    html = F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>")))
    payload = F.when(F.col("page_id") % 5 == 1, fill(F.lit(PAYLOAD)))
    return p.select("page_id", F.lit("GitHub").alias("platform"), F.concat(F.lit("@U"), k).alias("username"), F.col("url").alias("profile_url"), html.alias("html"), payload.alias("payload"), (F.col("page_id") % 3 == 0).alias("authenticated"))


def profile_fields(s, d):
    o = profiles.enrich_pages(_profiles(s, d)).select("page_id", F.explode("observed").alias("o")).select("page_id", "o.*")
    items = F.array_join(F.transform("items", lambda i: F.concat(i["value"], F.lit(" "), i["source"])), ",")
    return o.select("page_id", "field", "value", items.alias("items"), "source", "method", "source_url", "derived_from", "rejected_by")


def profile_summary(s, d):
    """How many pages show a field, and from where."""
    return profile_fields(s, d).groupBy("field", "source", "method").agg(F.count("*").alias("pages"), F.count("rejected_by").alias("rejected"))


_q = lambda v: "'" + v.replace("'", "''") + "'"
_list = lambda vs: "[" + ", ".join(map(_q, vs)) + "]"
_A = """[^>=]*(?:=\\s*(?:"[^"]*"|'[^']*'|[^\\s"'>][^\\s>]*)?[^>=]*)*"""
_T = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(f"<{t}{_A}>.*?(?:</{t}[^>]*>|\\z)" for t in ("script", "style", "textarea", "title")) + f"|<[a-z][^\\s/>=]*{_A}>"
_N = """([^\\s"'>/=][^\\s>/=]*)(?:\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'>][^\\s>]*))?"""
_PLATFORMS = _list(ids.PLATFORM_HOSTS)
_GENERIC = "|".join(observed.GENERIC_NAMES)


def _attr(t: str, name: str) -> str:
    return f"regexp_replace(list_extract(regexp_extract_all({t}, {_q(_N)}, 2), list_position(list_transform(regexp_extract_all({t}, {_q(_N)}, 1), lambda z: lower(z)), '{name}')), '^[\"'']|[\"'']$', '', 'g')"


def _meta(name: str) -> str:
    has = lambda key: f"list_filter(metas, lambda t: {_attr('t', key)} = '{name}')"
    return f"coalesce(trim(CASE WHEN len({has('property')}) > 0 THEN {_attr(has('property') + '[1]', 'content')} ELSE {_attr(has('name') + '[1]', 'content')} END), '')"


def _plain(c: str) -> str:
    out = c
    for name, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', {_q(char)})"
    return out


def _generic(n: str) -> str:
    low = f"lower(trim(regexp_replace({n}, '\\s+', ' ', 'g')))"
    known = lambda c: f"(list_contains({_list([*observed.PLATFORM_NAMES, 'github'])}, {c}))"
    parts = f"list_filter(regexp_split_to_array({low}, {_q(observed.TITLE_PARTS)}), lambda p: trim(p) <> '')"
    tokens = " OR ".join(f"contains({low}, '{t}')" for t in observed.TITLE_TOKENS)
    return f"""({low} = '' OR {low} = h OR replace({low}, ' ', '') = h OR (({tokens}) AND regexp_matches({low}, '\\b' || h || '\\b')) OR {known(low)} OR regexp_matches({low}, {_q(_GENERIC)})
  OR (len({parts}) >= 2 AND len(list_filter({parts}, lambda p: NOT ({known('trim(p)')} OR regexp_matches(trim(p), {_q(_GENERIC)})))) = 0))"""


def _suffixes(c: str) -> str:
    out = f"trim(regexp_replace({c}, '(?i)\\s*\\(@' || h || '\\)\\s*', ' '))"
    for p in profiles.TITLE_SUFFIXES:
        out = f"trim(regexp_replace({out}, {_q('(?i)' + p)}, ''))"
    return out


_U = "CASE WHEN starts_with(v, '//') THEN 'https:' || v WHEN regexp_matches(v, '(?i)^https?://') THEN v ELSE 'https://' || v END"
_TRACK = _list(urls.TRACKING)
_NORM = f"""SELECT id, prio, field, raw, source, method, derived, trim(raw) AS v, {_U} AS t FROM"""
_HOST = f"regexp_replace({HOST_SQL.format('t')}, '^www\\.', '')"
_PARAMETERS = f"list_filter(string_split(regexp_extract(t, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_extract(p, '^[^=]*=(.*)$', 1) <> '' AND NOT list_contains({_TRACK}, lower(split_part(p, '=', 1))))"

FIELDS = f"""f_page AS MATERIALIZED (SELECT page_id AS id, url, 'u' || page_id AS h, replace(html, '</head>', replace(replace({_list(HEADS)}[page_id % {len(HEADS)} + 1], '{{k}}', page_id::VARCHAR), '{{u}}', url) || '</head>') AS html,
  CASE WHEN page_id % 5 = 1 THEN replace({_q(PAYLOAD)}, '{{k}}', page_id::VARCHAR)::JSON END AS j, CASE WHEN page_id % 3 = 0 THEN 'AUTHENTICATED_PUBLIC' ELSE 'HTML' END AS m FROM pages),
f_token AS MATERIALIZED (SELECT *, list_filter(regexp_extract_all(html, {_q(_T)}), lambda t: regexp_matches(t, '(?i)^<(meta|link|a|script|title)[\\s/>]')) AS ts FROM f_page),
f_meta AS MATERIALIZED (SELECT *, list_filter(ts, lambda t: regexp_matches(t, '(?i)^<meta[\\s/>]')) AS metas, list_filter(ts, lambda t: regexp_matches(t, '(?i)^<link') AND list_contains(string_split(lower({_attr('t', 'rel')}), ' '), 'canonical')) AS canon,
  list_transform(list_filter(ts, lambda t: regexp_matches(t, '(?i)^<a\\s') AND list_contains(string_split(lower({_attr('t', 'rel')}), ' '), 'me')), lambda t: {_plain('trim(' + _attr('t', 'href') + ')')}) AS me,
  list_filter(list_transform(list_filter(ts, lambda t: regexp_matches(t, '(?i)^<script') AND {_attr('t', 'type')} = 'application/ld+json'), lambda t: regexp_extract(t, '(?s)>(.*)</script>$', 1)), lambda b: json_valid(b)) AS ld FROM f_token),
f_blob AS (SELECT id, b FROM (SELECT id, ord, unnest(CASE WHEN json_type(b) = 'ARRAY' THEN json_extract(b, '$[*]') ELSE [b] END) AS b FROM (SELECT id, unnest(ld)::JSON AS b, generate_subscripts(ld, 1) AS ord FROM f_meta))),
f_person AS (SELECT id, first(b) AS p FROM f_blob WHERE contains(lower(json_extract(b, '$."@type"')::VARCHAR), 'person') GROUP BY id),
f_own AS MATERIALIZED (SELECT f_meta.*, p, {_plain(_meta('og:title'))} AS og_title, {_plain(_meta('og:url'))} AS og_url, {_plain(_meta('og:image'))} AS og_image, {_plain('coalesce(' + _attr('canon[1]', 'href') + ", '')")} AS canonical,
  trim(regexp_replace({_plain("regexp_extract(list_filter(ts, lambda t: regexp_matches(t, '(?i)^<title'))[1], '(?is)^<title[^>]*>(.*)</title>$', 1)")}, '\\s+', ' ', 'g')) AS title FROM f_meta LEFT JOIN f_person USING (id)),
n_raw AS (SELECT id, h, 10 AS prio, j->>'name' AS raw, 'github_api.name' AS source, 'JSON_API' AS m, NULL AS rejected FROM f_own UNION ALL SELECT id, h, 20, p->>'name', 'html_jsonld.name', m, NULL FROM f_own
  UNION ALL SELECT id, h, 30, og_title, 'html_og.title', m, 'page_title_unverified' FROM f_own UNION ALL SELECT id, h, 31, title, 'html_title', m, 'page_title_unverified' FROM f_own),
n_cut AS MATERIALIZED (SELECT *, {_suffixes("trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g'))")} AS a FROM n_raw),
n_part AS MATERIALIZED (SELECT *, list_filter(list_transform(regexp_split_to_array(a, {_q(observed.TITLE_PARTS)}), lambda p: trim(p)), lambda p: p <> '') AS ps FROM n_cut),
n_rest AS MATERIALIZED (SELECT *, CASE WHEN len(ps) >= 2 AND list_contains({_list([*observed.PLATFORM_NAMES, 'github'])}, lower(ps[-1])) THEN array_to_string(ps[:len(ps) - 1], ' | ') WHEN len(ps) >= 2 AND list_contains({_list([*observed.PLATFORM_NAMES, 'github'])}, lower(ps[1])) THEN array_to_string(ps[2:], ' | ') ELSE '' END AS r FROM n_part),
n_text AS MATERIALIZED (SELECT *, trim(CASE WHEN r <> '' AND NOT {_generic('r')} THEN r ELSE a END, ' ·|-—–:') AS c FROM n_rest),
n_name AS (SELECT id, prio, c[1:200] AS value, source, m, rejected FROM n_text WHERE c <> '' AND regexp_replace(lower(c), '^@+', '') <> h AND trim(regexp_replace(regexp_replace(lower(strip_accents(c)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) <> h AND NOT {_generic('c')}),
same AS (SELECT id, m, unnest(CASE WHEN json_type(p->'sameAs') = 'ARRAY' THEN json_extract_string(p, '$.sameAs[*]') ELSE [p->>'sameAs'] END) AS raw, generate_subscripts(CASE WHEN json_type(p->'sameAs') = 'ARRAY' THEN json_extract_string(p, '$.sameAs[*]') ELSE [p->>'sameAs'] END, 1) AS k FROM f_own),
rel AS (SELECT id, m, unnest(me) AS raw, generate_subscripts(me, 1) AS k FROM f_own),
u_raw AS (SELECT id, 10 AS prio, 'site' AS field, j->>'blog' AS raw, 'github_api.blog' AS source, 'JSON_API' AS method, '' AS derived FROM f_own UNION ALL SELECT id, 10, 'avatar_url', j->>'avatar_url', 'github_api.avatar_url', 'JSON_API', '' FROM f_own
  UNION ALL SELECT id, 10, 'link', 'https://x.com/' || ltrim(j->>'twitter_username', '@'), 'github_api.twitter_username', 'JSON_API', '' FROM f_own
  UNION ALL SELECT id, 20, 'avatar_url', p->>'$.image.url', 'html_jsonld.image', m, '' FROM f_own UNION ALL SELECT id, 20 + k, 'link', raw, 'html_jsonld.sameAs', m, '' FROM same UNION ALL SELECT id, 29, 'site', p->>'url', 'html_jsonld.url', m, '' FROM f_own
  UNION ALL SELECT id, 30 + k, 'link', raw, 'html_rel_me', m, '' FROM rel UNION ALL SELECT id, 60, 'avatar_url', og_image, 'html_og.image', m, '' FROM f_own UNION ALL SELECT id, 61, 'site', canonical, 'html_canonical', m, '' FROM f_own UNION ALL SELECT id, 62, 'site', og_url, 'html_og.url', m, '' FROM f_own),
u_t AS ({_NORM} u_raw WHERE trim(raw) <> ''),
u_parsed AS (SELECT *, {_HOST} AS host, regexp_replace(regexp_extract(t, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1), '/+$', '') AS path, regexp_extract(t, '^[A-Za-z]+://[^/?#:]*:([0-9]+)', 1) AS port, {_PARAMETERS} AS q FROM u_t),
u_norm AS (SELECT *, 'https://' || host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || CASE path WHEN '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || replace(array_to_string(q, '&'), '%20', '+') ELSE '' END AS url, list_contains({_PLATFORMS}, host) AS social FROM u_parsed WHERE host <> ''),
u_kind AS (SELECT *, CASE WHEN field = 'link' THEN CASE WHEN social THEN 'social_links' ELSE 'external_links' END ELSE field END AS f FROM u_norm),
u_site AS (SELECT id, prio, url, host, source, method FROM u_kind WHERE NOT social AND (field = 'site' OR (field = 'link' AND source <> 'github_api.twitter_username'))),
c AS (SELECT id, prio, 'display_name' AS field, value, source, m AS method, NULL AS derived_from, rejected AS rejected_by FROM n_name
  UNION ALL SELECT id, 0, 'username', h, 'github.username', 'INPUT', NULL, NULL FROM f_own UNION ALL SELECT id, 10, 'bio', j->>'bio', 'github_api.bio', 'JSON_API', NULL, NULL FROM f_own UNION ALL SELECT id, 10, 'location', j->>'location', 'github_api.location', 'JSON_API', NULL, NULL FROM f_own
  UNION ALL SELECT id, 10, 'organization', j->>'company', 'github_api.company', 'JSON_API', NULL, NULL FROM f_own UNION ALL SELECT id, 10, 'public_id', j->>'id', 'github_api.id', 'JSON_API', NULL, NULL FROM f_own
  UNION ALL SELECT id, 10, 'public_email', lower(j->>'email'), 'github_api.email', 'JSON_API', NULL, NULL FROM f_own UNION ALL SELECT id, 20, 'public_email', lower(p->>'email'), 'html_jsonld.email', m, NULL, NULL FROM f_own
  UNION ALL SELECT id, prio, 'website', url, source, method, NULL, NULL FROM u_site UNION ALL SELECT id, prio, 'personal_domain', host, source, 'DERIVED', 'website', NULL FROM u_site
  UNION ALL SELECT id, prio, f, url, source, method, NULL, NULL FROM u_kind WHERE f IN ('avatar_url', 'social_links', 'external_links')),
o AS (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY prio) AS place FROM c WHERE trim(value) <> ''),
listed AS (SELECT id, field, string_agg(value || ' ' || source, ',' ORDER BY place) AS items FROM (SELECT id, field, value, source, min(place) AS place FROM o WHERE field IN ('social_links', 'external_links') GROUP BY ALL) GROUP BY ALL),
fields AS (SELECT o.id AS page_id, o.field, value, items, source, method, CASE WHEN method <> 'INPUT' THEN url END AS source_url, derived_from, rejected_by FROM o LEFT JOIN listed USING (id, field) JOIN f_page USING (id) WHERE place = 1)"""

_ALL = {
    "profile_fields": (profile_fields, f"WITH {FIELDS} SELECT * FROM fields"),
    "profile_summary": (profile_summary, f"WITH {FIELDS} SELECT field, source, method, count(*) AS pages, count(rejected_by) AS rejected FROM fields GROUP BY ALL"),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
