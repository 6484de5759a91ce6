"""Queries over landed mentions: what is asked of which service, what the answers hold, which hits stay. The answers are made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import discovery, mentions
from attestor.sources import mentions as landed

from .lead_queries import QUERY_PLAN, _lead_rows
from .views import table


def mention_requests(s, d):
    asked = landed.requests(discovery.query_plan(_lead_rows(s, d)), providers=tuple(landed.PROVIDERS))
    return asked.select("case", F.col("place").cast("long").alias("place"), F.col("rank").cast("long").alias("rank"), "provider", F.coalesce(F.try_element_at("params", F.lit("q")), F.try_element_at("params", F.lit("query"))).alias("q"), F.array_join(F.array_sort(F.map_keys("params")), ",").alias("names"))


def _answers(s, d):
    """An answer of each service for each eight customers, an entry for each order: some without link, of another type, or in error."""
    k, c, p = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 8), F.col("o_orderkey") % 7
    cs = c.cast("string")
    say = lambda *parts: F.concat(*(x if not isinstance(x, str) else cs if x == "{c}" else F.lit(x) for x in parts))
    pick = lambda m, *xs: F.element_at(F.array(*xs), (k % m + 1).cast("int"))
    title = pick(6, say("by Nick", "{c}", " today"), say("Ann  Lee", "{c}", " wrote "), say("mail A", "{c}", "@X.example"), say("see www.d", "{c}", ".example now"), F.lit("nothing"), F.lit(None).cast("string"))
    url = pick(5, say("https://a.example/@nick", "{c}", "/x/"), say("https://D", "{c}", ".example/p?q=1#f"), F.concat(F.lit("https://b.example/"), (k % 3).cast("string")), F.lit("ftp://c.example/x"), say("https://b.example/t?user=nick", "{c}"))
    text = F.when(k % 9 != 0, pick(4, say("write to A", "{c}", "@x.example"), say("Nick", "{c}", " says"), say("Ann Lee", "{c}", ", me"), say(*["long words "] * 30, "nick", "{c}")))
    o = table(s, d, "orders").select(k.alias("k"), c.alias("c"), p.alias("p"), title.alias("title"), url.alias("url"), text.alias("text"), F.when(k % 11 == 0, say("nick", "{c}")).alias("author"))
    k, third = F.col("k"), F.col("k") % 3 == 0
    href = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=1"))
    link = F.when(k % 17 != 0, F.concat(F.lit('<h2><a rel=x class="a result__a" href="'), href, F.lit('"><b>'), F.coalesce("title", F.lit("")), F.lit("</b></a></h2>"))).otherwise(F.lit("<h2><a>x</a></h2>"))
    page = F.concat(F.lit("<div class='result y'><br>"), link, F.lit('<p class="result__snippet">'), F.coalesce("text", F.lit("")), F.lit("</p></div>"))
    as_json = lambda *cols: F.to_json(F.struct(*cols))
    entries = {
        1: as_json(F.when(third, k).alias("objectID"), F.when(k % 2 == 0, F.col("title")).otherwise("").alias("title"), F.col("title").alias("story_title"), "url", F.col("text").alias("comment_text"), "author"),
        2: as_json("title", F.col("url").alias("html_url"), F.col("text").alias("body"), F.struct(F.col("author").alias("login")).alias("user")),
        3: as_json(F.struct("title", F.when(third, F.concat(F.lit("/r/"), (k % 4).cast("string"), F.lit("/"))).alias("permalink"), "url", F.col("text").alias("selftext"), "author", k.alias("created_utc")).alias("data")),
        5: as_json("title", F.col("url").alias("link"), F.col("text").alias("snippet")),
        6: as_json("title", F.when(k % 2 == 0, F.col("url")).alias("url"), F.when(k % 8 != 1, F.col("url")).alias("href"), F.col("text").alias("content")),
    }
    entry = page
    for at, made in entries.items():
        entry = F.when(F.col("p") == at, F.when(k % 17 == 0, F.lit('"none"')).otherwise(made)).otherwise(entry)
    a = o.groupBy("c", "p").agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("es"))
    es = F.transform("es", lambda x: x["e"])
    rows = F.concat(F.lit("["), F.array_join(es, ","), F.lit("]"))
    body = F.when(F.col("p") == 1, F.concat(F.lit('{"hits":'), rows, F.lit("}"))).when(F.col("p") == 3, F.concat(F.lit('{"data":{"children":'), rows, F.lit("}}"))).when(F.col("p") == 6, F.concat(F.lit('{"results":'), rows, F.lit("}")))
    body = body.when(F.col("p").isin(0, 4), F.concat(F.lit("<html><body>"), F.array_join(es, "\n"), F.lit("</body>"))).otherwise(F.concat(F.lit('{"items":'), rows, F.lit("}")))
    provider = F.element_at(F.array(*map(F.lit, landed.PROVIDERS)), (F.col("p") + 1).cast("int"))
    cs = F.col("c").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("username", "name", "email", "website"))), (F.col("c") % 4 + 1).cast("int"))
    query = F.when(kind == "username", F.concat(F.lit("@Nick"), cs)).when(kind == "name", F.concat(F.lit(" Ann Lee"), cs)).when(kind == "email", F.concat(F.lit("A"), cs, F.lit("@x.example"))).otherwise(F.concat(F.lit("https://www.d"), cs, F.lit(".example/x")))
    status = F.when((F.col("c") % 13 == 5) & (F.col("p") == 2), 429).otherwise(200)
    return a.select(F.col("c").alias("case"), kind.alias("kind"), query.alias("query"), F.col("c").alias("id"), provider.alias("provider"), status.alias("status"), body.alias("body"))


def _hits(s, d):
    return landed.hits(_answers(s, d))


def _leads(s, d):
    c = F.floor(F.col("o_custkey") / 8).cast("string")
    i = table(s, d, "orders").select(F.floor(F.col("o_custkey") / 8).alias("case"), F.concat(F.lit(" @Nick"), c).alias("username"), F.array(F.lit(" "), F.concat(F.lit("Ann Lee"), c)).alias("names"), F.concat(F.lit("A"), c, F.lit("@x.example ")).alias("email"), F.concat(F.lit("https://www.d"), c, F.lit(".example/x")).alias("website")).distinct()
    return mentions.case_leads(i)


def mention_hits(s, d):
    return _hits(s, d).select("case", "provider", F.col("place").cast("long").alias("place"), "read", "title", "url", "snippet", "author")


def case_leads(s, d):
    return _leads(s, d)


def mention_collect(s, d):
    m = mentions.as_findings(mentions.collected(mentions.judged(_hits(s, d), _leads(s, d)), ["case"]))
    joined = {c: F.array_join(c, ",") for c in ("associated", "sources", "tags")}
    return m.withColumns(joined).select("case", "provider", F.col("place").cast("long").alias("place"), "kind", "title", "url", "matched_field", "match_type", "matched_value", "excerpt", "relevance", "reason", "associated", "sources", "finding_confidence", "summary", "match_class", "canonical_url", "domain", "why", "entity_id", "tags")


def mention_collect_coverage(s, d):
    hits = _hits(s, d)
    return mentions.collection_coverage(hits, mentions.judged(hits, _leads(s, d)), ["case"])


_P = "[" + ", ".join(f"'{p}'" for p in landed.PROVIDERS) + "]"
#: From the orders, not from the answers: what each entry says, which of them are read, what they match, and a fold over services.
HITS = f"""v_o AS (SELECT o_orderkey AS k, o_custkey // 8 AS c, o_orderkey % 7 AS p, row_number() OVER (PARTITION BY o_custkey // 8, o_orderkey % 7 ORDER BY o_orderkey) - 1 AS place FROM orders),
v_said AS (SELECT *, coalesce(['by Nick' || c || ' today', 'Ann Lee' || c || ' wrote', 'mail A' || c || '@X.example', 'see www.d' || c || '.example now', 'nothing', NULL][k % 6 + 1], '') AS title,
  CASE WHEN p = 1 AND k % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || k WHEN p = 3 AND k % 3 = 0 THEN 'https://www.reddit.com/r/' || k % 4 || '/' WHEN p = 6 AND k % 2 <> 0 AND k % 8 = 1 THEN ''
    ELSE ['https://a.example/@nick' || c || '/x/', 'https://D' || c || '.example/p?q=1#f', 'https://b.example/' || k % 3, 'ftp://c.example/x', 'https://b.example/t?user=nick' || c][k % 5 + 1] END AS url,
  CASE WHEN k % 9 <> 0 THEN ['write to A' || c || '@x.example', 'Nick' || c || ' says', 'Ann Lee' || c || ', me', repeat('long words ', 30)[:240]][k % 4 + 1] ELSE '' END AS text, CASE WHEN k % 11 = 0 AND p IN (1, 2, 3) THEN 'nick' || c ELSE '' END AS author FROM v_o),
v_able AS (SELECT *, k % 17 <> 0 AND (p <> 6 OR url <> '') AS able FROM v_said WHERE NOT (c % 13 = 5 AND p = 2)),
v_read AS (SELECT *, able AND (p NOT IN (0, 4, 6) OR count(*) FILTER (able) OVER (PARTITION BY c, p ORDER BY k) <= CASE p WHEN 6 THEN 5 ELSE 10 END) AS read, CASE WHEN p = 3 AND text = '' THEN title ELSE text END AS snippet FROM v_able)"""
JUDGED = f"""v_valid AS (SELECT *, ['username', 'name', 'email', 'domain'][c % 4 + 1] AS kind, regexp_replace(regexp_replace(CASE WHEN k % 5 = 1 THEN replace(url, 'https://D', 'https://d') ELSE url END, '#.*$', ''), '/$', '') AS key FROM v_read WHERE read AND starts_with(url, 'https://')),
v_says AS (SELECT *, contains(url, 'nick' || c) AS nick_url, contains(lower(title), 'nick' || c) AS nick_title, contains(lower(snippet), 'nick' || c) AS nick_snippet, author <> '' AS nick_author, contains(title, 'Ann Lee' || c) AS ann_title, contains(snippet, 'Ann Lee' || c) AS ann_snippet,
  contains(lower(title), 'a' || c || '@x.example') AS mail_title, contains(lower(snippet), 'a' || c || '@x.example') AS mail_snippet, starts_with(lower(url), 'https://d' || c || '.') AS host_url, contains(title, 'www.d' || c) AS host_title, contains(snippet, 'www.d' || c) AS host_snippet FROM v_valid),
v_field AS (SELECT *, CASE kind WHEN 'username' THEN CASE WHEN nick_url THEN 'url' WHEN nick_title THEN 'title' WHEN nick_snippet THEN 'snippet' WHEN nick_author THEN 'author' END WHEN 'name' THEN CASE WHEN ann_title THEN 'title' WHEN ann_snippet THEN 'snippet' END
  WHEN 'email' THEN CASE WHEN mail_title THEN 'title' WHEN mail_snippet THEN 'snippet' END ELSE CASE WHEN host_url THEN 'url' WHEN host_title THEN 'title' WHEN host_snippet THEN 'snippet' END END AS field,
  list_filter([CASE WHEN nick_url OR nick_title OR nick_snippet OR nick_author THEN 'Nick' || c END, CASE WHEN mail_title OR mail_snippet THEN 'A***@x.example' END, CASE WHEN host_url OR host_title OR host_snippet THEN 'd' || c || '.example' END], lambda x: x IS NOT NULL) AS others FROM v_says),
v_match AS (SELECT * FROM v_field WHERE field IS NOT NULL),
v_first AS (SELECT c, p + 1 AS rank, key, min(place) AS seen FROM v_match GROUP BY ALL),
v_list AS (SELECT c, rank, list(key ORDER BY seen) AS ks FROM v_first GROUP BY ALL),
v_fold(c, r, acc) AS (SELECT DISTINCT c, 0::BIGINT, []::STRUCT(rank BIGINT, key VARCHAR)[] FROM v_match UNION ALL
  SELECT f.c, r + 1, list_concat(acc, list_transform(list_filter(coalesce(ks, []), lambda x: NOT list_contains(list_transform(acc, lambda y: y.key), x))[1:5], lambda x: {{rank: r + 1, key: x}})) FROM v_fold f LEFT JOIN v_list l ON l.c = f.c AND l.rank = r + 1 WHERE r < 7),
v_kept AS (SELECT c, a.rank AS rank, a.key AS key FROM (SELECT c, unnest(acc) AS a FROM v_fold WHERE r = 7)),
v_sources AS (SELECT c, key, k.rank, string_agg({_P}[f.rank], ',' ORDER BY f.rank) AS sources FROM v_kept k JOIN v_first f USING (c, key) WHERE f.rank >= k.rank GROUP BY ALL),
v_stay AS (SELECT m.*, s.rank, s.sources, s.rank = p + 1 AND m.place = f.seen AS stays FROM v_match m LEFT JOIN v_sources s USING (c, key) JOIN v_first f ON f.c = m.c AND f.key = m.key AND f.rank = p + 1)"""
COLLECT = f"""WITH RECURSIVE {HITS}, {JUDGED},
v_value AS (SELECT *, CASE kind WHEN 'username' THEN CASE field WHEN 'url' THEN 'url_path_segment' ELSE 'exact_token' END WHEN 'name' THEN 'full_name' WHEN 'email' THEN 'exact_email' ELSE 'exact_host' END AS match_type,
  CASE kind WHEN 'username' THEN 'Nick' || c WHEN 'name' THEN 'Ann Lee' || c WHEN 'email' THEN 'a' || c || '@x.example' ELSE 'd' || c || '.example' END AS matched_value FROM v_stay WHERE stays)
SELECT c AS "case", {_P}[p + 1] AS provider, place, kind, title, url, field AS matched_field, match_type, matched_value, CASE field WHEN 'url' THEN CASE kind WHEN 'domain' THEN matched_value ELSE url END WHEN 'title' THEN title WHEN 'author' THEN author ELSE snippet END AS excerpt,
  CASE WHEN kind <> 'name' THEN 'DIRECT' WHEN len(others) > 0 THEN 'ASSOCIATED' ELSE 'AMBIGUOUS' END AS relevance,
  CASE match_type WHEN 'exact_token' THEN 'exact_username' WHEN 'url_path_segment' THEN 'username_path' WHEN 'exact_email' THEN 'exact_email' WHEN 'exact_host' THEN 'exact_domain' ELSE CASE left(others[1], 1) WHEN 'N' THEN 'name_plus_username' WHEN 'A' THEN 'name_plus_email' WHEN 'd' THEN 'name_plus_domain' ELSE 'full_name_only' END END AS reason,
  CASE kind WHEN 'name' THEN array_to_string(others, ',') ELSE '' END AS associated, sources, CASE WHEN match_type IN ('exact_token', 'full_name') THEN 'LOW' ELSE 'MEDIUM' END AS finding_confidence,
  'OBSERVED mention of ' || CASE kind WHEN 'username' THEN '@@Nick' || c WHEN 'email' THEN 'A' || c || '@x.example' WHEN 'name' THEN matched_value ELSE 'https://www.' || matched_value || '/x' END || ': ' || title AS summary,
  CASE kind WHEN 'username' THEN 'EXACT_MATCH' ELSE match_type END AS match_class, key AS canonical_url, regexp_extract(key, 'https://([^/]+)', 1) AS domain, match_type || ' in ' || field AS why, sha256('PUBLIC_MENTION:' || key)[:24] AS entity_id, 'public-mention,not-profile' AS tags FROM v_value"""
COVERAGE = f"""WITH RECURSIVE {HITS}, {JUDGED},
v_n AS (SELECT o.c, o.p, CASE WHEN o.c % 13 = 5 AND o.p = 2 THEN 1 ELSE 0 END AS errors, count(r.k) AS raw, count(*) FILTER (r.read AND starts_with(r.url, 'https://')) AS parsed FROM v_o o LEFT JOIN v_read r USING (k) GROUP BY ALL),
v_m AS (SELECT c, p, count(*) AS matched, count(*) FILTER (stays) AS deduped, count(*) FILTER (NOT stays AND rank <= p + 1) AS dup FROM v_stay GROUP BY ALL)
SELECT c AS "case", {_P}[p + 1] AS provider, raw, parsed, coalesce(matched, 0) AS matched, coalesce(deduped, 0) AS deduped, parsed - coalesce(matched, 0) AS rejected_no_exact_match, raw - parsed AS rejected_invalid_url, coalesce(dup, 0) AS rejected_duplicate, errors::BIGINT AS errors FROM v_n LEFT JOIN v_m USING (c, p)"""
REQUESTS = f"""WITH {QUERY_PLAN}, t AS (SELECT p."case", place, ltrim(trim(text), '@') AS q FROM p WHERE place <= 12),
f(rank, more, names) AS (VALUES (0, '', 'q'), (1, '', 'hitsPerPage,query'), (2, ' in:title,body', 'per_page,q'), (3, '', 'limit,q,sort'), (4, ' (filetype:pdf OR filetype:doc OR filetype:docx)', 'q'), (5, '', 'num,q'), (6, '', 'format,q'))
SELECT "case", place, rank::BIGINT AS rank, {_P}[rank + 1] AS provider, q || more AS q, names FROM t, f"""
LEADS = """WITH c AS (SELECT DISTINCT o_custkey // 8 AS c FROM orders) SELECT c AS "case", unnest(['username', 'name', 'email', 'domain']) AS kind, unnest(['Nick' || c, 'Ann Lee' || c, 'A' || c || '@x.example', 'd' || c || '.example']) AS lead, unnest([0, 1000001, 2000000, 3000000]::BIGINT[]) AS ord FROM c"""
# an answer in error is one row without an entry
HIT_ROWS = f"""WITH {HITS} SELECT c AS "case", {_P}[p + 1] AS provider, place, read, CASE WHEN read THEN title END AS title, CASE WHEN read THEN url END AS url, CASE WHEN read THEN snippet END AS snippet, CASE WHEN read THEN author END AS author FROM v_read
UNION ALL SELECT DISTINCT c, {_P}[3], NULL::BIGINT, false, NULL, NULL, NULL, NULL FROM v_o WHERE c % 13 = 5 AND p = 2"""

_ALL = {"mention_requests": (mention_requests, REQUESTS), "mention_hits": (mention_hits, HIT_ROWS), "case_leads": (case_leads, LEADS), "mention_collect": (mention_collect, COLLECT), "mention_collect_coverage": (mention_collect_coverage, COVERAGE)}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
