"""Queries over landed pages and documents: URLs, values, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import ids, text, times, urls
from attestor.operators import similar
from attestor.sources.steps import bounded, cut

from .views import HOST_SQL, table

HOST = HOST_SQL.format("url")
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
PORT = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)', 1)"
SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
BARE = f"regexp_replace({HOST}, '^www\\.', '')"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


CANONICAL = f"""({SCHEME} || '://' || {HOST} || CASE WHEN {PORT} = '' OR ({SCHEME} = 'http' AND {PORT} = '80') OR ({SCHEME} = 'https' AND {PORT} = '443') THEN '' ELSE ':' || {PORT} END
  || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN {QUERY} = '' THEN '' ELSE '?' || {QUERY} END)"""
IPV4 = "^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
PRIVATE = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in urls._bounds())
TOKENS = "SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS v FROM documents"
COUNTRY = "regexp_full_match(l[-1], '[a-z]{2}')"
SUFFIX_LABELS = f"CASE WHEN len(l) >= 2 AND {COUNTRY} AND l[-2] IN {_in(urls.SECOND_LEVELS)} THEN 2 WHEN len(l) >= 2 AND ({COUNTRY} OR l[-1] IN {_in(urls.SUFFIXES)}) THEN 1 ELSE 0 END"
DOMAIN_OK = f"({SUFFIX_LABELS}) BETWEEN 1 AND len(l) - 1"

HASH_SQL = "CASE WHEN regexp_full_match(v, '[A-Fa-f0-9]+') THEN CASE length(v) WHEN 32 THEN 'MD5' WHEN 40 THEN 'SHA1' WHEN 64 THEN 'SHA256' WHEN 128 THEN 'SHA512' END END"


def _type_sql(source: str) -> str:
    return f"""t AS (SELECT *, rtrim(split_part(split_part(regexp_replace(lower(v), '^[a-z][a-z0-9+.-]*://', ''), '/', 1), ':', 1), '.') AS dom FROM {source}),
d AS (SELECT *, string_split(dom, '.') AS l FROM t),
e AS (SELECT *, CASE WHEN regexp_full_match(dom, '([A-Za-z0-9]([A-Za-z0-9\\-]{{0,61}}[A-Za-z0-9])?\\.)+[A-Za-z]{{2,}}') AND {DOMAIN_OK} THEN dom END AS domain FROM d),
y AS (SELECT *, CASE WHEN v = '' THEN NULL WHEN {HASH_SQL} IS NOT NULL THEN 'HASH' WHEN regexp_matches(v, '{IPV4}') THEN 'IP'
  WHEN regexp_full_match(v, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}') THEN 'EMAIL'
  WHEN regexp_matches(v, '^(?i:https?)://[^/?#]') OR regexp_matches(v, '^(?i:www\\.)[^/?#]') THEN 'URL'
  WHEN regexp_full_match(v, '(?i:AS)?[0-9]{{1,10}}') THEN 'ASN' WHEN domain IS NOT NULL THEN 'DOMAIN' WHEN regexp_full_match(v, '[A-Za-z0-9._\\-]{{1,64}}') THEN 'USERNAME'
  WHEN regexp_full_match(v, '\\+?[0-9][0-9\\-\\s()]{{6,20}}') THEN 'PHONE' WHEN contains(v, ' ') OR length(v) > 3 THEN 'COMPANY' END AS kind FROM e)"""


def _tokens(spark, sf_dir):
    """The words of all documents with their numbers: each value is typed once, however often it occurs."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("v")).groupBy("v").agg(F.count("*").alias("times"))


def _once(df, **columns):
    """Columns that later expressions read: a generator stands between, so that each is computed once and not wherever it is read."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _typed(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    t = _once(t, domain=F.when(F.col("v").contains("."), ids.domain_of(F.col("v"))))
    return _once(t, kind=ids.entity_type(F.col("v"), F.col("domain")))


NORM_SQL = f"CASE kind WHEN 'HASH' THEN lower(v) WHEN 'EMAIL' THEN lower(v) WHEN 'ASN' THEN 'AS' || regexp_extract(v, '([0-9]+)$', 1)::BIGINT WHEN 'DOMAIN' THEN domain WHEN 'USERNAME' THEN lower(regexp_replace(v, '^@', '')) WHEN 'PHONE' THEN regexp_replace(v, '[^0-9+]', '', 'g') WHEN 'URL' THEN {CANONICAL} ELSE v END"
TOKEN_SQL = f"s AS ({TOKENS})"

FLAGS_SQL = f"""list_filter([CASE WHEN contains(h, 'xn--') THEN 'punycode' END, CASE WHEN regexp_matches(h, '[^\\x00-\\x7F]') THEN 'homoglyph_or_unicode' END,
  CASE WHEN regexp_extract(h, '\\.([^.]+)$', 1) IN {_in(urls.SUSPICIOUS_TLDS)} THEN 'suspicious_tld.' || regexp_extract(h, '\\.([^.]+)$', 1) END, CASE WHEN length(h) > 50 THEN 'long_hostname' END,
  CASE WHEN regexp_full_match(h, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') THEN 'ip_url' END, CASE WHEN h IN {_in(urls.SHORTENERS)} THEN 'url_shortener' END,
  CASE WHEN contains(url, '%') THEN 'encoded_url' END, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]+@') THEN 'embedded_credentials' END], lambda x: x IS NOT NULL)"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def url_canonical(s, d):
    c = urls.canonical(F.col("url"))
    return _pages(s, d).select("page_id", c.alias("canonical"), ids.entity_id(F.lit("URL"), c).alias("entity_id"))


def url_identity_norm(s, d):
    return _pages(s, d).select("page_id", urls.identity(F.col("url")).alias("identity_url"), urls.avatar_key(F.col("url")).alias("avatar_key"))


def url_host_registrable(s, d):
    h = urls.host_of(F.col("url"))
    return _pages(s, d).groupBy(h.alias("host")).agg(F.count("*").alias("pages")).select("host", "pages", urls.registrable(F.col("host")).alias("domain"))


def url_risk_flags(s, d):
    p = _pages(s, d).withColumn("flags", urls.risk_flags(F.col("url")))
    return p.select("page_id", F.array_join("flags", ",").alias("flags"), urls.risk_level(F.col("flags")).alias("level"))


def url_syntax_guard(s, d):
    # some pages' URLs made unfit, so that every reason occurs
    u = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?", "ftp")).when(F.col("page_id") % 7 == 1, F.regexp_replace("url", "://", "://user:pw@")).when(F.col("page_id") % 7 == 2, F.concat(F.lit("http://10.0.0."), F.col("page_id").cast("string"))).when(F.col("page_id") % 7 == 3, F.lit("http://localhost/x")).otherwise(F.col("url"))
    return _pages(s, d).select("page_id", F.coalesce(urls.syntax_reason(u), F.lit("ok")).alias("reason"))


PATHS = ["users/u{}", "@h{}", "en/user/h{}/posts", "p/{}", "id/h{}", "in/h{}/", "people/@h{}", "a/{}", "u{}", "authors/h{}", "x/@h{}/about", ""]


def profile_url_shape(s, d):
    """Every path of ``PATHS`` on each page's host, and each page's own URL."""
    p = _pages(s, d)
    n = F.col("page_id").cast("string")
    made = F.array(F.col("url"), *(F.concat(F.lit("https://site.example/" + x.split("{}")[0]), *([n, F.lit(x.split("{}")[1])] if "{}" in x else [])) for x in PATHS))
    t = p.select("page_id", F.posexplode(made).alias("form", "u"))
    return t.select("page_id", F.col("form").cast("long").alias("form"), urls.profile_shape(F.col("u")).alias("is_profile"), urls.candidate_handle(F.col("u"), F.lit("")).alias("handle"))


def detect_type(s, d):
    return _typed(s, d).groupBy("kind").agg(F.sum("times").alias("n"), F.count("*").alias("values"))


def entity_id_hash(s, d):
    t = _once(_typed(s, d).where("kind IS NOT NULL"), norm=ids.normalised(F.col("kind"), F.col("v"), F.col("domain")))
    return t.groupBy("kind", "norm").agg(F.sum("times").alias("n")).select("kind", "norm", "n", ids.entity_id(F.col("kind"), F.col("norm")).alias("entity_id"))


def ip_extract_classify(s, d):
    t = _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.IPV4_IN_TEXT), F.lit(1))).alias("ip"))
    return t.select("doc_id", "ip", urls.ipv4_number(F.col("ip")).alias("number"), urls.private_ipv4(F.col("ip")).alias("private"))


def email_extract(s, d):
    t = _docs(s, d).select("doc_id", F.explode(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({text.EMAIL_IN_TEXT})"), F.lit(1))))).alias("email"))
    return t.select("doc_id", "email", F.split_part("email", F.lit("@"), F.lit(2)).alias("domain"), F.md5("email").alias("avatar_md5"))


def hash_detect(s, d):
    t = _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({text.HEX_IN_TEXT})"), F.lit(1))).alias("v"))
    return t.select("doc_id", F.lower("v").alias("hash"), ids.hash_algorithm(F.col("v")).alias("algorithm"))


def secret_redaction_counts(s, d):
    counts = {k: c.cast("long").alias(k) for k, c in text.secret_counts(F.col("text")).items()}
    t = _docs(s, d).select("doc_id", *counts.values())
    return t.where(" OR ".join(f"{k} > 0" for k in counts))


def mask_secret(s, d):
    t = _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([^"]*)"'), F.lit(1))).alias("secret"))
    return t.select("doc_id", ids.mask(F.col("secret")).alias("masked"), F.length("secret").cast("long").alias("n"))


NEEDLES = ("TOKEN", "license", "not there at all")


def excerpt_window(s, d):
    t = _docs(s, d).select("doc_id", "text", F.explode(F.array(*map(F.lit, NEEDLES))).alias("needle"))
    return t.select("doc_id", "needle", text.excerpt(F.col("text"), F.col("needle")).alias("excerpt"))


def text_fold(s, d):
    return _docs(s, d).select("doc_id", F.sha2(text.folded(F.col("text")), 256).alias("folded"))


def title_extract(s, d):
    return _pages(s, d).select("page_id", text.title_of(F.col("html")).alias("title"))


def tech_hints(s, d):
    return _pages(s, d).select("page_id", F.array_join(text.tech_hints(F.lower(F.concat_ws(" ", "html", "url"))), ",").alias("tech"))


def anchor_explode(s, d):
    t = _pages(s, d).select("page_id", F.posexplode(text.anchors(F.col("html"))).alias("pos", "href"))
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


DATE_LENGTHS = (14, 12, 10, 8, 13, 9, 15, 16, 11, 7)


def parse_dates(s, d):
    """Every day of every month, as digits of each length and as ISO text."""
    e = table(s, d, "events")
    at = F.expr("TIMESTAMP '2023-01-01 00:00:00' + make_dt_interval(cast(event_id * 7 % 800 AS INT), cast(event_id % 24 AS INT), cast(event_id * 11 % 60 AS INT), cast(event_id * 13 % 60 AS INT))")
    digits = F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit("77"))
    forms = [F.substr(digits, F.lit(1), F.lit(n)) for n in DATE_LENGTHS] + [F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.date_format(at, "yyyy-MM-dd"), F.lit("20240231"), F.lit("20240115996000"), F.lit("soon")]
    t = e.select("event_id", F.posexplode(F.array(*forms)).alias("form", "raw"))
    return t.select("event_id", F.col("form").cast("long").alias("form"), "raw", times.parse_instant(F.col("raw")).cast("timestamp_ntz").alias("parsed"))


def duration_format(s, d):
    seconds = F.when(F.col("event_id") % 17 != 0, (F.col("event_id") * 37 % 9000).cast("double") / 2 - 5)
    return table(s, d, "events").select("event_id", seconds.alias("seconds"), times.duration_text(seconds).alias("text"))


def time_texts(s, d):
    """Instants as text, and how long ago they were."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    at = F.when(F.col("event_id") % 19 != 0, F.col("ts").cast("timestamp"))
    near = F.when(F.col("event_id") % 19 != 0, now - F.make_dt_interval(secs=(F.col("event_id") % 7000).cast("decimal(18,6)")))
    return table(s, d, "events").select("event_id", times.instant_text(at).alias("instant"), times.relative_age(at, now).alias("age"), times.relative_age(near, now).alias("near_age"), times.age_seconds(F.col("ts").cast("timestamp"), now).alias("seconds"))


def backoff_table(s, d):
    attempt = (F.col("event_id") % 8).cast("double")
    asked = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 50).cast("double")
    return table(s, d, "events").select("event_id", times.backoff(attempt, asked).alias("wait"))


def token_jaccard_pairs(s, d):
    """Documents of one source whose words of over three letters are alike (0.65), by prefix filter; equal sets are one, named by the smallest doc_id."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 3))
    w = _docs(s, d).select(F.col("doc_id").alias("id"), "source", words.alias("words")).where(F.size("words") >= 3)
    # equal sets meet by a digest of their words, which hold no spaces
    same = F.sha2(F.array_join(F.array_sort("words"), " "), 256)
    once = cut(w.groupBy("source", same.alias("same")).agg(F.min("id").alias("id")).select("id", F.col("source").alias("o_source")), "once")
    w = w.join(bounded(once).withColumnRenamed("id", "o_id"), (F.col("id") == F.col("o_id")) & (F.col("source") == F.col("o_source")), "left_semi")
    jaccard = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    j = similar.set_pairs(w, 65, "source")
    return j.select(F.col("id").alias("doc_id"), "other", F.round(jaccard, 6).alias("jaccard")).where("jaccard >= 0.65")


RE2_SECRETS = {k: p.replace("'", "''") for k, p in text.SECRETS.items()}
SUFFIX_OF = f"CASE WHEN {DOMAIN_OK} THEN array_to_string(l[len(l) - ({SUFFIX_LABELS}):], '.') END"

AGE = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} < 60 THEN {0} || 's ago' WHEN {0} < 3600 THEN {0} // 60 || 'm ago' WHEN {0} < 172800 THEN {0} // 3600 || 'h ago' ELSE {0} // 86400 || 'd ago' END"

_ALL = {
    "url_canonical": (url_canonical, f"SELECT page_id, {CANONICAL} AS canonical, sha256('URL:' || {CANONICAL})[1:24] AS entity_id FROM pages"),
    "url_identity_norm": (
        url_identity_norm,
        f"WITH q AS (SELECT page_id, url, array_to_string(list_filter(string_split({QUERY}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {_in(urls.TRACKING)}), '&') AS q FROM pages) SELECT page_id, 'https://' || {BARE} || regexp_replace({PATH}, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS identity_url, sha256(regexp_replace(url, '[?#].*$', ''))[1:16] AS avatar_key FROM q",
    ),
    "url_host_registrable": (url_host_registrable, f"WITH h AS (SELECT {HOST} AS host, count(*) AS pages FROM pages GROUP BY 1), s AS (SELECT *, string_split(host, '.') AS l FROM h) SELECT host, pages, {SUFFIX_OF} AS domain FROM s"),
    "url_risk_flags": (
        url_risk_flags,
        f"WITH h AS (SELECT page_id, url, {HOST} AS h FROM pages), f AS (SELECT page_id, {FLAGS_SQL} AS f FROM h) SELECT page_id, array_to_string(f, ',') AS flags, CASE WHEN list_has_any(f, ['punycode', 'homoglyph_or_unicode', 'embedded_credentials']) THEN 'HIGH_RISK' WHEN len(f) > 0 THEN 'SUSPICIOUS' ELSE 'LOW' END AS level FROM f",
    ),
    "url_syntax_guard": (
        url_syntax_guard,
        f"""WITH m AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN regexp_replace(url, '^https?', 'ftp') WHEN 1 THEN regexp_replace(url, '://', '://user:pw@') WHEN 2 THEN 'http://10.0.0.' || page_id WHEN 3 THEN 'http://localhost/x' ELSE url END AS url FROM pages),
h AS (SELECT page_id, url, {HOST} AS h FROM m), i AS (SELECT *, CASE WHEN regexp_matches(h, '{IPV4}') THEN string_split(h, '.')[1]::BIGINT * 16777216 + string_split(h, '.')[2]::BIGINT * 65536 + string_split(h, '.')[3]::BIGINT * 256 + string_split(h, '.')[4]::BIGINT END AS n FROM h)
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^(?i:https?)://') THEN 'scheme' WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') THEN 'credentials' WHEN h = '' THEN 'no_host'
  WHEN h IN ('localhost', 'metadata.google.internal') OR regexp_matches(h, '\\.(local|internal|localhost)$') THEN 'blocked_host'
  WHEN regexp_full_match(h, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') AND (n IS NULL OR {PRIVATE} OR n BETWEEN 3758096384 AND 4026531839) THEN 'blocked_ip' ELSE 'ok' END AS reason FROM i""",
    ),
    "profile_url_shape": (
        profile_url_shape,
        f"""WITH m AS (SELECT page_id, unnest([url, {", ".join("'https://site.example/" + x.replace("{}", "' || page_id || '") + "'" for x in PATHS)}]) AS url, unnest(range(0, {len(PATHS) + 1})) AS form FROM pages),
r AS (SELECT page_id, form, lower({PATH}) AS path, list_filter(string_split(lower({PATH}), '/'), lambda x: x <> '') AS raw FROM m),
q AS (SELECT *, list_filter(list_transform(raw, lambda x: regexp_replace(x, '^@+', '')), lambda x: x <> '') AS parts FROM r),
k AS (SELECT *, list_filter(range(1, len(parts)), lambda i: list_contains({[h.strip("/") for h in urls.PROFILE_HINTS]}, parts[i]))[1] AS i, list_filter(raw, lambda x: regexp_matches(x, '^@.'))[1] AS a FROM q)
SELECT page_id, form, regexp_matches(path, '/@|{"|".join(urls.PROFILE_HINTS)}') AS is_profile, CASE WHEN i IS NOT NULL THEN parts[i + 1] WHEN a IS NOT NULL THEN regexp_replace(a, '^@+', '') WHEN length(parts[1]) >= 3 THEN parts[1] ELSE '' END AS handle FROM k""",
    ),
    "detect_type": (detect_type, f"WITH {TOKEN_SQL}, {_type_sql('s')} SELECT kind, count(*) AS n, count(DISTINCT v) AS values FROM y GROUP BY kind"),
    "entity_id_hash": (entity_id_hash, f"WITH {TOKEN_SQL}, {_type_sql('s')}, n AS (SELECT kind, {NORM_SQL} AS norm, count(*) AS n FROM (SELECT *, CASE WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN v ELSE 'https://' || v END AS url FROM y) WHERE kind IS NOT NULL GROUP BY ALL) SELECT *, sha256(kind || ':' || norm)[1:24] AS entity_id FROM n"),
    "ip_extract_classify": (
        ip_extract_classify,
        f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{text.IPV4_IN_TEXT}', 1)) AS ip FROM documents),
n AS (SELECT *, CASE WHEN regexp_matches(ip, '{IPV4}') THEN string_split(ip, '.')[1]::BIGINT * 16777216 + string_split(ip, '.')[2]::BIGINT * 65536 + string_split(ip, '.')[3]::BIGINT * 256 + string_split(ip, '.')[4]::BIGINT END AS n FROM t)
SELECT doc_id, ip, n AS number, CASE WHEN n IS NOT NULL THEN {PRIVATE} END AS private FROM n""",
    ),
    "email_extract": (email_extract, f"WITH t AS (SELECT doc_id, unnest(list_sort(list_distinct(regexp_extract_all(lower(text), '{text.EMAIL_IN_TEXT}')))) AS email FROM documents) SELECT doc_id, email, split_part(email, '@', 2) AS domain, md5(email) AS avatar_md5 FROM t"),
    "hash_detect": (hash_detect, f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{text.HEX_IN_TEXT}')) AS v FROM documents) SELECT doc_id, lower(v) AS hash, {HASH_SQL} AS algorithm FROM t"),
    "secret_redaction_counts": (
        secret_redaction_counts,
        f"WITH c AS (SELECT doc_id, {', '.join(f'''len(regexp_extract_all(text, '{p}'))::BIGINT AS {k}''' for k, p in RE2_SECRETS.items())} FROM documents) SELECT * FROM c WHERE {' OR '.join(f'{k} > 0' for k in RE2_SECRETS)}",
    ),
    "mask_secret": (mask_secret, "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = \"([^\"]*)\"', 1)) AS v FROM documents) SELECT doc_id, CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE v[1:2] || repeat('*', greatest(4, length(v) - 4)) || v[-2:] END AS masked, length(v) AS n FROM t"),
    "excerpt_window": (
        excerpt_window,
        f"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS f, unnest({list(NEEDLES)}) AS needle FROM documents), p AS (SELECT *, instr(lower(f), lower(needle)) - 1 AS idx FROM t),
w AS (SELECT *, greatest(0, idx - 45) AS b, least(length(f), idx + length(needle) + 45) AS e FROM p)
SELECT doc_id, needle, CASE WHEN idx < 0 THEN substr(f, 1, 180) ELSE CASE WHEN b > 0 THEN '…' ELSE '' END || substr(f, b + 1, e - b) || CASE WHEN e < length(f) THEN '…' ELSE '' END END AS excerpt FROM w""",
    ),
    "text_fold": (text_fold, "SELECT doc_id, sha256(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g'))) AS folded FROM documents"),
    "title_extract": (title_extract, "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages"),
    "tech_hints": (
        tech_hints,
        "WITH b AS (SELECT page_id, lower(html || ' ' || url) AS b FROM pages) SELECT page_id, array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN {' OR '.join(f'contains(b, {n!r})' for n in ns)} THEN '{name}' END" for name, ns in text.TECH_HINTS.items())
        + "], lambda x: x IS NOT NULL), ',') AS tech FROM b",
    ),
    "anchor_explode": (anchor_explode, "WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS a FROM pages) SELECT page_id, unnest(range(0, len(a))) AS pos, unnest(a) AS href FROM a"),
    "parse_dates": (
        parse_dates,
        f"""WITH a AS (SELECT event_id, TIMESTAMP '2023-01-01' + to_days((event_id * 7 % 800)::INT) + to_hours((event_id % 24)::INT) + to_minutes((event_id * 11 % 60)::INT) + to_seconds((event_id * 13 % 60)::INT) AS t FROM events),
g AS (SELECT *, strftime(t, '%Y%m%d%H%M%S') || '77' AS g FROM a),
f AS (SELECT event_id, unnest([{", ".join(f"g[1:{n}]" for n in DATE_LENGTHS)}, strftime(t, '%Y-%m-%d %H:%M:%S'), strftime(t, '%Y-%m-%dT%H:%M:%SZ'), strftime(t, '%Y-%m-%d'), '20240231', '20240115996000', 'soon']) AS raw, unnest(range(0, {len(DATE_LENGTHS) + 6})) AS form FROM g),
-- of eight digits: a month of two digits, then day and hour of one each; failing that a month of one, a day of two and an hour of one
o AS (SELECT *, raw[5:6] AS mm, raw[5:5] AS m, length(raw) AS n FROM f),
x AS (SELECT *, CASE WHEN n = 8 AND mm BETWEEN '01' AND '12' AND raw[7:7] BETWEEN '1' AND '9' THEN raw[1:4] || '-' || mm || '-0' || raw[7:7] || ' 0' || raw[8:8]
  WHEN n = 8 AND m = '1' AND raw[6:7] BETWEEN '10' AND '31' THEN raw[1:4] || '-01-' || raw[6:7] || ' 0' || raw[8:8] END AS odd FROM o)
SELECT event_id, form, raw, CASE WHEN NOT regexp_full_match(raw, '[0-9]+') THEN coalesce(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(raw, '%Y-%m-%d')) WHEN n < 8 THEN NULL
  WHEN n = 8 AND odd IS NOT NULL THEN coalesce(try_strptime(odd || ':00:00', '%Y-%m-%d %H:%M:%S'), try_strptime(raw, '%Y%m%d'))
  WHEN n = 10 THEN coalesce(try_strptime(raw || '00', '%Y%m%d%H%M'), try_strptime(raw[1:8], '%Y%m%d')) WHEN n = 12 THEN coalesce(try_strptime(raw, '%Y%m%d%H%M'), try_strptime(raw[1:8], '%Y%m%d'))
  WHEN n >= 14 THEN coalesce(try_strptime(raw[1:14], '%Y%m%d%H%M%S'), try_strptime(raw[1:8], '%Y%m%d')) ELSE try_strptime(raw[1:8], '%Y%m%d') END AS parsed FROM x""",
    ),
    "duration_format": (
        duration_format,
        "WITH s AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN (event_id * 37 % 9000)::DOUBLE / 2 - 5 END AS seconds FROM events), r AS (SELECT *, CASE WHEN seconds IS NOT NULL THEN round_even(greatest(0, seconds), 0)::BIGINT END AS n FROM s) SELECT event_id, seconds, CASE WHEN n IS NULL THEN '—' WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE (n // 3600) || 'h ' || (n % 3600 // 60) || 'm ' || (n % 60) || 's' END AS text FROM r",
    ),
    "time_texts": (
        time_texts,
        "WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 19 <> 0 THEN ts END AS t, CASE WHEN event_id % 19 <> 0 THEN event_id % 7000 END AS m, TIMESTAMP '2024-02-01' AS now FROM events), a AS (SELECT *, CASE WHEN t IS NOT NULL THEN greatest(0, (epoch_us(now) - epoch_us(t)) // 1000000) END AS n FROM e) SELECT event_id, coalesce(strftime(t, '%Y-%m-%d %H:%M:%S UTC'), '—') AS instant, "
        + AGE.format("n") + " AS age, " + AGE.format("m") + " AS near_age, greatest(0.0::DOUBLE, (epoch_us(now) - epoch_us(ts))::DOUBLE / 1000000) AS seconds FROM a",
    ),
    "backoff_table": (backoff_table, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN least(30.0::DOUBLE, event_id % 50) ELSE least(30.0::DOUBLE, pow(2.0::DOUBLE, event_id % 8)) END AS wait FROM events"),
    "token_jaccard_pairs": (
        token_jaccard_pairs,
        """WITH w AS (SELECT doc_id, source, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 3))) AS w FROM documents), k AS (SELECT source, w, min(doc_id) AS doc_id FROM w WHERE len(w) >= 3 GROUP BY source, w),
t AS (SELECT source, doc_id, unnest(w) AS t FROM k), p AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS n FROM t a JOIN t b USING (source, t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
j AS (SELECT p.doc_id, p.other, round(n::DOUBLE / (len(x.w) + len(y.w) - n), 6) AS jaccard FROM p JOIN k x ON x.doc_id = p.doc_id JOIN k y ON y.doc_id = p.other) SELECT * FROM j WHERE jaccard >= 0.65""",
    ),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
