"""Queries over landed pages and JSON answers of sites. The SQL holds what each made page must come to, by the rules and not by running them."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import ids, text
from attestor.operators import checks, observed
from attestor.sources.steps import spread

from .views import table

_NONE: list[str] = []
#: Sites: name, check_method, requires_auth, expected and not-found codes, patterns (captcha, challenge, blocked, login, not found, soft 404, markers), redirect policies, confidence strategy.
SITES = [
    ("Plain", "generic_html", False, [200], [404, 410], ["captcha"], ["just a moment"], ["access denied"], ["log in to continue"], ["user not found"], ["nothing here"], ["profile-card"], "not_found", "not_found", "multi_signal"),
    ("Odd", "generic_html", False, [200, 202], [410], _NONE, _NONE, _NONE, _NONE, _NONE, _NONE, _NONE, None, None, "never_confirmed"),
    ("Wall", "login_wall", True, [200], [404], _NONE, _NONE, _NONE, ["sign in"], ["no such user"], _NONE, _NONE, None, None, "never_confirmed"),
    *((n, "generic_html", False, [200], [404], _NONE, _NONE, _NONE, _NONE, _NONE, _NONE, ["tgme_page_photo"] if n == "Telegram" else ["marker"], None, None, "multi_signal") for n in ("PyPI", "Replit", "Pinterest", "Steam", "Last.fm", "Telegram")),
]
TITLE, CANONICAL, OG = "<title>{h} here</title>", '<link rel="canonical" href="https://s.example/{h}">', '<meta content="https://s.example/@{h}/" property="og:url">'
OG_TITLE = '<meta property="og:title" content="About @{h}">'
PERSON = '<script type="application/ld+json">[{"@type": "Person", "name": "{h}"}]</script>'
#: Made pages: site, status, end of the final URL, page; then status, reason, confidence and identity that they must come to.
CASES = [
    ("Plain", 429, "/{h}", "", "RATE_LIMITED", "HTTP 429", None, ""),
    ("Plain", 200, "/{h}", TITLE + "Captcha", "CAPTCHA_REQUIRED", "captcha presented — not solved", None, "title_match"),
    ("Plain", 503, "/{h}", "Just a moment", "CHALLENGE_REQUIRED", "challenge presented — not bypassed", None, ""),
    ("Plain", 403, "/{h}", "Log in to continue", "LOGIN_REQUIRED", "HTTP 403 login/wall", None, ""),
    ("Plain", 200, "/{h}", "Access denied", "BLOCKED", "HTTP 200 blocked", None, ""),
    ("Plain", 401, "/{h}", "", "BLOCKED", "HTTP 401 blocked", None, ""),
    ("Wall", 403, "/{h}", "", "LOGIN_REQUIRED", "HTTP 403 login/wall", None, ""),
    ("Plain", 408, "/{h}", "", "PROVIDER_UNAVAILABLE", "HTTP 408", None, ""),
    ("Plain", 500, "/{h}", TITLE, "PROVIDER_UNAVAILABLE", "HTTP 500", None, "title_match"),
    ("Plain", 410, "/{h}", TITLE, "NOT_FOUND", "HTTP 410", None, "title_match"),
    ("Odd", 404, "/{h}", "", "INCONCLUSIVE", "Unexpected HTTP 404 for HTML check", "LOW", ""),
    ("Wall", 200, "/{h}", "No such user", "NOT_FOUND", "not_found_pattern", None, ""),
    ("Wall", 200, "/{h}", TITLE, "LOGIN_REQUIRED", "login wall / no public profile API", None, "title_match"),
    ("Plain", 200, "/{h}", TITLE + "Log in to continue", "LOGIN_REQUIRED", "login_pattern", None, "title_match"),
    ("Plain", 200, "/{h}", TITLE + "User not found", "NOT_FOUND", "soft-404 / not_found_pattern", None, "title_match"),
    ("Plain", 302, "/{h}", "", "INCONCLUSIVE", "Unexpected HTTP 302 for HTML check", "LOW", ""),
    ("Plain", 200, "/{h}", TITLE + "nothing here", "NOT_FOUND", "soft_404_marker", None, "title_match"),
    ("Plain", 200, "/accounts/login?next={h}", "", "LOGIN_REQUIRED", "redirect_login", None, ""),
    ("Plain", 200, "/", "<title>Welcome</title>", "NOT_FOUND", "redirect_home", None, ""),
    ("Plain", 200, "/explore", "<title>Welcome</title>", "NOT_FOUND", "redirect_search", None, ""),
    ("Odd", 200, "/", "<title>Welcome</title>", "INCONCLUSIVE", "HTTP 200 is not proof (redirect_home)", "LOW", ""),
    ("Plain", 200, "/{h}", TITLE + CANONICAL, "LIKELY", "title + canonical/og:url: canonical_match,title_match", "HIGH", "canonical_match,title_match"),
    ("Odd", 202, "/{h}", TITLE + OG, "LIKELY", "title + canonical/og:url: og_url_match,title_match (never_confirmed)", "HIGH", "og_url_match,title_match"),
    ("Plain", 200, "/{h}", OG_TITLE, "LIKELY", "username in title/og:title", "MEDIUM", "og_title_match"),
    ("Plain", 200, "/{h}", CANONICAL + "<title>Some one</title><div class='profile-card'>", "LIKELY", "canonical/og:url + profile marker", "MEDIUM", "canonical_match"),
    ("Plain", 200, "/{h}", CANONICAL + OG + "<title>Some one</title>", "LIKELY", "two identity signals: canonical_match,og_url_match", "MEDIUM", "canonical_match,og_url_match"),
    ("Plain", 200, "/{h}", CANONICAL + PERSON + "<title>Some one</title>", "LIKELY", "two identity signals: canonical_match,jsonld_person", "MEDIUM", "canonical_match,jsonld_person"),
    ("Plain", 200, "/{h}", CANONICAL + OG + "<title>GitHub</title>", "INCONCLUSIVE", "HTTP 200 is not proof (canonical_match,og_url_match,generic_platform_title)", "LOW", "canonical_match,og_url_match"),
    ("Plain", 200, "/{h}", "<title>Some one</title>", "INCONCLUSIVE", "HTTP 200 is not proof (final_url_only)", "LOW", ""),
    ("Plain", 200, "/{h}", "<title>x{h}x and pre-{h}</title>", "INCONCLUSIVE", "HTTP 200 is not proof (final_url_only)", "LOW", ""),
    ("PyPI", 200, "/", CANONICAL + TITLE, "NOT_FOUND", "pypi redirected to homepage", None, "canonical_match,title_match"),
    ("PyPI", 200, "/{h}", CANONICAL + TITLE, "LIKELY", "pypi profile canonical + title", "HIGH", "canonical_match,title_match"),
    ("PyPI", 200, "/{h}", OG + TITLE, "LIKELY", "title + canonical/og:url: og_url_match,title_match", "HIGH", "og_url_match,title_match"),
    ("Replit", 200, "/search?q=1", TITLE, "NOT_FOUND", "replit redirect_search", None, "title_match"),
    ("Replit", 200, "/{h}", CANONICAL + "<title>Replit</title>", "INCONCLUSIVE", "replit generic shell", "LOW", "canonical_match"),
    ("Replit", 200, "/{h}", CANONICAL + OG_TITLE, "LIKELY", "replit canonical/og:url + title", "HIGH", "canonical_match,og_title_match"),
    ("Pinterest", 200, "/", TITLE, "NOT_FOUND", "pinterest redirect_home", None, "title_match"),
    ("Pinterest", 200, "/{h}", OG + TITLE, "LIKELY", "pinterest profile url + title", "HIGH", "og_url_match,title_match"),
    ("Steam", 200, "/profiles/765", "", "LIKELY", "steam custom url resolved to /profiles/", "HIGH", ""),
    ("Steam", 200, "/", "", "NOT_FOUND", "steam redirected to homepage", None, ""),
    ("Steam", 200, "/{h}", OG + "<b>marker</b>", "LIKELY", "steam profile url + title/marker", "HIGH", "og_url_match"),
    ("Last.fm", 200, "/", "", "NOT_FOUND", "last.fm redirected to homepage", None, ""),
    ("Last.fm", 200, "/{h}", CANONICAL + TITLE, "LIKELY", "last.fm /user canonical + title", "HIGH", "canonical_match,title_match"),
    ("Telegram", 200, "/{h}", TITLE, "INCONCLUSIVE", "telegram contact shell without profile photo", "LOW", "title_match"),
    ("Telegram", 200, "/{h}", TITLE + "<img class='tgme_page_photo'>", "LIKELY", "telegram tgme_page_photo + username title", "MEDIUM", "title_match"),
    ("Telegram", 200, "/{h}", "<img class='tgme_page_photo'>", "INCONCLUSIVE", "telegram photo without username title", "LOW", ""),
]


def page_cascade(s, d):
    """Every made page for each landed page, under a handle of its own and followed by its source's title."""
    case = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.lit(c[0]).alias("site"), F.lit(c[1]).alias("status"), F.lit(c[2]).alias("end"), F.lit(c[3]).alias("html")) for k, c in enumerate(CASES))))
    p = spread(table(s, d, "pages").select("page_id")).select("page_id", F.concat(F.lit("bob"), F.col("page_id").cast("string")).alias("h"), case.alias("c")).select("page_id", "h", "c.*")
    with_h = lambda c: F.replace(F.col(c), F.lit("{h}"), F.col("h"))
    p = p.select("page_id", F.col("form").cast("long").alias("form"), "site", F.concat(F.lit("https://www.s.example/"), "h").alias("url"), F.concat(F.lit("https://s.example"), with_h("end")).alias("final_url"), "status", with_h("html").alias("html"), F.concat(F.lit("@"), F.upper("h")).alias("handle"))
    return checks.classify_pages(p, s.createDataFrame(SITES, checks.SITE)).select("page_id", "form", "identity", "check_status", "reason", "confidence")


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


CASCADE = f"SELECT page_id, form, identity, check_status, reason, confidence FROM pages, (VALUES {', '.join(f'({k}::BIGINT, {_quoted(c[7])}, {_quoted(c[4])}, {_quoted(c[5])}, {_quoted(c[6])})' for k, c in enumerate(CASES))}) v(form, identity, check_status, reason, confidence)"

#: Made JSON answers: status, path, body, what they must come to, and what is seen; {h} is the handle.
ANSWERS = [
    (200, "$.login", '{"login": "{h}"}', "CONFIRMED", "{h}"),
    (200, "$.user.login", '{"user": {"login": " {h} "}}', "CONFIRMED", "{h}"),
    (200, "$.them[0].id", '{"them": [{"id": "other"}]}', "LIKELY", "other"),
    (200, "$.them[0].id", '{"them": []}', "NOT_FOUND", None),
    (200, "$.login", '{"login": true}', "NOT_FOUND", None),
    (200, "$.login", '{"login": 12}', "LIKELY", "12"),
    (200, "$.login", '{"login": ""}', "NOT_FOUND", ""),
    (200, "$.login", "<html>", "INCONCLUSIVE", None),
    (404, "$.login", "{}", "NOT_FOUND", None),
    (429, "$.login", "{}", "RATE_LIMITED", None),
    (403, "$.login", "{}", "BLOCKED", None),
    (502, "$.login", "{}", "PROVIDER_UNAVAILABLE", None),
]


def json_cascade(s, d):
    case = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.lit(a[0]).alias("status"), F.lit(a[1]).alias("id_path"), F.lit(a[2]).alias("b")) for k, a in enumerate(ANSWERS))))
    p = spread(table(s, d, "customer").select("c_custkey")).select("c_custkey", F.concat(F.lit("User"), F.col("c_custkey").cast("string")).alias("handle"), case.alias("c")).select("c_custkey", "handle", "c.*")
    p = p.withColumn("body", F.replace("b", F.lit("{h}"), F.lower("handle")))
    return checks.classify_json(p).select("c_custkey", F.col("form").cast("long").alias("form"), "check_status", "observed")


JSON_CASCADE = f"SELECT c_custkey, form, check_status, replace(observed, '{{h}}', 'user' || c_custkey) AS observed FROM customer, (VALUES {', '.join(f'({k}::BIGINT, {_quoted(a[3])}, {_quoted(a[4])})' for k, a in enumerate(ANSWERS))}) v(form, check_status, observed)"

NAMES = ["Ann Lee", " {h} ", "GitHub", "GitHub | Docker", "Ann | GitHub", "{h}'s profile", "My user profile", "Online Training", "{H}", "", "github {h}", "Build  software faster", "homecoming", "home page"]
GENERIC = [False, True, True, True, False, True, True, True, True, True, True, True, False, True]


def generic_names(s, d):
    case = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), F.lit(n).alias("n")) for k, n in enumerate(NAMES))))
    p = spread(table(s, d, "customer").select("c_custkey")).select("c_custkey", F.concat(F.lit("bob"), F.col("c_custkey").cast("string")).alias("h"), case.alias("c")).select("c_custkey", "h", "c.*")
    name = F.replace(F.replace("n", F.lit("{h}"), F.col("h")), F.lit("{H}"), F.upper("h"))
    return p.select("c_custkey", F.col("form").cast("long").alias("form"), observed.generic_name(name, F.col("h"), F.lit("Docker")).alias("generic"))


def sensitive_keys(s, d):
    keys = [*text.SENSITIVE_KEYS, "X-ApiKey", "my_password_2", "author", "keyboard", "note", "CSRFish", "passport"]
    t = table(s, d, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    return t.select("r_regionkey", "key", text.sensitive_key(F.col("key")).alias("sensitive"))


def plain_names(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(ids.plain_name(F.col("text")), 256).alias("name"))


_ALL = {
    "page_cascade": (page_cascade, CASCADE),
    "json_cascade": (json_cascade, JSON_CASCADE),
    "generic_names": (generic_names, f"SELECT c_custkey, unnest(range(0, {len(GENERIC)})) AS form, unnest({[bool(g) for g in GENERIC]}) AS generic FROM customer"),
    "sensitive_keys": (
        sensitive_keys,
        f"SELECT r_regionkey, unnest([{', '.join(map(_quoted, [*text.SENSITIVE_KEYS, 'X-ApiKey', 'my_password_2', 'author', 'keyboard', 'note', 'CSRFish', 'passport']))}]) AS key, unnest([{', '.join(['true'] * len(text.SENSITIVE_KEYS))}, true, true, false, false, false, true, false]) AS sensitive FROM region",
    ),
    "plain_names": (plain_names, "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS name FROM documents"),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
