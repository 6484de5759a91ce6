"""Queries over references and scrubbed lines: customers' values are the targets of their nation's case, orders are its log."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import references
from attestor.operators import scrubbing
from attestor.sources.steps import spread

from .views import table


def _values(s, d):
    c = F.col("c_custkey").cast("string")
    made = (F.concat(F.lit("user_name"), c), F.concat(F.lit("first.last"), c, F.lit("@mail"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example")), F.concat(F.lit("Ann Lee "), c), F.concat(F.lit("https://host"), c, F.lit(".example/x")), F.concat(F.lit("u"), (F.col("c_custkey") % 1000).cast("string")))
    each = spread(table(s, d, "customer").select("c_nationkey", "c_custkey"), "c_custkey").select(F.col("c_nationkey").alias("case"), "c_custkey", F.posexplode(F.array(*made)).alias("j", "value"))
    return each.select("case", "value", (F.col("c_custkey") * 10 + F.col("j")).alias("ord"))


def _salts(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("case"), F.sha2(F.concat(F.lit("salt"), F.col("n_nationkey").cast("string")), 256).alias("salt"))


def _lines(s, d):
    k, c = F.col("o_custkey"), F.col("o_custkey").cast("string")
    email = lambda a, b: F.concat(F.lit(a), c, F.lit("@mail"), (k % 7).cast("string"), F.lit(b))
    host = F.concat(F.lit("to host"), (k + 1).cast("string"), F.lit(".example: ReadTimeout"))
    said = lambda *parts: F.concat(*(c if p == "{c}" else F.lit(p) for p in parts))
    made = (
        said("got user_name", "{c}", " ok"),
        said("GET /s?q=%22user-name", "{c}", "%22 200"),
        said("user_name", "{c}", "x and xuser_name", "{c}", " and u1"),
        F.concat(F.lit("mail "), email("First.Last", ".EXAMPLE"), F.lit(" sent")),
        F.concat(F.lit("avatar/"), F.md5(email("first.last", ".example")), F.lit(".png")),
        F.concat(F.lit("MX of mail"), (k % 7).cast("string"), F.lit(".example")),
        said("q=Ann+Lee+", "{c}", "&x=ann%20lee%20", "{c}", ",AnnLee", "{c}", ",Ann_Lee", "{c}"),
        host,
    )
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.element_at(F.array(*made), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("text"))
    return o.join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("case")), "o_custkey").select("o_orderkey", "case", "text")


def log_scrub(s, d):
    return scrubbing.scrubbed(_lines(s, d), scrubbing.dictionary(_values(s, d), _salts(s, d), ("readtimeout",)))


def target_references(s, d):
    v = _values(s, d).join(_salts(s, d).select("case", references.pads(F.col("salt")).alias("pads")), "case")
    return v.select("case", "ord", references.reference_under(F.col("value"), F.col("pads")).alias("target"), references.host_reference_under(F.col("value"), F.col("pads")).alias("host"))


def value_forms(s, d):
    return _values(s, d).select("case", "ord", F.array_join(references.forms(F.col("value")), "\n").alias("forms"))


def _hmac(salt: str, text: str) -> str:
    pad = lambda n: f"unhex(array_to_string(list_transform(range(64), lambda i: printf('%02x', xor(CASE WHEN i < 32 THEN ('0x' || substr({salt}, 2 * i + 1, 2))::INT ELSE 0 END, {n}))), ''))"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({text}))))[:8]"


_V = """v AS (SELECT c_nationkey AS n, c_custkey AS c, unnest(['user_name' || c_custkey, 'first.last' || c_custkey || '@mail' || c_custkey % 7 || '.example', 'Ann Lee ' || c_custkey, 'https://host' || c_custkey || '.example/x', 'u' || c_custkey % 1000]) AS value, unnest(range(5)) AS j FROM customer),
w AS (SELECT *, sha256('salt' || n) AS salt FROM v)"""
REFERENCES = f"""WITH {_V} SELECT n AS "case", c * 10 + j AS ord, 't:' || {_hmac("salt", "lower(value)")} AS target, 'h:' || {_hmac("salt", "CASE j WHEN 1 THEN 'mail' || c % 7 || '.example' WHEN 3 THEN 'host' || c || '.example' ELSE lower(value) END")} AS host FROM w"""
#: What a line becomes follows from its template: one value's reference stands in it once, or three times, or it stays.
SCRUB = f"""WITH {_V}, r AS (SELECT n, c, j, 't:' || {_hmac("salt", "lower(value)")} AS ref FROM w),
m AS (SELECT n, c % 7 AS m, arg_min(ref, c) AS ref FROM r WHERE j = 1 GROUP BY ALL),
o AS (SELECT o_orderkey, o_custkey AS c, c_nationkey AS n, o_orderkey % 8 AS t FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, o.n AS "case", t NOT IN (2, 7) OR (t = 7 AND h.ref IS NOT NULL) AS replaced, CASE t WHEN 0 THEN 'got ' || u.ref || ' ok' WHEN 1 THEN 'GET /s?q=%22' || u.ref || '%22 200' WHEN 2 THEN 'user_name' || o.c || 'x and xuser_name' || o.c || ' and u1' WHEN 3 THEN 'mail ' || e.ref || ' sent' WHEN 4 THEN 'avatar/' || e.ref || '.png'
  WHEN 5 THEN 'MX of ' || m.ref WHEN 6 THEN 'q=' || a.ref || '&x=' || a.ref || ',' || a.ref || ',Ann_Lee' || o.c ELSE 'to ' || coalesce(h.ref, 'host' || o.c + 1 || '.example') || ': ReadTimeout' END AS text
FROM o JOIN r u ON u.n = o.n AND u.c = o.c AND u.j = 0 JOIN r e ON e.n = o.n AND e.c = o.c AND e.j = 1 JOIN r a ON a.n = o.n AND a.c = o.c AND a.j = 2 JOIN m ON m.n = o.n AND m.m = o.c % 7 LEFT JOIN r h ON h.n = o.n AND h.c = o.c + 1 AND h.j = 3"""
FORMS = f"""WITH {_V} SELECT n AS "case", c * 10 + j AS ord, array_to_string(CASE j WHEN 0 THEN [value, replace(value, '_', '-')] WHEN 1 THEN [value, replace(value, '@', '%40'), replace(value, '.', '-'), md5(value), sha256(value), 'first.last' || c, 'mail' || c % 7 || '.example']
  WHEN 2 THEN [value, replace(value, ' ', '%20'), replace(value, ' ', '+'), replace(value, ' ', ''), replace(value, ' ', '-'), replace(value, ' ', '_')] WHEN 3 THEN [value, 'https%3A%2F%2Fhost' || c || '.example%2Fx', 'https%3A//host' || c || '.example/x', replace(value, '.', '-'), 'host' || c || '.example'] ELSE []::VARCHAR[] END, chr(10)) AS forms FROM v"""

_ALL = {"target_references": (target_references, REFERENCES), "value_forms": (value_forms, FORMS), "log_scrub": (log_scrub, SCRUB)}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
