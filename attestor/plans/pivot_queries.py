"""Queries over follow-ups that lead to further ones."""

from __future__ import annotations

from pyspark.sql import functions as F


from attestor.operators import pivots


from .lead_queries import PLATFORMS, VHOST
from .views import table

NODES = 1_499
_KINDS = ("DOMAIN", "SUBDOMAIN", "IP", "URL")


def _node(k):
    """Customer number k as an entity: kind and value. One IP in three is private."""
    k = k.cast("long")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 4 + 1).cast("int"))
    ip = F.concat(F.when(k % 12 == 2, "10.0.").otherwise("8.8."), F.floor(k / 256).cast("string"), F.lit("."), (k % 256).cast("string"))
    return kind, F.when(k % 4 == 2, ip).otherwise(F.concat(F.lit("n"), k.cast("string"), F.lit(".example")))


def _edges(s, d):
    """An order leads from its customer to another node, which may be one that was there before; the same day is a tie."""
    o = table(s, d, "orders")
    sure = F.when(F.left("o_orderpriority", F.lit(1)) == "1", "CONFIRMED").when(F.left("o_orderpriority", F.lit(1)).isin("2", "3"), "HIGH").otherwise("MEDIUM")
    kind, value = _node(1 + (F.col("o_orderkey") * 31) % NODES)
    on_kind, on = _node(F.col("o_custkey"))
    return o.select("o_custkey", on_kind.alias("on_kind"), on.alias("on"), F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long").alias("ord"), kind.alias("kind"), value.alias("value"), sure.alias("confidence"))


def _auto(s, d):
    """A case for each customer, whose orders are what was found first; one customer in six has no answers."""
    e = _edges(s, d)
    cases = table(s, d, "customer").select(F.col("c_custkey").alias("case"), _node(F.col("c_custkey"))[1].alias("target"))
    return pivots.auto_pivots(cases, e.withColumnRenamed("o_custkey", "case"), e.where("o_custkey % 6 <> 0"))


def auto_pivots(s, d):
    return _auto(s, d)[0].withColumnRenamed("case", "case_id")


def auto_pivot_entities(s, d):
    """What each case knows in the end, by the step in which it came."""
    return _auto(s, d)[1].groupBy(F.col("case").alias("case_id"), "step").agg(F.count("*").alias("entities"), F.count_if(F.col("confidence").isin(*pivots.SURE)).alias("sure"), F.min("value").alias("least"))


def _node_sql(k: str) -> str:
    return f"['DOMAIN', 'SUBDOMAIN', 'IP', 'URL'][{k} % 4 + 1] AS kind, CASE WHEN {k} % 4 = 2 THEN CASE WHEN {k} % 12 = 2 THEN '10.0.' ELSE '8.8.' END || {k} // 256 || '.' || {k} % 256 ELSE 'n' || {k} || '.example' END"


#: A step of a case is a row that carries all the case knows; levels are lists of what is left to follow.
AUTO = f"""RECURSIVE p_edge AS (SELECT o_custkey AS c, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS ord, 1 + (o_orderkey * 31) % {NODES} AS k, CASE o_orderpriority[1] WHEN '1' THEN 'CONFIRMED' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM orders),
p_node AS (SELECT *, {_node_sql("k")} AS value FROM p_edge), p_first AS (SELECT c, k, kind, value, min(ord) AS ord, min_by(confidence, (ord, confidence)) AS confidence FROM p_node GROUP BY ALL),
p_able AS (SELECT DISTINCT c FROM p_edge WHERE c % 6 <> 0),
p_answer AS (SELECT f.c, list({{k: k, ok: kind <> 'URL' AND confidence IN ('CONFIRMED', 'HIGH') AND k % 12 <> 2 AND EXISTS (SELECT 1 FROM p_able a WHERE a.c = k), sure: confidence IN ('CONFIRMED', 'HIGH')}} ORDER BY ord, kind, value) AS es FROM p_first f GROUP BY f.c),
p_begin AS (SELECT c_custkey AS c, coalesce(es, []) AS es FROM customer LEFT JOIN p_answer ON p_answer.c = c_custkey),
p_start AS (SELECT c, list_transform(es, lambda e: e.k) AS known, list_transform(list_filter(es, lambda e: e.ok), lambda e: e.k) AS able, [c] AS visited, es FROM p_begin),
p_walk AS (SELECT c, 0 AS step, 8 AS budget, known, able, visited, [{{d: 3, path: '', q: list_filter(able, lambda x: NOT list_contains(visited, x))[:2]}}] AS levels, 0 AS d, '' AS path, 0::BIGINT AS k, es AS fresh FROM p_start
  UNION ALL SELECT c, step, budget, known || list_transform(fresh, lambda e: e.k), now_able, now_visited,
    under || CASE WHEN d > 1 THEN [{{d: d - 1, path: path, q: list_filter(now_able, lambda x: NOT list_contains(now_visited, x))[:least(budget, CASE d WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 2 END)]}}] ELSE [] END, d, path, k, fresh
  FROM (SELECT *, able || list_transform(list_filter(fresh, lambda e: e.ok), lambda e: e.k) AS now_able, list_distinct(visited || [k]) AS now_visited FROM
   (SELECT w.c, w.step + 1 AS step, w.budget - 1 AS budget, w.known, w.able, w.visited, w.live[:len(w.live) - 1] || [{{d: w.top.d, path: w.top.path, q: w.top.q[2:]}}] AS under, w.top.d AS d, CASE w.top.path WHEN '' THEN '' ELSE w.top.path || '.' END || (w.step + 1) AS path, w.top.q[1] AS k,
      list_filter(a.es, lambda e: NOT list_contains(w.known, e.k)) AS fresh
    FROM (SELECT *, list_filter(levels, lambda l: len(l.q) > 0) AS live, list_filter(levels, lambda l: len(l.q) > 0)[-1] AS top FROM p_walk WHERE budget > 0 AND len(list_filter(levels, lambda l: len(l.q) > 0)) > 0) w JOIN p_answer a ON a.c = w.top.q[1])))"""



def _indicators(s, d):
    """Indicators of a case by nation, from customers and their orders; some keys come twice, some hosts are platforms."""
    c = table(s, d, "customer")
    n = F.col("c_custkey")
    case = F.col("c_nationkey").cast("long").alias("case")
    handle = c.select(case, F.lit("username").alias("kind"), F.concat(F.lit("@User"), (n % 40).cast("string")).alias("value"), F.when(n % 2 == 0, "bio_handle").otherwise("seen").alias("rule"), F.lit("customer").alias("source"), n.alias("ord"))
    host = F.when(n % 9 == 0, "github.com").otherwise(F.concat(F.lit("d"), (n % 30).cast("string"), F.lit(".example")))
    site = c.select(case, F.when(n % 2 == 0, "domain").otherwise("url").alias("kind"), F.when(n % 2 == 0, host).otherwise(F.concat(F.lit("https://www."), host, F.lit("/p/"), n.cast("string"))).alias("value"), F.lit("external_links").alias("rule"), F.lit("customer").alias("source"), (n + 1_000_000_000).alias("ord"))
    return handle.unionByName(site)


def _landed(s, d):
    """What searches returned: a handle leads to addresses, a host to handles, an address to hosts; from all orders."""
    o = table(s, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    on_kind = F.when(k % 3 == 0, "username").when(k % 3 == 1, "domain").otherwise("email")
    on = F.when(k % 3 == 0, F.concat(F.lit("user"), (c % 40).cast("string"))).when(k % 3 == 1, F.concat(F.lit("d"), (c % 30).cast("string"), F.lit(".example"))).otherwise(F.concat(F.lit("e"), (c % 90).cast("string"), F.lit("@x.example")))
    kind = F.when(k % 3 == 0, "email").when(k % 3 == 1, "username").otherwise("domain")
    value = F.when(k % 3 == 0, F.concat(F.lit("E"), (k % 90).cast("string"), F.lit("@x.example"))).when(k % 3 == 1, F.concat(F.lit("user"), (k % 60).cast("string"))).otherwise(F.concat(F.lit("d"), (k % 50).cast("string"), F.lit(".example")))
    return o.select(on_kind.alias("on_kind"), on.alias("on"), kind.alias("kind"), value.alias("value"), F.lit("search_result").alias("rule"), F.lit("search").alias("source"), k.alias("ord"))


def search_loop(s, d):
    """Two depths of searches for each nation, with an operator's handle and a known page each."""
    nation = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("case"), F.col("n_nationkey").alias("n"))
    leads = nation.select("case", F.lit("username").alias("kind"), F.concat(F.lit("user"), F.col("n").cast("string")).alias("norm"))
    known = table(s, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_nationkey").cast("long").alias("case"), F.concat(F.lit("https://www.d"), (F.col("c_custkey") % 30).cast("string"), F.lit(".example/p/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("url"))
    out = pivots.search_loop(_indicators(s, d), leads, known, _landed(s, d), budget=9)
    return out.select(F.col("case").alias("case_id"), "depth", "kind", "norm", "round", "ord", "action", "accepted", "reason")


def _judged(name: str, source: str) -> str:
    """SQL for novelty, priority and grouping of indicators by case."""
    return f"""{name}_h AS (SELECT *, {VHOST} AS vhost FROM {source}), {name}_n AS (SELECT *, CASE WHEN kind IN ('url', 'domain') THEN vhost WHEN kind = 'username' THEN lower(regexp_replace(trim(value), '^@+', '')) ELSE lower(trim(value)) END AS norm, CASE WHEN kind IN ('url', 'domain') THEN vhost ELSE '' END AS host FROM {name}_h),
{name}_c AS (SELECT *, CASE WHEN kind = 'username' AND norm = 'user' || c THEN 'OPERATOR_INPUT' WHEN kind = 'url' AND (c, lower(regexp_replace(value, '/+$', ''))) IN (SELECT c, u FROM s_known) THEN 'KNOWN' WHEN kind IN ('url', 'domain') AND list_contains({PLATFORMS}, host) THEN 'REDUNDANT'
  WHEN rule IN ('bio_handle', 'external_links') THEN 'DERIVED' ELSE 'NOVEL' END AS novelty FROM {name}_n),
{name}_g AS (SELECT c, kind, norm, max_by(novelty, CASE novelty WHEN 'NOVEL' THEN 5 WHEN 'DERIVED' THEN 4 WHEN 'KNOWN' THEN 2 WHEN 'OPERATOR_INPUT' THEN 1 ELSE 0 END) AS novelty, min(r * 100000000000 + ord) AS place, min_by(host, r * 100000000000 + ord) AS host FROM {name}_c GROUP BY c, kind, norm),
{name}_p AS (SELECT *, CASE WHEN novelty IN ('REDUNDANT', 'OPERATOR_INPUT', 'KNOWN') THEN 0 WHEN kind IN ('email', 'username') THEN 100 WHEN NOT list_contains({PLATFORMS}, host) THEN 100 WHEN kind = 'url' THEN 50 ELSE 10 END AS priority FROM {name}_g),
{name}_u AS (SELECT *, novelty IN ('NOVEL', 'DERIVED') AND priority > 0 AS useful FROM {name}_p)"""


SEARCH = f"""WITH s_known AS (SELECT c_nationkey AS c, 'https://www.d' || c_custkey % 30 || '.example/p/' || c_custkey AS u FROM customer WHERE c_custkey % 5 = 0),
s_host AS (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN 'github.com' ELSE 'd' || c_custkey % 30 || '.example' END AS site FROM customer),
s_one AS (SELECT c_nationkey::BIGINT AS c, 'username' AS kind, '@User' || c_custkey % 40 AS value, CASE WHEN c_custkey % 2 = 0 THEN 'bio_handle' ELSE 'seen' END AS rule, 0 AS r, c_custkey AS ord FROM customer
  UNION ALL SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'domain' ELSE 'url' END, CASE WHEN c_custkey % 2 = 0 THEN site ELSE 'https://www.' || site || '/p/' || c_custkey END, 'external_links', 0, c_custkey + 1000000000 FROM s_host),
{_judged("a", "s_one")},
a_k AS (SELECT *, sum(useful::INT) OVER (PARTITION BY c ORDER BY priority DESC, kind, place ROWS UNBOUNDED PRECEDING) AS k FROM a_u),
a_r AS (SELECT *, CASE WHEN NOT useful THEN CASE novelty WHEN 'REDUNDANT' THEN 'redundant' ELSE 'not_novel' END WHEN k > 9 THEN 'budget' END AS reason FROM a_k),
s_asked AS (SELECT c, kind, norm FROM a_r WHERE reason IS NULL AND kind <> 'url' QUALIFY row_number() OVER (PARTITION BY c ORDER BY priority DESC, kind, place) <= 4),
s_landed AS (SELECT ['username', 'domain', 'email'][o_orderkey % 3 + 1] AS on_kind, CASE o_orderkey % 3 WHEN 0 THEN 'user' || o_custkey % 40 WHEN 1 THEN 'd' || o_custkey % 30 || '.example' ELSE 'e' || o_custkey % 90 || '@x.example' END AS norm,
  ['email', 'username', 'domain'][o_orderkey % 3 + 1] AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'E' || o_orderkey % 90 || '@x.example' WHEN 1 THEN 'user' || o_orderkey % 60 ELSE 'd' || o_orderkey % 50 || '.example' END AS value, o_orderkey AS ord FROM orders),
s_two AS (SELECT * FROM s_one UNION ALL SELECT a.c, l.kind, l.value, 'search_result', 1, l.ord FROM s_asked a JOIN s_landed l ON l.on_kind = a.kind AND l.norm = a.norm),
{_judged("b", "s_two")},
b_old AS (SELECT b.*, EXISTS (SELECT 1 FROM a_r WHERE a_r.c = b.c AND a_r.kind = b.kind AND a_r.norm = b.norm AND reason IS NULL) AS old, (SELECT count(*) FROM a_r WHERE a_r.c = b.c AND reason IS NULL) AS spent FROM b_u b),
b_k AS (SELECT *, sum((useful AND NOT old)::INT) OVER (PARTITION BY c ORDER BY priority DESC, kind, place ROWS UNBOUNDED PRECEDING) AS k FROM b_old),
b_r AS (SELECT *, CASE WHEN NOT useful THEN CASE novelty WHEN 'REDUNDANT' THEN 'redundant' ELSE 'not_novel' END WHEN old THEN 'duplicate' WHEN k > 9 - spent THEN 'budget' END AS reason FROM b_k),
s_all AS (SELECT c, 1 AS depth, kind, norm, place, reason FROM a_r UNION ALL SELECT c, 2, kind, norm, place, reason FROM b_r)
SELECT c AS case_id, depth, kind, norm, place // 100000000000 AS round, place % 100000000000 AS ord, CASE kind WHEN 'username' THEN 'search username' WHEN 'domain' THEN 'inspect domain' WHEN 'email' THEN 'search exact email' ELSE 'inspect public URL' END AS action, reason IS NULL AS accepted, reason FROM s_all"""

_ALL = {
    "auto_pivots": (auto_pivots, f"WITH {AUTO} SELECT c AS case_id, step, d AS depth, path, kind, value AS target, new, budget AS \"left\" FROM (SELECT *, len(fresh) AS new, {_node_sql('k')} AS value FROM p_walk WHERE step > 0)"),
    "auto_pivot_entities": (
        auto_pivot_entities,
        f"WITH {AUTO}, p_came AS (SELECT c, step, unnest(fresh) AS e FROM p_walk) SELECT c AS case_id, step, count(*) AS entities, count(*) FILTER (sure) AS sure, min(value) AS least FROM (SELECT c, step, e.sure AS sure, e.k AS k, {_node_sql('e.k')} AS value FROM p_came) GROUP BY ALL",
    ),
    "search_loop": (search_loop, SEARCH),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items() if sql}
