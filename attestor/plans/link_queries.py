"""Queries over records, edges and repeated observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import graph, identity, merging

from . import views
from .views import table

R, E, V = f"WITH {views.RECORDS}", f"WITH RECURSIVE {views.EDGES}", f"WITH {views.FINDINGS}"
C = identity.CONFLICTS

_SAME = {"same_username": "x.username = y.username"} | {f"same_{n}": f"x.{c} = y.{c}" for c, n in identity.FIELDS.items()}
W = {n: identity.WEIGHTS[n] for n in _SAME}
_APART = {f"distinct_{n}": (f"x.{c} <> y.{c} AND NOT contains(x.{c}, y.{c}) AND NOT contains(y.{c}, x.{c}) AND len(string_split(x.{c}, ' ')) >= 2 AND len(string_split(y.{c}, ' ')) >= 2" if c == "display_name" else f"x.{c} <> y.{c}") for c, n in identity.FIELDS.items()}
PAIRS = f"""v_flags AS (SELECT x.case_id, x.ord AS xo, y.ord AS yo, (x.platform, x.username) > (y.platform, y.username) AS swap, {', '.join(f'coalesce({c}, false) AS {n}' for n, c in (_SAME | _APART).items())}
  FROM v_records x JOIN v_records y ON x.case_id = y.case_id AND x.ord < y.ord),
v_total AS (SELECT *, {' + '.join(f'CASE WHEN {n} THEN {w} ELSE 0 END' for n, w in (W | C).items())} AS total, distinct_public_id OR distinct_public_email OR (distinct_personal_domain AND distinct_display_name) AS strong_conflict FROM v_flags),
v_scored AS (SELECT *, CASE WHEN strong_conflict THEN least(24, greatest(0, least(100, total))) ELSE greatest(0, least(100, total)) END::BIGINT AS score FROM v_total),
v_pairs AS (SELECT case_id, CASE WHEN swap THEN yo ELSE xo END AS left_ord, CASE WHEN swap THEN xo ELSE yo END AS right_ord, score,
  CASE WHEN score >= 80 THEN 'STRONG' WHEN score >= 60 THEN 'LIKELY' WHEN score >= 30 THEN 'POSSIBLE' ELSE 'LOW' END AS band,
  array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in W)}], lambda q: q IS NOT NULL)), ',') AS evidence,
  array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in C)}], lambda q: q IS NOT NULL)), ',') AS conflicts, strong_conflict FROM v_scored)"""

GRAPH = """v_graph AS (SELECT src, dst, max_by(src_type, ord) AS src_type, max_by(dst_type, ord) AS dst_type, max_by(relation, ord) AS relation, max_by(source, ord) AS source, max_by(confidence, ord) AS confidence,
  max_by(evidence_id, ord) FILTER (evidence_id IS NOT NULL) AS evidence_id, count(*) AS observed, min(ord) AS first_ord FROM v_edges GROUP BY src, dst)"""
NODES = "v_nodes AS (SELECT id, min(type) AS type, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, src_type AS type, 1 AS o, 0 AS i FROM v_graph UNION ALL SELECT dst, dst_type, 0, 1 FROM v_graph) GROUP BY id)"


def _graph(s, d):
    return graph.build(views.edges(s, d))


def _observed(s, d):
    """Repeated sights of entities: a user's events, each with a confidence, a source and a tag."""
    f = views.findings(s, d)
    return f.select(F.col("user_id").alias("entity"), "ord", "ts", F.coalesce("confidence", F.lit("NONE")).alias("confidence"), F.col("module").alias("source"), F.col("event_type").alias("tag"))


OBSERVED = "v_seen AS (SELECT user_id AS entity, ord, ts, coalesce(confidence, 'NONE') AS confidence, module AS source, event_type AS tag FROM v_findings)"


SEEN_BEFORE = "2024-01-03 00:00:00"


def _halves(s, d):
    """What was seen before an instant, and what since."""
    o = _observed(s, d)
    return o.where(F.col("ts") < SEEN_BEFORE), o.where(F.col("ts") >= SEEN_BEFORE)


def _mentions(s, d):
    c = table(s, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("role").alias("provider"), F.sha2(F.lower("text"), 256).alias("url"), (F.col("conv_id") % 5).alias("query"))


def _items(s, d):
    f = views.findings(s, d)
    return f.select("case_id", F.col("event_type").alias("field"), F.col("title").alias("value"), "ord", F.col("module").alias("source"), F.when(F.col("k") % 10 != 0, F.concat(F.lit("m"), (F.col("k") % 2).cast("string"))).alias("method"), "ts")


ITEMS = "v_items AS (SELECT case_id, event_type AS field, title AS value, ord, module AS source, CASE WHEN k % 10 <> 0 THEN 'm' || (k % 2) END AS method, ts FROM v_findings)"


def reach_seeds(s, d):
    return table(s, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("seed")).unionByName(table(s, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("seed")))


_ALL = {
    "identity_compare": (lambda s, d: identity.notable_pairs(views.records(s, d)), f"{R}, {PAIRS} SELECT * FROM v_pairs WHERE band <> 'LOW'"),
    "identity_bands": (
        lambda s, d: identity.band_counts(views.records(s, d)),
        f"{R}, {PAIRS} SELECT n.case_id, n.n * (n.n - 1) // 2 AS pairs, count(*) FILTER (band = 'STRONG') AS strong, count(*) FILTER (band = 'LIKELY') AS likely, count(*) FILTER (band = 'POSSIBLE') AS possible, count(*) FILTER (band = 'LOW') AS low, max(score) FILTER (band <> 'LOW') AS max_score FROM (SELECT case_id, count(*) AS n FROM v_records GROUP BY 1) n LEFT JOIN v_pairs p USING (case_id) GROUP BY n.case_id, n.n",
    ),
    "identity_links": (
        lambda s, d: identity.links(identity.notable_pairs(views.records(s, d))),
        f"{R}, {PAIRS} SELECT case_id, left_ord AS src, right_ord AS dst, 'IDENTITY_LINK' AS relation, CASE WHEN score >= 60 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, score, true AS not_civil_id FROM v_pairs WHERE score >= 30",
    ),
    "identity_clusters": (lambda s, d: identity.record_clusters(views.records(s, d)), None),
    "graph_build": (_graph, f"{E}, {GRAPH} SELECT * FROM v_graph"),
    "graph_nodes": (lambda s, d: graph.nodes(_graph(s, d)), f"{E}, {GRAPH}, {NODES} SELECT * FROM v_nodes"),
    "graph_cytoscape": (
        lambda s, d: graph.cytoscape(_graph(s, d)),
        f"""{E}, {GRAPH}, {NODES} SELECT 'node' AS kind, id, '{{"data":{{"id":"' || id || '","type":"' || type || '"}}}}' AS element FROM v_nodes
UNION ALL SELECT 'edge', src || '->' || dst || ':' || relation, '{{"data":{{"id":"' || src || '->' || dst || ':' || relation || '","source":"' || src || '","target":"' || dst || '","label":"' || relation || '"}}}}' FROM v_graph""",
    ),
    "graph_graphml": (
        lambda s, d: graph.graphml(_graph(s, d)).withColumn("part", F.col("part").cast("long")),
        f"""{E}, {GRAPH}, {NODES} SELECT 0::BIGINT AS part, '<node id="' || id || '"><data key="type">' || type || '</data></node>' AS line FROM v_nodes
UNION ALL SELECT 1, '<edge source="' || src || '" target="' || dst || '"><data key="relation">' || relation || '</data><data key="source">' || source || '</data><data key="confidence">' || confidence || '</data>' || coalesce('<data key="evidence_id">' || evidence_id || '</data>', '') || '</edge>' FROM v_graph""",
    ),
    "graph_reach_depth": (
        lambda s, d: graph.reach(_graph(s, d), reach_seeds(s, d)),
        f"""{E}, {GRAPH}, v_seeds AS (SELECT 'page:' || page_id AS seed FROM pages UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier),
r(seed, id, depth) AS (SELECT seed, seed, 0::BIGINT FROM v_seeds UNION SELECT r.seed, g.dst, r.depth + 1 FROM r JOIN v_graph g ON g.src = r.id WHERE r.depth < 3)
SELECT seed, id, min(depth) AS depth FROM r GROUP BY seed, id""",
    ),
    "pivot_suggest": (
        lambda s, d: graph.suggest_pivots(views.edges(s, d)).select("source", "action", "target", "confidence", F.col("place").cast("long").alias("place")),
        f"""{E}, a AS (SELECT *, CASE WHEN relation = 'RESOLVES_TO' AND dst_type = 'IP' THEN 'Investigate IP' WHEN relation = 'BELONGS_TO_ASN' THEN 'Investigate ASN' WHEN relation = 'HAS_SUBDOMAIN' THEN 'Investigate certificate SAN / subdomain' WHEN relation = 'HAS_PROFILE' THEN 'Review public profile' WHEN relation = 'HAS_MX' THEN 'Investigate mail provider domain' END AS action FROM v_edges),
f AS (SELECT source, action, dst AS target, min(ord) AS ord, min_by(confidence, ord) AS confidence FROM a WHERE action IS NOT NULL GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord, action, target) AS place FROM f) SELECT source, action, target, confidence, place FROM p WHERE place <= 12""",
    ),
    "entity_merge": (
        lambda s, d: merging.merge_entities(_observed(s, d)),
        f"{V}, {OBSERVED} SELECT entity, min_by(confidence, ord) AS confidence, min_by(source, ord) AS source, min(ts) AS first_seen, max(ts) AS last_seen, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, count(*) AS seen FROM v_seen GROUP BY entity",
    ),
    "entity_upsert": (
        lambda s, d: merging.upsert_entities(*_halves(s, d)),
        f"{V}, {OBSERVED}, b AS (SELECT *, (ts >= '{SEEN_BEFORE}')::INT AS new, (ts >= '{SEEN_BEFORE}')::BIGINT * 1000000000000 + ord AS o FROM v_seen) SELECT entity, max_by(confidence, o) AS confidence, min_by(source, o) AS source, min(ts) AS first_seen, max(ts) AS last_seen, min(new) = 1 AS inserted FROM b GROUP BY entity",
    ),
    "mention_dedupe_cap": (
        lambda s, d: merging.dedupe_mentions(_mentions(s, d), ["url", "query"]).withColumn("place", F.col("place").cast("long")),
        """WITH m AS (SELECT conv_id * 1000 + turn AS ord, role AS provider, sha256(lower(text)) AS url, conv_id % 5 AS query FROM conversations),
f AS (SELECT url, query, min(ord) AS ord, min_by(provider, ord) AS provider, array_to_string(list_sort(list(DISTINCT provider)), ',') AS sources, count(*) AS repeats FROM m GROUP BY url, query), p AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ord) AS place FROM f) SELECT * FROM p WHERE place <= 5""",
    ),
    "first_per_text": (
        lambda s, d: merging.first_of(table(s, d, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id", "source"), ["hash"], ["doc_id"]),
        "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY 1",
    ),
    "projection_shared": (
        lambda s, d: merging.project_items(_items(s, d), ["case_id", "field"]),
        f"""{V}, {ITEMS}, f AS (SELECT case_id, field, value, min(ord) AS first FROM v_items GROUP BY ALL), v AS (SELECT case_id, field, string_agg(value, ',' ORDER BY first) AS values FROM f GROUP BY ALL)
SELECT case_id, field, any_value(values) AS values, CASE WHEN count(DISTINCT source) = 1 THEN max(source) END AS source, CASE WHEN count(method) < count(*) THEN NULL WHEN count(DISTINCT method) > 1 THEN 'MIXED' ELSE max(method) END AS method, max(ts) AS observed_at, count(*) AS n FROM v_items JOIN v USING (case_id, field) GROUP BY case_id, field""",
    ),
    "geo_consensus": (
        lambda s, d: merging.consensus(table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.initcap(F.lower("c_mktsegment"))).alias("location"), "c_custkey"), ["nation"], "location", "c_custkey"),
        """WITH l AS (SELECT c_nationkey::BIGINT AS nation, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS location FROM customer),
c AS (SELECT nation, lower(location) AS v, count(*) AS n, min(c_custkey) AS first, min_by(location, c_custkey) AS spelling FROM l WHERE location IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, first) AS k FROM c) SELECT nation, spelling AS location, n FROM r WHERE k = 1 AND n >= 2""",
    ),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items() if sql}
