"""Adapter views: the engine's record kinds, derived from the tables at hand.

Each view is a DataFrame here and the same as a common table expression for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, cases: dict, default=None):
    out = None
    for k, v in cases.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(F.lit(default))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of investigations: one for each event; a case is a user's day."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    target = _case(F.col("user_id") % 3, {0: "USERNAME", 1: "DOMAIN"}, "IP")
    check = _case(F.col("event_type"), {"signup": "CONFIRMED", "purchase": "LIKELY", "view": "NOT_FOUND", "click": "INCONCLUSIVE"}, None)
    check = F.coalesce(check, F.when(F.col("k") < 50, "PROVIDER_UNAVAILABLE").otherwise("NOT_CONFIGURED"))
    status = F.when(F.col("check_status").isin("CONFIRMED", "LIKELY"), "FOUND").otherwise(F.col("check_status"))
    module = F.when(F.col("target_type") == "USERNAME", "username").when(F.col("target_type") == "DOMAIN", _case(F.col("event_id") % 4, {0: "dns", 1: "rdap", 2: "crtsh"}, "wayback")).otherwise("threat")
    confidence = F.when(F.col("event_type") == "signup", "CONFIRMED").when(F.col("event_type") == "purchase", F.when(F.col("target_type") == "DOMAIN", "HIGH").otherwise("MEDIUM")).when(F.col("event_type") == "click", "LOW")
    title = F.when((F.col("target_type") == "USERNAME") & (F.col("event_id") % 11 == 0), "Username sweep").otherwise(F.concat(F.lit("site"), (F.col("event_id") % 17).cast("string")))
    e = e.withColumn("target_type", target).withColumn("check_status", check)
    return e.select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("case_id"),
        F.col("event_id").alias("ord"),
        "ts",
        "user_id",
        "event_type",
        "k",
        "target_type",
        module.alias("module"),
        title.alias("title"),
        "check_status",
        status.alias("status"),
        confidence.alias("confidence"),
        F.when(F.col("event_type") == "error", F.col("k") % 7).alias("detections"),
        F.when(F.col("event_type") == "click", F.col("k") % 4).otherwise(0).alias("n_flags"),
        F.when((F.col("event_type") == "view") & (F.col("k") % 2 == 0), F.col("value")).alias("abuse"),
        (F.col("event_id") % 2 == 0).alias("has_evidence"),
    )


FINDINGS = """v_events AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '"k"\\s*:\\s*([0-9]+)', 1) AS BIGINT) AS k,
  CASE user_id % 3 WHEN 0 THEN 'USERNAME' WHEN 1 THEN 'DOMAIN' ELSE 'IP' END AS target_type FROM events),
v_checked AS (SELECT *, CASE event_type WHEN 'signup' THEN 'CONFIRMED' WHEN 'purchase' THEN 'LIKELY' WHEN 'view' THEN 'NOT_FOUND' WHEN 'click' THEN 'INCONCLUSIVE'
  ELSE CASE WHEN k < 50 THEN 'PROVIDER_UNAVAILABLE' ELSE 'NOT_CONFIGURED' END END AS check_status FROM v_events),
v_findings AS (SELECT user_id * 100 + day(ts) AS case_id, event_id AS ord, ts, user_id, event_type, k, target_type,
  CASE target_type WHEN 'USERNAME' THEN 'username' WHEN 'DOMAIN' THEN CASE event_id % 4 WHEN 0 THEN 'dns' WHEN 1 THEN 'rdap' WHEN 2 THEN 'crtsh' ELSE 'wayback' END ELSE 'threat' END AS module,
  CASE WHEN target_type = 'USERNAME' AND event_id % 11 = 0 THEN 'Username sweep' ELSE 'site' || (event_id % 17) END AS title,
  check_status, CASE WHEN check_status IN ('CONFIRMED', 'LIKELY') THEN 'FOUND' ELSE check_status END AS status,
  CASE event_type WHEN 'signup' THEN 'CONFIRMED' WHEN 'purchase' THEN CASE WHEN target_type = 'DOMAIN' THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'click' THEN 'LOW' END AS confidence,
  CASE WHEN event_type = 'error' THEN k % 7 END AS detections, CASE WHEN event_type = 'click' THEN k % 4 ELSE 0 END AS n_flags,
  CASE WHEN event_type = 'view' AND k % 2 = 0 THEN value END AS abuse, event_id % 2 = 0 AS has_evidence FROM v_checked)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile records to compare: customers and suppliers; a case is a nation."""
    parts = []
    for source, name in (("c", "customer"), ("s", "supplier")):
        parts.append(table(spark, sf_dir, name).select(F.lit(source).alias("source"), F.col(f"{source}_{'cust' if source == 'c' else 'supp'}key").alias("key"), F.col(f"{source}_nationkey").cast("long").alias("case_id")))
    r = parts[0].unionByName(parts[1])
    key = F.col("key")
    text = lambda prefix, expr, suffix="": F.concat(F.lit(prefix), expr.cast("string"), F.lit(suffix))
    return r.select(
        "case_id",
        (key * 2 + (F.col("source") == "s").cast("long")).alias("ord"),
        F.concat("source", F.lit("-"), key.cast("string")).alias("platform"),
        text("user", key % 11).alias("username"),
        text("name ", key % 5, " x").alias("display_name"),
        F.when(key % 4 != 0, text("org", key % 3)).alias("organization"),
        F.when(key % 3 == 0, text("loc", key % 2)).alias("location"),
        F.when(key % 5 < 2, text("d", key % 7, ".example")).alias("domain"),
        F.when(key % 7 == 1, text("id", key % 3)).alias("public_id"),
        F.when(key % 6 == 2, text("e", key % 4, "@x.example")).alias("email"),
    )


RECORDS = """v_base AS (SELECT 'c' AS source, c_custkey AS key, c_nationkey::BIGINT AS case_id FROM customer UNION ALL SELECT 's', s_suppkey, s_nationkey::BIGINT FROM supplier),
v_records AS (SELECT case_id, key * 2 + (source = 's')::BIGINT AS ord, source || '-' || key AS platform, 'user' || key % 11 AS username,
  'name ' || key % 5 || ' x' AS display_name, CASE WHEN key % 4 <> 0 THEN 'org' || key % 3 END AS organization, CASE WHEN key % 3 = 0 THEN 'loc' || key % 2 END AS location,
  CASE WHEN key % 5 < 2 THEN 'd' || key % 7 || '.example' END AS domain, CASE WHEN key % 7 = 1 THEN 'id' || key % 3 END AS public_id,
  CASE WHEN key % 6 = 2 THEN 'e' || key % 4 || '@x.example' END AS email FROM v_base)"""

#: Hosts of landed pages, as a column and as SQL.
HOST_SQL = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges between typed nodes: (ord, src, dst, src_type, dst_type, relation, source, confidence, evidence_id)."""
    from attestor.functions.urls import host_of

    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host")).where("host <> ''")
    # the last two labels of a host; three where the host ends in a two-label suffix
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    node = lambda kind, c: F.concat(F.lit(kind + ":"), c.cast("string"))
    kinds = [
        pages.select((F.col("page_id") * 10).alias("ord"), node("page", F.col("page_id")).alias("src"), node("host", F.col("host")).alias("dst"), F.lit("URL").alias("src_type"), F.lit("DOMAIN").alias("dst_type"), F.lit("LINKS_TO").alias("relation"), F.lit("web").alias("source")),
        pages.select((F.col("page_id") * 10 + 1).alias("ord"), node("host", F.col("host")).alias("src"), node("domain", domain).alias("dst"), F.lit("SUBDOMAIN").alias("src_type"), F.lit("DOMAIN").alias("dst_type"), F.when(F.col("page_id") % 2 == 0, "HAS_SUBDOMAIN").otherwise("RESOLVES_TO").alias("relation"), F.lit("dns").alias("source")),
        table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 10 + 2).alias("ord"), node("supplier", F.col("s_suppkey")).alias("src"), node("nation", F.col("s_nationkey")).alias("dst"), F.lit("COMPANY").alias("src_type"), F.lit("ORGANIZATION").alias("dst_type"), F.lit("HAS_PROFILE").alias("relation"), F.lit("registry").alias("source")),
        table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 10 + 3).alias("ord"), node("nation", F.col("n_nationkey")).alias("src"), node("region", F.col("n_regionkey")).alias("dst"), F.lit("ORGANIZATION").alias("src_type"), F.lit("ASN").alias("dst_type"), F.lit("BELONGS_TO_ASN").alias("relation"), F.lit("registry").alias("source")),
        table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 4).alias("ord"), node("customer", F.col("o_custkey")).alias("src"), node("order", F.col("o_orderkey")).alias("dst"), F.lit("PERSON").alias("src_type"), F.lit("SERVICE").alias("dst_type"), F.lit("HAS_MX").alias("relation"), F.lit("orders").alias("source")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.withColumn("confidence", _case(F.col("ord") % 4, {0: "LOW", 1: "MEDIUM", 2: "HIGH"}, "CONFIRMED")).withColumn("evidence_id", F.when(F.col("ord") % 3 != 0, F.concat(F.lit("ev"), F.col("ord").cast("string"))))


EDGES = f"""v_hosts AS (SELECT page_id, {HOST_SQL.format("url")} AS host FROM pages),
v_edges_ AS (
  SELECT page_id * 10 AS ord, 'page:' || page_id AS src, 'host:' || host AS dst, 'URL' AS src_type, 'DOMAIN' AS dst_type, 'LINKS_TO' AS relation, 'web' AS source FROM v_hosts WHERE host <> ''
  UNION ALL SELECT page_id * 10 + 1, 'host:' || host, 'domain:' || regexp_extract(host, '([^.]+\\.[^.]+)$', 1), 'SUBDOMAIN', 'DOMAIN', CASE WHEN page_id % 2 = 0 THEN 'HAS_SUBDOMAIN' ELSE 'RESOLVES_TO' END, 'dns' FROM v_hosts WHERE host <> ''
  UNION ALL SELECT s_suppkey * 10 + 2, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'COMPANY', 'ORGANIZATION', 'HAS_PROFILE', 'registry' FROM supplier
  UNION ALL SELECT n_nationkey::BIGINT * 10 + 3, 'nation:' || n_nationkey, 'region:' || n_regionkey, 'ORGANIZATION', 'ASN', 'BELONGS_TO_ASN', 'registry' FROM nation
  UNION ALL SELECT o_orderkey * 10 + 4, 'customer:' || o_custkey, 'order:' || o_orderkey, 'PERSON', 'SERVICE', 'HAS_MX', 'orders' FROM orders),
v_edges AS (SELECT *, CASE ord % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CONFIRMED' END AS confidence, CASE WHEN ord % 3 <> 0 THEN 'ev' || ord END AS evidence_id FROM v_edges_)"""
