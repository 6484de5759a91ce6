"""Queries over findings: scores, counts, views."""

from __future__ import annotations

from attestor.operators import findings as ops
from attestor.operators import scoring

from . import views

SITE = "module = 'username' AND title NOT IN ('Username sweep', 'Identity correlation')"
MEASURES = f"""v_measures AS (SELECT case_id, min(target_type) AS target_type,
  count(*) FILTER ({SITE} AND check_status = 'CONFIRMED') AS confirmed, count(*) FILTER ({SITE} AND check_status = 'LIKELY') AS likely,
  count(*) FILTER (status = 'FOUND' AND module IN ('dns', 'rdap', 'crtsh', 'certificates') AND confidence IN ('CONFIRMED', 'HIGH')) AS source_backed,
  count(*) FILTER (status = 'FOUND') AS found, count(*) FILTER (has_evidence) AS evidence,
  sum(CASE WHEN detections > 0 THEN least(detections * 4, 40) ELSE 0 END)::BIGINT AS risk_detections, sum(least(n_flags * 6, 24))::BIGINT AS risk_flags,
  sum(CASE WHEN coalesce(abuse, 0) <> 0 THEN floor(least(abuse, 40)) ELSE 0 END)::BIGINT AS risk_abuse,
  bool_or(coalesce(detections >= 5, false) OR coalesce(abuse >= 75, false)) AS certain,
  first(CASE WHEN detections > 0 THEN 'HIGH_RISK' ELSE 'SUSPICIOUS' END ORDER BY ord) FILTER (detections > 0 OR n_flags > 0 OR abuse >= 25) AS signal,
  count(*) FILTER (status = 'NOT_CONFIGURED') AS not_configured, count(*) FILTER (status = 'PROVIDER_UNAVAILABLE') AS unavailable,
  bool_or(module IN ('dns', 'rdap', 'crtsh')) AS resolved FROM v_findings GROUP BY case_id),
v_raw AS (SELECT *, CASE WHEN target_type = 'USERNAME' THEN 20 + least(confirmed * 4, 24) + least(likely * 2, 12)
    WHEN target_type = 'DOMAIN' THEN 20 + least(source_backed * 8, 32) + least(evidence, 15) ELSE 20 + least(found * 4, 32) + least(evidence, 15) END AS conf,
  5 + risk_detections + risk_flags + risk_abuse AS risk FROM v_measures),
v_scores AS (SELECT *, greatest(0, least(100, conf))::BIGINT AS confidence_score, greatest(0, least(100, risk))::BIGINT AS risk_score,
  greatest(0, least(100, 70 - least(not_configured * 2, 10) - least(unavailable * 2, 10) - CASE WHEN risk > 30 THEN least(risk // 2, 40) ELSE 0 END
    + CASE WHEN target_type = 'DOMAIN' AND resolved AND risk < 20 THEN 5 ELSE 0 END))::BIGINT AS reputation_score,
  CASE WHEN certain THEN 'CONFIRMED_BY_PROVIDER' ELSE coalesce(signal, 'LOW') END AS risk_level FROM v_raw)"""


def _scores(columns: str, where: str = "true"):
    names = [c.strip() for c in columns.split(",")]
    query = lambda spark, sf_dir: scoring.score_cases(views.findings(spark, sf_dir)).where(where).select(*names)
    return query, f"WITH {views.FINDINGS}, {MEASURES} SELECT {columns} FROM v_scores WHERE {where}"


_COUNTS = ["confirmed", "likely", "not_found", "inconclusive", *ops.ISSUES]
COUNTS_SQL = f"SELECT case_id, count(*) AS checked, count(*) FILTER (check_status IN ('CONFIRMED', 'LIKELY')) AS found, {', '.join(f'count(*) FILTER (check_status = {s.upper()!r}) AS {s}' for s in _COUNTS)} FROM v_findings WHERE {SITE} GROUP BY case_id"
BUCKET_SQL = "CASE WHEN check_status IN ('CONFIRMED', 'LIKELY') THEN 'found' WHEN check_status = 'NOT_FOUND' THEN 'not_found' " + " ".join(f"WHEN check_status IN {m!r} THEN {n!r}" for n, m in ops.BUCKETS.items()) + " ELSE 'inconclusive' END"
_NAMES = ("found", "not_found", *ops.BUCKETS, "inconclusive")
RANK_SQL = "CASE confidence WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CONFIRMED' THEN 4 END"
V = f"WITH {views.FINDINGS} "

_f = views.findings
_ALL = {
    "scores_all": _scores("case_id, target_type, confidence_score, risk_score, reputation_score, risk_level"),
    "score_username": _scores("case_id, confidence_score", "target_type = 'USERNAME'"),
    "score_generic": _scores("case_id, target_type, confidence_score", "target_type <> 'USERNAME'"),
    "score_risk_level": _scores("case_id, risk_level"),
    "score_reputation": _scores("case_id, reputation_score"),
    "score_risk_components": (
        lambda s, d: scoring.case_measures(_f(s, d)).select("case_id", "risk_detections", "risk_flags", "risk_abuse"),
        f"{V}, {MEASURES} SELECT case_id, risk_detections, risk_flags, risk_abuse FROM v_measures",
    ),
    "status_counts": (lambda s, d: ops.status_counts(_f(s, d), "case_id"), V + COUNTS_SQL),
    "collection_health": (
        lambda s, d: ops.collection_health(ops.status_counts(_f(s, d), "case_id"), "case_id"),
        f"{V}, c AS ({COUNTS_SQL}) SELECT case_id, greatest(0, checked - ({' + '.join(ops.ISSUES)})) AS ok, blocked, login_required, rate_limited, provider_unavailable, {' + '.join(ops.ISSUES)} AS issues, checked FROM c",
    ),
    "view_partition": (
        lambda s, d: ops.view_partition(_f(s, d), "case_id"),
        f"{V}, b AS (SELECT case_id, {BUCKET_SQL} AS b FROM v_findings WHERE {SITE}), c AS (SELECT case_id, count(*) AS checked, {', '.join(f'count(*) FILTER (b = {n!r}) AS {n}' for n in _NAMES)} FROM b GROUP BY case_id) SELECT *, checked = {' + '.join(_NAMES)} AS whole FROM c",
    ),
    "filter_found": (
        lambda s, d: ops.found_profiles(_f(s, d)).withColumn("rank", ops.F.col("rank").cast("long")),
        f"{V} SELECT case_id, ord, title, check_status, CASE WHEN check_status = 'CONFIRMED' THEN 0 ELSE 1 END::BIGINT AS rank FROM v_findings WHERE {SITE} AND check_status IN ('CONFIRMED', 'LIKELY')",
    ),
    "group_by_handle": (
        lambda s, d: ops.by_handle(_f(s, d)),
        f"{V} SELECT user_id, count(*) AS checked, count(*) FILTER (check_status IN ('CONFIRMED', 'LIKELY')) AS hits, coalesce(array_to_string(list_sort(list(DISTINCT title) FILTER (check_status IN ('CONFIRMED', 'LIKELY'))), ','), '') AS sites FROM v_findings WHERE {SITE} GROUP BY user_id",
    ),
    "confidence_merge": (
        lambda s, d: ops.merged_confidence(_f(s, d), "case_id"),
        f"{V}, m AS (SELECT case_id, max({RANK_SQL}) AS r FROM v_findings GROUP BY case_id) SELECT case_id, CASE r WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'HIGH' END AS confidence FROM m",
    ),
    "top_evidence": (
        lambda s, d: ops.top_evidence(_f(s, d)).select("case_id", "title", "check_status", "ord", ops.F.col("place").cast("long").alias("place")),
        f"{V}, r AS (SELECT case_id, title, check_status, ord, row_number() OVER (PARTITION BY case_id ORDER BY check_status <> 'CONFIRMED', title, ord) AS place FROM v_findings WHERE {SITE} AND check_status IN ('CONFIRMED', 'LIKELY')) SELECT * FROM r WHERE place <= 8",
    ),
    "modules_by_status": (
        lambda s, d: ops.modules_by_status(_f(s, d)),
        f"{V} SELECT status, array_to_string(list_sort(list(DISTINCT module)), ',') AS modules, count(*) AS n FROM v_findings GROUP BY status",
    ),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
