"""Queries over a store of runs: orders are runs, their lines findings. Runs are committed in two parts, some again, some are taken back, and one writer dies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestor.sources import store
from attestor.sources.steps import shared_dir

from .views import table


def _runs(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("case_id"), F.lit("completed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_orderdate").cast("timestamp").alias("finished_at"))


def _findings(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("ord"), F.col("l_partkey").alias("part"))
    return lines.join(_runs(s, d).select("run_id", "case_id"), "run_id")


def _entities(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("entity"), F.col("o_orderstatus").alias("confidence"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("source"), F.col("o_orderdate").cast("timestamp").alias("seen_at"))


def _stored(s, d) -> str:
    root = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    k = F.col("run_id")
    parts = lambda where, add=0: {"runs": _runs(s, d).where(where), "findings": _findings(s, d).where(where).withColumn("part", F.col("part") + add), "entities": _entities(s, d).where(where)}
    store.commit(s, root, parts(k % 3 != 0))
    store.commit(s, root, parts(k % 3 != 1, 1))  # every third run comes a second time, with other parts
    for name, rows in parts(k % 2 == 0, 5).items():  # this writer never comes to its end
        rows.write.parquet(f"{root}/{name}/commit=dead")
    store.roll_back(s, root, _runs(s, d).where(k % 5 == 0), "2030-01-01")
    return root


def run_store_findings(s, d):
    f = store.facts(s, _stored(s, d), "findings")
    return f.groupBy("case_id", "run_id").agg(F.count("*").alias("findings"), F.sum("part").alias("parts"))


def run_store_states(s, d):
    return store.listed(s, _stored(s, d)).withColumn("place", F.col("place").cast("long"))


def run_store_latest(s, d):
    return store.latest_snapshot(s, _stored(s, d)).select("case_id", "run_id", "ord", "part")


def run_store_entities(s, d):
    return store.entities(s, _stored(s, d))


_R = "r AS (SELECT o_orderkey AS run_id, o_custkey AS case_id, o_orderdate::TIMESTAMP AS t, o_orderkey % 5 = 0 AS back FROM orders), f AS (SELECT case_id, run_id, l_linenumber::BIGINT AS ord, l_partkey + (run_id % 3 <> 1)::INT AS part, back, t FROM lineitem JOIN r ON l_orderkey = run_id)"
_ALL = {
    "run_store_findings": (run_store_findings, f"WITH {_R} SELECT case_id, run_id, count(*) AS findings, sum(part)::BIGINT AS parts FROM f WHERE NOT back GROUP BY ALL"),
    "run_store_states": (run_store_states, f"WITH {_R} SELECT run_id, case_id, CASE WHEN back THEN 'rolled_back' ELSE 'completed' END AS status, t AS started_at, CASE WHEN back THEN TIMESTAMP '2030-01-01' ELSE t END AS finished_at, row_number() OVER (PARTITION BY case_id ORDER BY t DESC, run_id DESC) AS place FROM r"),
    "run_store_latest": (run_store_latest, f"WITH {_R}, l AS (SELECT case_id, max_by(run_id, (t, run_id)) AS run_id FROM r WHERE NOT back GROUP BY 1) SELECT case_id, run_id, ord, part FROM f JOIN l USING (case_id, run_id)"),
    "run_store_entities": (
        run_store_entities,
        """WITH c AS (SELECT *, 'r' || o_orderkey AS source, part FROM orders, (VALUES (1), (2)) v(part) WHERE part = 1 AND o_orderkey % 3 <> 0 OR part = 2 AND o_orderkey % 3 <> 1)
SELECT o_custkey AS case_id, o_orderpriority AS entity, arg_min(source, (part, o_orderdate, source)) AS source, arg_max(o_orderstatus, (part, o_orderdate, source)) AS confidence, min(o_orderdate::TIMESTAMP) AS first_seen, max(o_orderdate::TIMESTAMP) AS last_seen FROM c GROUP BY ALL""",
    ),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
