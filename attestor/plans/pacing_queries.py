"""Queries over spacing and pauses of hosts, from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import pacing

from .views import table


def _events(s, d):
    """Errors ask for a pause of their host, some for none; all else are calls."""
    k = F.col("event_id")
    host = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit(" H"), (F.col("user_id") % 3).cast("string"))).otherwise(F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example")))
    error = F.col("event_type") == "error"
    return table(s, d, "events").select(host.alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), k.alias("ord"), F.when(error, (k % 5 - 1) * 20000).alias("seconds"), F.when(error, F.concat(F.lit("r"), (k % 4).cast("string"))).alias("reason"))


def host_pauses(s, d):
    return pacing.pauses(_events(s, d))


def host_remaining(s, d):
    return pacing.remaining(_events(s, d))


def limiter_keys(s, d):
    e = table(s, d, "events")
    provider = F.element_at(F.array(F.lit("rdap"), F.lit("HIBP "), F.lit("hibp"), F.lit(None).cast("string"), F.lit("other")), (F.col("event_id") % 5 + 1).cast("int"))
    host = F.when(F.col("event_id") % 3 == 0, F.lit(" Crtsh")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("H"), (F.col("user_id") % 50).cast("string")))
    override = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 4 - 1.5)
    return e.groupBy(pacing.limiter_key(provider, host).alias("key"), pacing.interval_us(provider, host, override).alias("interval_us")).agg(F.count("*").alias("calls"))


_E = "e AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'h' || user_id % 3 ELSE 'h' || user_id || '.example' END AS host, epoch_us(ts) AS at_us, event_id AS ord, CASE WHEN event_type = 'error' THEN at_us + greatest(0, event_id % 5 - 1) * 20000000000 END AS until, CASE WHEN event_type = 'error' THEN 'r' || event_id % 4 END AS reason FROM events)"
_ALL = {
    "host_pauses": (host_pauses, f"WITH {_E}, n AS (SELECT *, lead(at_us) OVER (PARTITION BY host ORDER BY at_us, ord) AS next FROM e WHERE until IS NOT NULL) SELECT host, at_us AS from_us, CASE WHEN next < until THEN next ELSE until END AS to_us, reason, CASE WHEN next < until THEN 'renewed' ELSE 'expired' END AS ended FROM n"),
    "host_remaining": (
        host_remaining,
        f"WITH {_E}, l AS (SELECT *, last_value(until IGNORE NULLS) OVER w AS u, last_value(reason IGNORE NULLS) OVER w AS r FROM e WINDOW w AS (PARTITION BY host ORDER BY at_us, ord ROWS UNBOUNDED PRECEDING)) SELECT host, at_us, ord, greatest(0, coalesce(u - at_us, 0)) AS left_us, coalesce(r, '') AS reason FROM l WHERE until IS NULL",
    ),
    "limiter_keys": (
        limiter_keys,
        """WITH e AS (SELECT event_id AS k, ['rdap', 'hibp', 'hibp', 'default', 'other'][event_id % 5 + 1] AS p, event_id % 5 = 1 AS odd, CASE event_id % 3 WHEN 0 THEN 'crtsh' WHEN 1 THEN 'h' || user_id % 50 END AS h FROM events)
SELECT CASE WHEN h IS NULL THEN 'provider:' || p ELSE 'host:' || h END AS key, CASE WHEN k % 7 = 0 THEN greatest(0, (k % 4) * 1000000 - 1500000) WHEN h = 'crtsh' THEN 1000000 WHEN p = 'rdap' THEN 500000 WHEN p = 'hibp' AND NOT odd THEN 1600000 ELSE 250000 END::BIGINT AS interval_us, count(*) AS calls FROM e GROUP BY ALL""",
    ),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
