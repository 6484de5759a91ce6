"""Views and counts over findings: sites checked, what was found, what stayed open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import is_site_finding

FOUND = ("CONFIRMED", "LIKELY")
#: What a check can end with that is an issue of collection.
ISSUES = "blocked login_required rate_limited provider_unavailable session_expired challenge_required captcha_required temporarily_limited oauth_browser_rejected".split()
#: Groups of statuses that leave a check open.
BUCKETS = {
    "blocked": ("BLOCKED", "CHALLENGE_REQUIRED", "CAPTCHA_REQUIRED", "OAUTH_BROWSER_REJECTED"),
    "login": ("LOGIN_REQUIRED", "SESSION_EXPIRED"),
    "rate_limited": ("RATE_LIMITED", "TEMPORARILY_LIMITED"),
}
CONFIDENCE_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CONFIRMED": 4}


def status_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """How many site checks ended in each status."""
    status = F.col("check_status")
    counts = [F.count_if(status == s.upper()).alias(s) for s in ("confirmed", "likely", "not_found", "inconclusive", *ISSUES)]
    return findings.where(is_site_finding()).groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(status.isin(*FOUND)).alias("found"), *counts)


def collection_health(counts: DataFrame, *keys: str) -> DataFrame:
    """Checks that gave an answer, and those that didn't."""
    issues = sum((F.col(c) for c in ISSUES), F.lit(0))
    return counts.select(*keys, F.greatest(F.lit(0), F.col("checked") - issues).alias("ok"), "blocked", "login_required", "rate_limited", "provider_unavailable", issues.alias("issues"), "checked")


def bucket(status: Column) -> Column:
    """The group of an open status; anything else that isn't decided is inconclusive."""
    out = F.when(status.isin(*FOUND), "found").when(status == "NOT_FOUND", "not_found")
    for name, members in BUCKETS.items():
        out = out.when(status.isin(*members), name)
    return out.otherwise("inconclusive")


def view_partition(findings: DataFrame, *keys: str) -> DataFrame:
    """Every check in exactly one group; ``whole`` says that the groups add up."""
    b = bucket(F.col("check_status"))
    names = ("found", "not_found", *BUCKETS, "inconclusive")
    out = findings.where(is_site_finding()).groupBy(*keys).agg(F.count("*").alias("checked"), *(F.count_if(b == n).alias(n) for n in names))
    return out.withColumn("whole", F.col("checked") == sum((F.col(n) for n in names), F.lit(0)))


def found_profiles(findings: DataFrame) -> DataFrame:
    """Site findings that say found, the certain ones first."""
    return findings.where(is_site_finding() & F.col("check_status").isin(*FOUND)).select("case_id", "ord", "title", "check_status", F.when(F.col("check_status") == "CONFIRMED", 0).otherwise(1).alias("rank"))


def by_handle(findings: DataFrame) -> DataFrame:
    """For each handle: checks, hits and the sites that were hit, sorted."""
    hit = F.col("check_status").isin(*FOUND)
    return findings.where(is_site_finding()).groupBy("user_id").agg(F.count("*").alias("checked"), F.count_if(hit).alias("hits"), F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("title")))), ",").alias("sites"))


def merged_confidence(findings: DataFrame, *keys: str, allow_confirmed: bool = False) -> DataFrame:
    """The highest confidence; CONFIRMED only where that is allowed, as inference never confirms."""
    rank = F.lit(0)
    for name, r in CONFIDENCE_RANK.items():
        rank = F.when(F.col("confidence") == name, r).otherwise(rank)
    best = F.max_by("confidence", F.when(F.col("confidence").isNotNull(), rank))
    out = findings.groupBy(*keys).agg(best.alias("best"))
    return out.select(*keys, (F.col("best") if allow_confirmed else F.when(F.col("best") == "CONFIRMED", "HIGH").otherwise(F.col("best"))).alias("confidence"))


def top_evidence(findings: DataFrame, limit: int = 8) -> DataFrame:
    """The first found profiles of each case: certain ones, then by site."""
    order = Window.partitionBy("case_id").orderBy("rank", "title", "ord")
    return found_profiles(findings).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def modules_by_status(findings: DataFrame) -> DataFrame:
    """The modules that reported each status, sorted."""
    return findings.groupBy("status").agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"), F.count("*").alias("n"))
