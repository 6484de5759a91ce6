"""Scores of cases from their findings: confidence, risk, reputation.

A finding's order within its case (``ord``) is part of the meaning of the risk
level, so it is a column and not the order of rows. Everything else is sums and
conditional counts, so one shuffle by case carries it all, with partial sums
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles of summary findings, which are no site's.
SUMMARY_TITLES = ("Username sweep", "Identity correlation")
SOURCE_MODULES = ("dns", "rdap", "crtsh", "certificates")
LEVELS = ("LOW", "SUSPICIOUS", "HIGH_RISK", "CONFIRMED_BY_PROVIDER")


def is_site_finding() -> Column:
    return (F.col("module") == "username") & ~F.col("title").isin(*SUMMARY_TITLES)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("long")


def _upto(n: Column, most: int) -> Column:
    return F.least(n, F.lit(most))


def risk_parts() -> tuple[Column, Column, Column]:
    """What one finding adds to the risk: by detections, flags and abuse; missing inputs add nothing."""
    detections = F.when(F.col("detections") > 0, _upto(F.col("detections") * 4, 40)).otherwise(0)
    flags = _upto(F.col("n_flags") * 6, 24)
    abuse = F.when(F.coalesce(F.col("abuse"), F.lit(0.0)) != 0, F.floor(F.least(F.col("abuse"), F.lit(40.0)))).otherwise(0)
    return detections.cast("long"), flags.cast("long"), abuse.cast("long")


def first_signal() -> Column:
    """The level that a finding alone would raise a case to, by its first signal; null for none."""
    return F.when(F.col("detections") > 0, "HIGH_RISK").when(F.col("n_flags") > 0, "SUSPICIOUS").when(F.col("abuse") >= 25, "SUSPICIOUS")


def case_measures(findings: DataFrame) -> DataFrame:
    """One row for each case, with every count and sum that the scores need."""
    detections, flags, abuse = risk_parts()
    found = F.col("status") == "FOUND"
    certain = F.coalesce((F.col("detections") >= 5) | (F.col("abuse") >= 75), F.lit(False))
    return findings.groupBy("case_id").agg(
        F.min("target_type").alias("target_type"),
        F.count_if(is_site_finding() & (F.col("check_status") == "CONFIRMED")).alias("confirmed"),
        F.count_if(is_site_finding() & (F.col("check_status") == "LIKELY")).alias("likely"),
        F.count_if(found & F.col("module").isin(*SOURCE_MODULES) & F.col("confidence").isin("CONFIRMED", "HIGH")).alias("source_backed"),
        F.count_if(found).alias("found"),
        F.count_if("has_evidence").alias("evidence"),
        F.sum(detections).alias("risk_detections"),
        F.sum(flags).alias("risk_flags"),
        F.sum(abuse).alias("risk_abuse"),
        F.max(certain).alias("certain"),
        F.min_by(first_signal(), F.when(first_signal().isNotNull(), F.col("ord"))).alias("signal"),
        F.count_if(F.col("status") == "NOT_CONFIGURED").alias("not_configured"),
        F.count_if(F.col("status") == "PROVIDER_UNAVAILABLE").alias("unavailable"),
        F.max(F.col("module").isin("dns", "rdap", "crtsh")).alias("resolved"),
    )


def confidence_score() -> Column:
    """20 for the target, more for what backs it; by the kind of target."""
    return (
        F.when(F.col("target_type") == "USERNAME", 20 + _upto(F.col("confirmed") * 4, 24) + _upto(F.col("likely") * 2, 12))
        .when(F.col("target_type").isin("DOMAIN", "SUBDOMAIN"), 20 + _upto(F.col("source_backed") * 8, 32) + _upto(F.col("evidence"), 15))
        .otherwise(20 + _upto(F.col("found") * 4, 32) + _upto(F.col("evidence"), 15))
    )


def risk_score() -> Column:
    return 5 + F.col("risk_detections") + F.col("risk_flags") + F.col("risk_abuse")


def risk_level() -> Column:
    """A provider's certainty always holds; else the first signal in order, never lowered and never raised by a later one."""
    return F.when(F.col("certain"), "CONFIRMED_BY_PROVIDER").otherwise(F.coalesce("signal", F.lit("LOW")))


def reputation_score() -> Column:
    """70 less for missing providers and for risk over 30, unclamped; 5 more for a domain that resolved without signals."""
    missing = _upto(F.col("not_configured") * 2, 10) + _upto(F.col("unavailable") * 2, 10)
    penalty = F.when(risk_score() > 30, F.least(F.floor(risk_score() / 2), F.lit(40))).otherwise(0)
    clean = F.when(F.col("target_type").isin("DOMAIN", "SUBDOMAIN") & F.col("resolved") & (risk_score() < 20), 5).otherwise(0)
    return 70 - missing - penalty + clean


def score_cases(findings: DataFrame) -> DataFrame:
    """The three scores, from 0 to 100, and the risk level of each case."""
    return case_measures(findings).select("case_id", "target_type", clamp(confidence_score()).alias("confidence_score"), clamp(risk_score()).alias("risk_score"), clamp(reputation_score()).alias("reputation_score"), risk_level().alias("risk_level"))
