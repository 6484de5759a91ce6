"""A catalog of sites as a table: which rows are fit, which apply, and what services answer for which entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that tell of the service and never of a profile, besides 500 to 599.
RESERVED_CODES = (401, 403, 408, 429)
#: Entity types that services answer for.
SUPPORTED = {
    "abuseipdb": ["IP"],
    "alienvault": ["DOMAIN", "SUBDOMAIN", "IP", "URL", "HASH"],
    "censys": ["IP", "DOMAIN", "SUBDOMAIN"],
    "crtsh": ["DOMAIN", "SUBDOMAIN"],
    "github": ["USERNAME", "EMAIL", "DOMAIN", "COMPANY", "ORGANIZATION", "PERSON"],
    "greynoise": ["IP"],
    "hibp": ["EMAIL"],
    "ipinfo": ["IP"],
    "rdap": ["DOMAIN", "SUBDOMAIN", "IP"],
    "shodan": ["IP"],
    "urlscan": ["DOMAIN", "SUBDOMAIN", "URL", "IP"],
    "virustotal": ["DOMAIN", "SUBDOMAIN", "IP", "URL", "HASH"],
    "wayback": ["DOMAIN", "SUBDOMAIN", "URL"],
}


def slug_of(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def judged(rows: DataFrame) -> DataFrame:
    """rows(name, category, profile_url, expected_status, not_found_status, redirect_home, json_id_field, ord) -> slug and reject, null for rows that are fit.

    Codes must be from 100 to 599 and none that tells of the service only; a
    redirect may mean not_found and nothing else; a URL must have a place for the handle; of equal slugs the first is fit.
    """
    codes = lambda c: F.when(F.size(c) == 0, f"{c} is empty").when(F.exists(c, lambda x: (x < 100) | (x > 599)), f"{c} has no status code").when(F.exists(c, lambda x: x.isin(*RESERVED_CODES) | (x >= 500)), f"{c} has a reserved code")
    r = rows.withColumn("slug", slug_of(F.col("name")))
    reject = F.coalesce(
        F.when(F.coalesce("slug", F.lit("")) == "", "no name"),
        F.when(~F.col("profile_url").rlike(r"^https?://[^/]+"), "no URL"),
        F.when(~F.col("profile_url").contains("{username}"), "no place for the handle"),
        codes("expected_status"),
        codes("not_found_status"),
        F.when(F.lower(F.trim("redirect_home")) != "not_found", "unknown redirect policy"),
        F.when(F.trim("json_id_field") == "", "empty id field"),
    )
    r = r.withColumn("reject", reject)
    first = r.where("reject IS NULL").groupBy("slug").agg(F.min("ord").alias("first"))
    r = r.join(first, "slug", "left")
    return r.withColumn("reject", F.when(F.col("reject").isNull() & (F.col("ord") != F.col("first")), "slug is taken").otherwise(F.col("reject"))).drop("first")


def chosen(sites: DataFrame, categories: list[str] | None = None, without: list[str] = (), sensitive: bool = True, strategies: list[str] | None = None, enabled_only: bool = True) -> DataFrame:
    """sites(category, strategy, sensitive, enabled) that apply; names in any case."""
    plain = lambda names: [n.strip().lower() for n in names]
    out = sites.where("enabled") if enabled_only else sites
    out = out if sensitive else out.where("NOT sensitive")
    if categories:
        out = out.where(F.lower("category").isin(plain(categories)))
    if without:
        out = out.where(~F.lower("category").isin(plain(without)))
    return out.where(F.lower("strategy").isin(plain(strategies))) if strategies else out


def routed(entities: DataFrame, supported: dict[str, list[str]] | None = None) -> DataFrame:
    """entities(type, ...) with each service that answers for their type; services and types are a literal in the plan."""
    pairs = {}
    for service, types in (supported or SUPPORTED).items():
        for t in types:
            pairs.setdefault(t, []).append(service)
    by_type = F.create_map(*(x for t, ss in pairs.items() for x in (F.lit(t), F.array(*map(F.lit, ss)))))
    return entities.select("*", F.explode(F.try_element_at(by_type, F.col("type"))).alias("service"))
