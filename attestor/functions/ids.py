"""Columns that recognise, normalise and name entity values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded, squeezed
from .urls import bare_host, canonical, ipv4_number, suffix_among, suffix_labels

EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
USERNAME = r"^[A-Za-z0-9._\-]{1,64}$"
PHONE = r"^\+?[0-9][0-9\-\s()]{6,20}$"
ASN = r"^(?i:AS)?[0-9]{1,10}$"
DOMAIN = r"^([A-Za-z0-9]([A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"
#: Digest names by number of hex digits.
HASHES = {32: "MD5", 40: "SHA1", 64: "SHA256", 128: "SHA512"}


def hash_algorithm(value: Column) -> Column:
    """The digest that a hex string of this length is; null for none."""
    v = F.trim(value)
    out = F.lit(None).cast("string")
    for n, name in HASHES.items():
        out = F.when(F.length(v) == n, name).otherwise(out)
    return F.when(v.rlike("^[A-Fa-f0-9]+$"), out)


def domain_of(value: Column) -> Column:
    """A domain in lower case without scheme, path, port and last dots; null without a known public suffix."""
    v = plain_host(value)
    k = suffix_labels(v)
    return F.when((k > 0) & (F.size(F.split(v, r"\.")) > k) & v.rlike(DOMAIN), v)


def plain_host(value: Column) -> Column:
    """In lower case without scheme, path, port and last dots."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.rtrim(F.split_part(F.split_part(v, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)), F.lit("."))


def known_domains(hosts: Column) -> Column:
    """Of an array of plain hosts those that ``domain_of`` knows, each once; for use in arrays, where an expression is computed wherever it is written."""
    split = F.transform(F.array_distinct(hosts), lambda v: F.struct(v.alias("v"), F.split(v, r"\.").alias("labels")))
    known = F.transform(split, lambda x: F.struct(x["v"].alias("v"), F.size(x["labels"]).alias("n"), suffix_among(x["labels"]).alias("k")))
    return F.transform(F.filter(known, lambda x: (x["k"] > 0) & (x["n"] > x["k"]) & x["v"].rlike(DOMAIN)), lambda x: x["v"])


def asn_of(value: Column) -> Column:
    return F.when(F.trim(value).rlike(ASN), F.concat(F.lit("AS"), F.regexp_extract(F.trim(value), "([0-9]+)$", 1).cast("long").cast("string")))


def entity_type(value: Column, domain: Column | None = None) -> Column:
    """The type of a value; the first rule that holds decides. Null for what is nothing. ``domain``: ``domain_of`` the value, if it is at hand."""
    v = F.trim(value)
    domain = domain_of(v) if domain is None else domain
    return (
        F.when(v == "", None)
        .when(hash_algorithm(v).isNotNull(), "HASH")
        .when(ipv4_number(v).isNotNull(), "IP")
        .when(v.rlike(EMAIL), "EMAIL")
        .when(v.rlike(r"^(?i:https?)://[^/?#]") | v.rlike(r"^(?i:www\.)[^/?#]"), "URL")
        .when(v.rlike(ASN), "ASN")
        .when(domain.isNotNull(), "DOMAIN")
        .when(v.rlike(USERNAME), "USERNAME")
        .when(v.rlike(PHONE), "PHONE")
        .when(v.contains(" ") | (F.length(v) > 3), "COMPANY")
    )


def normalised(kind: Column, value: Column, domain: Column | None = None) -> Column:
    """A value in the form that names its entity."""
    v = F.trim(value)
    domain = domain_of(v) if domain is None else domain
    return (
        F.when(kind.isin("HASH", "EMAIL"), F.lower(v))
        .when(kind == "URL", canonical(v))
        .when(kind == "ASN", asn_of(v))
        .when(kind == "DOMAIN", domain)
        .when(kind == "USERNAME", F.lower(F.regexp_replace(v, "^@", "")))
        .when(kind == "PHONE", F.regexp_replace(v, r"[^0-9+]", ""))
        .otherwise(v)
    )


def entity_id(kind: Column, norm: Column) -> Column:
    """24 hex digits that name an entity by its type and normal form."""
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), norm), 256), 1, 24)


def plain_name(name: Column, fold=folded) -> Column:
    """A name without marks on letters, only a to z, digits and single spaces."""
    return squeezed(F.regexp_replace(F.lower(fold(name)), r"[^a-z0-9\s]", " "))


def mask(value: Column, keep: int = 2) -> Column:
    """A secret with its ends kept and at least four stars between; one of at most both ends is all stars."""
    n = F.length(value)
    return F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(keep)), F.repeat(F.lit("*"), F.greatest(F.lit(4), n - 2 * keep)), F.right(value, F.lit(keep))))


SEPARATORS = r"[-_.]+"
#: Words that platforms and people add to handles.
AFFIXES = "official real dev app team hq pub bot io tech the my".split()
EXACT, SIMILAR, UNRELATED = "EXACT_MATCH", "SIMILAR_CANDIDATE", "UNRELATED"


def _escaped(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def username_match(requested: Column, observed: Column) -> Column:
    """How an observed handle relates to a requested one. A similar handle is a candidate, never the same account."""
    req, obs = (F.lower(F.regexp_replace(F.trim(c), "^@+", "")) for c in (requested, observed))
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, SEPARATORS), lambda t: t != ""))
    count = lambda c: F.size(F.filter(F.split(c, SEPARATORS), lambda t: t != ""))
    unified = lambda c: F.regexp_replace(c, SEPARATORS, "_")
    joined = lambda c: F.regexp_replace(c, SEPARATORS, "")
    affixed = F.lit(False)
    for a in AFFIXES:
        affixed = affixed | (obs == F.concat(req, F.lit(f"_{a}"))) | (obs == F.concat(F.lit(f"{a}_"), req)) | (obs == F.concat(req, F.lit(f"-{a}"))) | (obs == F.concat(F.lit(f"{a}-"), req)) | (obs == F.concat(req, F.lit(f".{a}")))
    more = F.length(obs) - F.length(req)
    numbered = (F.startswith(obs, req) & F.substr(obs, F.length(req) + 1).rlike("^[_.-]?[0-9]+$")) | (F.endswith(obs, req) & F.left(obs, F.greatest(F.lit(0), more)).rlike("^[0-9]+[_.-]?$"))
    digits_after = F.startswith(joined(obs), joined(req)) & F.substr(joined(obs), F.length(joined(req)) + 1).rlike("^[0-9]+$") & (joined(req) != "")
    a, b = tokens(req), tokens(obs)
    permuted = (count(req) >= 2) & (count(obs) >= 2) & (F.size(F.array_except(a, b)) == 0) & ((F.size(F.array_except(b, a)) == 0) | (count(obs) <= count(req) + 2))
    longer = F.length(obs) - F.length(req)
    edge = lambda c: c.isin("_", "-", ".")
    stem = (longer <= 6) & (longer >= 1) & ((F.startswith(obs, req) & edge(F.substr(obs, F.length(req) + 1, F.lit(1)))) | (F.endswith(obs, req) & edge(F.substr(obs, longer, F.lit(1)))))
    similar = (unified(req) == unified(obs)) | ((joined(req) != "") & (joined(req) == joined(obs))) | numbered | digits_after | affixed | permuted | stem
    return F.when(F.coalesce(req, F.lit("")) == "", UNRELATED).when(F.coalesce(obs, F.lit("")) == "", UNRELATED).when(req == obs, EXACT).when(similar, SIMILAR).otherwise(UNRELATED)


#: Hosts of platforms, where a profile's host says nothing about its owner.
PLATFORM_HOSTS = """
    github.com gitlab.com bitbucket.org codeberg.org reddit.com news.ycombinator.com dev.to medium.com keybase.io hub.docker.com npmjs.com
    pypi.org replit.com kaggle.com pinterest.com tumblr.com steamcommunity.com youtube.com twitch.tv vimeo.com soundcloud.com last.fm
    chess.com lichess.org bsky.app mastodon.social linktr.ee hackerone.com bugcrowd.com behance.net dribbble.com artstation.com flickr.com
    t.me telegram.me instagram.com facebook.com threads.net tiktok.com x.com twitter.com linkedin.com docker.com youtu.be
""".split()


def personal_domain(url: Column) -> Column:
    """The host of a URL as evidence of identity: null for platforms."""
    host = bare_host(url)
    return F.when((host != "") & ~host.isin(PLATFORM_HOSTS), host)
