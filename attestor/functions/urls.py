"""Columns over URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Top-level domains that abuse is frequent under.
SUSPICIOUS_TLDS = "zip mov xyz top click country gq tk ml cf ga work rest fit quest cfd sbs cyou buzz icu cam lol monster bond shop".split()
#: Hosts that shorten URLs.
SHORTENERS = "bit.ly t.co tinyurl.com goo.gl ow.ly is.gd buff.ly rebrand.ly cutt.ly shorturl.at rb.gy lnkd.in".split()
#: Query parameters that track.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid igshid mc_cid mc_eid ref referrer".split()
#: Suffixes of one label, besides all of two letters, which are those of countries.
SUFFIXES = """
    com net org info biz edu gov mil int arpa name pro aero coop museum mobi jobs travel tel post asia cat xxx dev app page blog cloud
    online site website store tech space live news media agency company solutions services group network systems digital design studio
    social community email link wiki life world today global art music video games academy school university health care law finance
    bank capital ventures fund eco earth green energy city berlin london paris nyc tokyo example test
""".split() + SUSPICIOUS_TLDS
#: Labels below a country that are part of its suffix.
SECOND_LEVELS = "co com org net gov edu ac or ne go gob mil gov nom sch ltd plc".split()

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """The host in lower case; empty without one."""
    host = F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1))
    return F.regexp_replace(host, r"^\[|\]$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[^/?#]*(/[^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def port_of(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:]+):([0-9]+)", 1)


def canonical(url: Column) -> Column:
    """https without a scheme, lower-case scheme and host, no default port, user or fragment; the query stays, an empty path is /."""
    u = F.trim(url)
    u = F.when(u.rlike(_SCHEME), u).otherwise(F.concat(F.lit("https://"), u))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port, path, query = port_of(u), path_of(u), query_of(u)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    host = host_of(u)
    host = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def identity(url: Column) -> Column:
    """A URL as evidence of identity: https, no www., no trailing slash, no tracking parameters, no fragment."""
    query = F.array_join(F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING)), "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.concat(F.lit("https://"), bare_host(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def normalized(raw: Column) -> Column:
    """What a page says is a URL, as evidence: https, no www., no slash at the end of a path, no tracking or empty parameters; null without a host."""
    t = F.trim(raw)
    t = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    # as Python writes forms: a star is encoded, a tilde is not
    encoded = lambda x: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    value = lambda p: F.regexp_extract(p, "^[^=]*=(.*)$", 1)
    pairs = F.filter(F.split(query_of(t), "&"), lambda p: (value(p) != "") & ~F.lower(name(p)).isin(TRACKING))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(encoded(name(p)), F.lit("="), encoded(value(p)))), "&")
    path, port = F.regexp_replace(path_of(t), "/+$", ""), port_of(t)
    host = F.concat(bare_host(t), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)))
    url = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when((F.trim(raw) != "") & (bare_host(t) != ""), url)


def avatar_key(url: Column) -> Column:
    """Sixteen hex digits of the URL without its query."""
    return F.substring(F.sha2(F.regexp_replace(url, r"[?#].*$", ""), 256), 1, 16)


def suffix_labels(host: Column) -> Column:
    """How many labels of a host are its public suffix; 0 where that isn't known."""
    return suffix_among(F.split(host, r"\."))


def suffix_among(labels: Column) -> Column:
    """How many of a host's labels are its public suffix; 0 where that isn't known.

    A rule and not a table: any label of two letters is a country's, with the
    labels of ``SECOND_LEVELS`` below it, if there is a further label.
    """
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.get(labels, n - 2)
    country = last.rlike("^[a-z]{2}$")
    return F.when((n >= 2) & country & second.isin(SECOND_LEVELS), 2).when((n >= 2) & (country | last.isin(SUFFIXES)), 1).otherwise(0)


def registrable(host: Column) -> Column:
    """The label before the public suffix, and the suffix; null where there is none."""
    labels, k = F.split(host, r"\."), suffix_labels(host)
    keep = k + 1
    return F.when((k > 0) & (F.size(labels) >= keep), F.array_join(F.slice(labels, F.greatest(F.size(labels) - k, F.lit(1)), keep), "."))


def ip_literal(host: Column) -> Column:
    return host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def risk_flags(url: Column) -> Column:
    """Heuristic flags of a URL, in a fixed order."""
    host = host_of(url)
    tld = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return F.array_compact(
        F.array(
            F.when(host.contains("xn--"), "punycode"),
            F.when(host.rlike(r"[^\x00-\x7F]"), "homoglyph_or_unicode"),
            F.when(tld.isin(SUSPICIOUS_TLDS), F.concat(F.lit("suspicious_tld."), tld)),
            F.when(F.length(host) > 50, "long_hostname"),
            F.when(ip_literal(host), "ip_url"),
            F.when(host.isin(SHORTENERS), "url_shortener"),
            F.when(url.contains("%"), "encoded_url"),
            F.when(url.rlike(_SCHEME + r"[^/?#@]+@"), "embedded_credentials"),
        )
    )


def risk_level(flags: Column) -> Column:
    severe = F.arrays_overlap(flags, F.array(F.lit("punycode"), F.lit("homoglyph_or_unicode"), F.lit("embedded_credentials")))
    return F.when(severe, "HIGH_RISK").when(F.size(flags) > 0, "SUSPICIOUS").otherwise("LOW")


def syntax_reason(url: Column) -> Column:
    """Why a URL may not be fetched; null if it may."""
    host = host_of(url)
    return (
        F.when(~url.rlike(r"^(?i:https?)://"), "scheme")
        .when(url.rlike(_SCHEME + r"[^/?#]*@"), "credentials")
        .when(host == "", "no_host")
        .when(host.isin("localhost", "metadata.google.internal") | host.rlike(r"\.(local|internal|localhost)$"), "blocked_host")
        .when(ip_literal(host) & blocked_ipv4(host), "blocked_ip")
    )


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null unless all four parts are 0 to 255 without leading zeros."""
    parts = F.split(ip, r"\.")
    number = F.lit(0).cast("long")
    for k in range(4):
        number = number * 256 + F.get(parts, F.lit(k)).cast("long")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


#: Ranges that are private, loopback, link-local or reserved.
PRIVATE_RANGES = {"0.0.0.0": 8, "10.0.0.0": 8, "127.0.0.0": 8, "169.254.0.0": 16, "172.16.0.0": 12, "192.0.0.0": 24, "192.0.2.0": 24, "192.168.0.0": 16, "198.18.0.0": 15, "198.51.100.0": 24, "203.0.113.0": 24, "240.0.0.0": 4}


def _bounds() -> list[tuple[int, int]]:
    out = []
    for base, bits in PRIVATE_RANGES.items():
        low = sum(int(p) << (24 - 8 * k) for k, p in enumerate(base.split(".")))
        out.append((low, low + (1 << (32 - bits)) - 1))
    return out


def private_ipv4(ip: Column) -> Column:
    """Whether an address is private, loopback, link-local or reserved; null if it is none."""
    n = ipv4_number(ip)
    inside = F.lit(False)
    for low, high in _bounds():
        inside = inside | n.between(low, high)
    return F.when(n.isNotNull(), inside)


def blocked_ipv4(ip: Column) -> Column:
    """Private ranges and multicast; what isn't an address is blocked."""
    return F.coalesce(private_ipv4(ip) | ipv4_number(ip).between(0xE0000000, 0xEFFFFFFF), F.lit(True))


def public_website(raw: Column) -> Column:
    """A website as a profile names it, with https where no scheme is given; null for platforms and what is no URL."""
    from .ids import PLATFORM_HOSTS

    t = F.trim(raw)
    t = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t)
    t = F.when(F.lower(t).rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = host_of(t)
    return F.when((F.trim(raw) != "") & (host != "") & ~host.isin(PLATFORM_HOSTS), t)


def unwrapped(href: Column) -> Column:
    """The target of a search page's redirect, if it is one."""
    raw = F.trim(href)
    raw = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw)
    target = F.regexp_extract(query_of(raw), r"(?:^|&)uddg=([^&]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(raw)


#: What paths of profile pages contain.
PROFILE_HINTS = "/users/ /user/ /u/ /profile/ /profiles/ /p/ /id/ /member/ /members/ /author/ /people/ /channel/ /c/ /in/".split()


def profile_shape(url: Column) -> Column:
    """Whether the path holds what paths of profiles hold."""
    path = F.lower(path_of(url))
    found = path.contains("/@")
    for hint in PROFILE_HINTS:
        found = found | path.contains(hint)
    return found


def candidate_handle(url: Column, requested: Column) -> Column:
    """The handle that a path may name: what follows a hint, else what follows an @, else the requested handle, else a similar part, else the first part of three letters.

    ``similar`` parts are judged by ``ids.username_match``.
    """
    from .ids import SIMILAR, username_match

    raw = F.transform(path_segments(url), F.lower)
    parts = F.filter(F.transform(raw, lambda x: F.regexp_replace(x, "^@+", "")), lambda x: x != "")
    hints = F.array(*(F.lit(h.strip("/")) for h in PROFILE_HINTS))
    after = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda k: F.when((k < F.size(parts)) & F.array_contains(hints, F.get(parts, k - 1)), F.get(parts, k))), lambda x: x.isNotNull())
    at = F.transform(F.filter(raw, lambda x: x.rlike("^@.")), lambda x: F.regexp_replace(x, "^@+", ""))
    asked = F.lower(F.regexp_replace(F.trim(requested), "^@+", ""))
    same = F.filter(parts, lambda x: (F.lower(x) == asked) & (asked != ""))
    similar = F.filter(parts, lambda x: (username_match(asked, x) == SIMILAR) & (asked != ""))
    first = F.get(parts, F.lit(0))
    return F.coalesce(F.get(after, F.lit(0)), F.get(at, F.lit(0)), F.get(same, F.lit(0)), F.get(similar, F.lit(0)), F.when(F.length(first) >= 3, first), F.lit(""))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")
