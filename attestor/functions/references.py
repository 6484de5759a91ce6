"""References that stand for values in logs, and the forms that a value takes there.

A reference is the beginning of an HMAC under a case's own salt, so lines of one case
can be told to be about the same value, and lines of two cases can't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.ips import hextets, normal_ip
from attestor.functions.markup import let
from attestor.functions.urls import host_of, ipv4_number

#: Shortest forms that are searched for, of a value and of an address's halves; digits of a reference.
SHORTEST, SHORTEST_HALF, DIGITS = 6, 8, 8


def pads(key_hex: Column) -> Column:
    """What HMAC-SHA256 puts before a text (``inner``) and before its digest (``outer``) under a key of any length, given in hex.

    They cost far more than the digests, so a table of keys gets them before it meets the texts.
    """
    key = F.when(F.length(key_hex) > 128, F.sha2(F.unhex(key_hex), 256)).otherwise(key_hex)
    byte = lambda k, i: F.conv(F.substr(k, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    pad = lambda k, n: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(k, i).bitwiseXOR(F.lit(n))), 2, "0")), ""))
    return let(F.rpad(key, 128, "0"), lambda k: F.struct(pad(k, 0x36).alias("inner"), pad(k, 0x5C).alias("outer")))


def hmac_under(padded: Column, text: Column) -> Column:
    """HMAC-SHA256 of a text's UTF-8 under a key's ``pads``; lower-case hex."""
    return F.sha2(F.concat(padded["outer"], F.unhex(F.sha2(F.concat(padded["inner"], F.encode(text, "UTF-8")), 256))), 256)


def hmac_sha256(key_hex: Column, text: Column) -> Column:
    """HMAC-SHA256 of a text's UTF-8 under a key of any length, given in hex; lower-case hex."""
    return let(pads(key_hex), lambda p: hmac_under(p, text))


def _referred(text: Column, kind: str, hashed) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low == "", "-").otherwise(F.concat(F.lit(f"{kind}:"), F.left(hashed(low), F.lit(DIGITS))))


def reference(value: Column, salt_hex: Column, kind: str = "t") -> Column:
    """t: and eight digits for a value in any case; - for none. Letters are compared in lower case."""
    return _referred(value, kind, lambda low: hmac_sha256(salt_hex, low))


def reference_under(value: Column, padded: Column, kind: str = "t") -> Column:
    """``reference`` by a salt's ``pads``: for many values of few salts."""
    return _referred(value, kind, lambda low: hmac_under(padded, low))


def named_host(value: Column) -> Column:
    """The host of a URL, of a host with port or user, or of an address, with or without brackets."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    authority = F.substring_index(F.split_part(raw, F.lit("/"), F.lit(1)), "@", -1)
    bracketed = F.regexp_extract(authority, r"^\[+([^\]]*)", 1)
    bare = F.coalesce(normal_ip(F.trim(authority)), normal_ip(F.nullif(bracketed, F.lit(""))), F.split_part(authority, F.lit(":"), F.lit(1)))
    host = F.when(raw.contains("://"), F.coalesce(normal_ip(host_of(raw)), host_of(raw))).otherwise(bare)
    return F.regexp_replace(F.trim(host), r"\.+$", "")


def host_reference(value: Column, salt_hex: Column) -> Column:
    """h: and the digits of a value's ``named_host``."""
    return reference(named_host(value), salt_hex, "h")


def host_reference_under(value: Column, padded: Column) -> Column:
    """``host_reference`` by a salt's ``pads``; the host is found once, not where each part of the reference names it."""
    return let(named_host(value), lambda h: reference_under(h, padded, "h"))


def quoted_plus(value: Column) -> Column:
    """A value as in a query string: all but letters, digits and _.-~ by their bytes, spaces as +."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def reverse_pointer(ip: Column) -> Column:
    """The name under which an address is looked up backwards; null for what is none."""
    four = F.concat(F.array_join(F.reverse(F.split(ip, r"\.")), "."), F.lit(".in-addr.arpa"))
    digits = F.array_join(F.transform(hextets(ip), lambda p: F.lpad(F.lower(F.hex(p)), 4, "0")), "")
    six = F.concat(F.array_join(F.reverse(F.split(digits, "(?!^)(?!$)")), "."), F.lit(".ip6.arpa"))
    return F.when(ipv4_number(ip).isNotNull(), four).when(ip.contains(":") & hextets(ip).isNotNull(), six)


def forms(value: Column, words: tuple[str, ...] = ()) -> Column:
    """The spellings of a value in a line, without repeats: as it is, percent-encoded in three ways, with its gaps, underscores or dots written
    otherwise; of an address its digests and halves, of a URL its host, of an IP address its reverse name.

    Values of fewer than six characters have none, so that words of every line stay; nor do forms that short, halves of an
    address of fewer than eight, or those that ``words`` (in lower case) names. A whole address always counts.
    """

    def made(v: Column) -> Column:
        plus, email, low = quoted_plus(v), v.contains("@"), F.lower(v)
        whole = F.replace(plus, F.lit("+"), F.lit("%20"))
        gap = lambda to: F.replace(v, F.lit(" "), F.lit(to))
        halves = F.array(F.regexp_extract(v, "(?s)^(.*)@", 1), F.substring_index(v, "@", -1))
        of_email = F.array(F.md5(low), F.sha2(low, 256))
        host = F.when(v.contains("://"), F.nullif(host_of(v), F.lit("")))
        spellings = F.array(v, whole, F.replace(whole, F.lit("%2F"), F.lit("/")), plus, gap(""), gap("-"), gap("_"), F.replace(v, F.lit("_"), F.lit("-")), F.replace(v, F.lit("."), F.lit("-")))
        rest = F.array(host, reverse_pointer(v))
        all_ = F.concat(spellings, F.when(email, F.concat(of_email, halves)).otherwise(F.array().cast("array<string>")), rest)
        part = lambda f: email & F.array_contains(halves, f)
        long = lambda f: F.length(f) >= F.when(part(f), SHORTEST_HALF).otherwise(SHORTEST)
        unusual = lambda f: ~F.lower(f).isin(*words) if words else F.lit(True)
        kept = F.filter(F.array_distinct(F.array_compact(all_)), lambda f: (email & (f == v)) | (long(f) & unusual(f)))
        return F.when(email | (F.length(v) >= SHORTEST), kept).otherwise(F.array().cast("array<string>"))

    return let(F.trim(F.coalesce(value, F.lit(""))), made)


def without_secrets(text: Column, secrets: list[str], instead: str = "CONFIGURED") -> Column:
    """A text with the live secrets of a job's settings, of eight characters or more, replaced wherever they stand."""
    for secret in secrets:
        if len(secret) >= 8:
            text = F.replace(text, F.lit(secret), F.lit(instead))
    return text
