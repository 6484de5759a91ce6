"""Columns over IPv6 addresses, as two longs of 64 bits; IPv4 is in ``urls``.

A prefix is told by masking, so no unsigned comparison is needed. Reserved ranges
are those that the ipaddress module of Python 3.13.0 knows.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.markup import let
from attestor.functions.urls import blocked_ipv4, ipv4_number, private_ipv4

#: Ranges of special use, and what within them is of general use.
PRIVATE = "::1/128 ::/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10".split()
PUBLIC = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
RESERVED = "::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fe00::/9".split()
UNREACHABLE = "ff00::/8 fec0::/10".split()
#: Addresses at which clouds tell machines their keys.
METADATA = ("169.254.169.254", "169.254.170.2", "100.100.100.200")

_H = "[0-9A-Fa-f]{1,4}"
FORM = rf"^(?:(?:{_H}:){{7}}{_H}|(?:{_H}(?::{_H})*+)?::(?:{_H}(?::{_H})*+)?)$"


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _hex(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 16))


def hextets(ip: Column) -> Column:
    """The eight parts of an IPv6 address as numbers; null unless it is one. A zone after % is left out."""
    body = F.regexp_replace(F.trim(ip), "%[^%]+$", "")
    dotted = F.regexp_extract(body, r"^.*:([0-9]+(?:\.[0-9]+){3})$", 1)

    def opened(n: Column) -> Column:
        # an IPv4 address at the end stands for two parts
        return F.when(dotted == "", body).otherwise(F.concat(F.left(body, F.length(body) - F.length(dotted)), _hex(F.shiftright(n, 16)), F.lit(":"), _hex(n.bitwiseAND(0xFFFF))))

    def parts(text: Column) -> Column:
        side = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
        left, right = side(F.substring_index(text, "::", 1)), F.when(text.contains("::"), side(F.substring_index(text, "::", -1))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        fits = text.rlike(FORM) & F.when(text.contains("::"), missing >= 1).otherwise(missing == 0)
        return F.when(fits, F.transform(whole, lambda x: F.conv(x, 16, 10).cast("long")))

    return let(let(F.coalesce(ipv4_number(dotted), F.when(dotted == "", F.lit(0).cast("long"))), opened), parts)


def halves(parts: Column) -> tuple[Column, Column]:
    """The upper and the lower 64 bits of eight parts."""
    half = lambda k: reduce(lambda n, x: n.bitwiseOR(x), (F.shiftleft(F.get(parts, F.lit(k + j)), 48 - 16 * j) for j in range(4)))
    return half(0), half(4)


def within(parts: Column, prefixes: list[str]) -> Column:
    """Whether eight parts lie in one of the prefixes."""

    def told(x: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            net = ipaddress.IPv6Network(p)
            base, mask = int(net.network_address), int(net.netmask)
            same = x["high"].bitwiseAND(F.lit(_signed(mask >> 64))) == F.lit(_signed(base >> 64))
            if net.prefixlen > 64:
                same = same & (x["low"].bitwiseAND(F.lit(_signed(mask & (1 << 64) - 1))) == F.lit(_signed(base & (1 << 64) - 1)))
            out = out | same
        return out

    high, low = halves(parts)
    return let(F.struct(high.alias("high"), low.alias("low")), told)


def dotted(parts: Column, at: int) -> Column:
    """The IPv4 address in two of eight parts."""
    a, b = F.get(parts, F.lit(at)), F.get(parts, F.lit(at + 1))
    return F.concat_ws(".", *(x.cast("string") for x in (F.shiftright(a, 8), a.bitwiseAND(255), F.shiftright(b, 8), b.bitwiseAND(255))))


def mapped_ipv4(parts: Column) -> Column:
    """The IPv4 address that an IPv6 address stands for; null for others."""
    return F.when(within(parts, ["::ffff:0:0/96"]), dotted(parts, 6))


def _text(parts: Column, zone: Column) -> Column:
    plain = F.array_join(F.transform(parts, _hex), ":")

    def shortest(text: Column) -> Column:
        short = text
        for k in range(2, 9):
            row = rf"^(.*?)(?:^|:)0(?::0){{{k - 1}}}(?::|$)(.*)$"
            short = F.when(text.rlike(row), F.regexp_replace(text, row, "$1::$2")).otherwise(short)
        return short

    return F.concat(F.coalesce(F.concat(F.lit("::ffff:"), mapped_ipv4(parts)), let(plain, shortest)), zone)


def _private(parts: Column) -> Column:
    return F.coalesce(private_ipv4(mapped_ipv4(parts)), within(parts, PRIVATE) & ~within(parts, PUBLIC)) | within(parts, RESERVED)


def _blocked4(ip: Column) -> Column:
    return blocked_ipv4(ip) | ip.isin(*METADATA)


def _blocked(parts: Column) -> Column:
    inner = F.coalesce(mapped_ipv4(parts), F.when(within(parts, ["2002::/16"]), dotted(parts, 1)))
    own = (within(parts, PRIVATE) & ~within(parts, PUBLIC)) | within(parts, RESERVED) | within(parts, UNREACHABLE)
    return let(inner, lambda x: F.when(x.isNotNull(), _blocked4(x)).otherwise(own))


def _six(ip: Column, f) -> Column:
    """f(parts) of an IPv6 address; null for what is none."""
    return F.when(ip.contains(":"), let(hextets(ip), lambda p: F.when(p.isNotNull(), f(p))))


def normal_ip(ip: Column) -> Column:
    """An address in its shortest form: lower case, the first of the longest rows of zero parts as ::, mapped IPv4 with dots; null unless it is one."""
    v = F.trim(ip)
    return F.coalesce(F.when(ipv4_number(v).isNotNull(), v), _six(v, lambda p: _text(p, F.regexp_extract(v, "(%[^%]+)$", 1))))


def ip_version(ip: Column) -> Column:
    v = F.trim(ip)
    return F.when(ipv4_number(v).isNotNull(), 4).when(v.contains(":") & hextets(v).isNotNull(), 6)


def private_ip(ip: Column) -> Column:
    """Whether an address of either version is private, loopback, link-local or reserved; null if it is none."""
    v = F.trim(ip)
    return F.when(v.contains(":"), _six(v, _private)).otherwise(private_ipv4(v))


def blocked_ip(ip: Column) -> Column:
    """Whether an address must not be asked: what isn't of general use, metadata services, and what is no address. Brackets are left out, whole numbers are addresses.

    IPv4 addresses inside of mapped ones and of 2002::/16 are judged as such.
    """
    v = _unbracketed(ip)
    return F.coalesce(F.when(v.contains(":"), _six(v, _blocked)).otherwise(_blocked4(v)), F.lit(True))


def _unbracketed(ip: Column) -> Column:
    v = F.regexp_replace(F.trim(ip), r"^\[(.*)\]$", "$1")
    number = F.when(v.rlike("^[0-9]{1,10}$"), v.cast("long"))
    quad = F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
    return F.when(number < 2**32, quad).otherwise(v)


def judged(df: DataFrame, ip: str) -> DataFrame:
    """``df`` with normal, version, private and blocked for the addresses of a column, each of which is taken apart once."""
    v, p, four = F.col("_ip"), F.col("_parts"), ipv4_number(F.col("_ip"))
    staged = df.select("*", F.inline(F.array(F.struct(_unbracketed(F.col(ip)).alias("_ip")))))
    staged = staged.select("*", F.inline(F.array(F.struct(F.when(v.contains(":"), hextets(v)).alias("_parts")))))
    six = lambda f: F.when(p.isNotNull(), f)
    return staged.select(
        *df.columns,
        F.coalesce(F.when(four.isNotNull(), v), six(_text(p, F.regexp_extract(v, "(%[^%]+)$", 1)))).alias("normal"),
        F.when(four.isNotNull(), 4).when(p.isNotNull(), 6).alias("version"),
        F.coalesce(private_ipv4(v), six(_private(p))).alias("private"),
        F.coalesce(F.when(p.isNotNull(), _blocked(p)), F.when(~v.contains(":"), _blocked4(v)), F.lit(True)).alias("blocked"),
    )
