"""Queries over IPv6 addresses, written in several forms from the parts that orders give."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import ips

from .views import table

#: How the first part of an address comes about, in turn: general, private and reserved ranges.
FIRST = [0x2001, 0xFC12, 0xFE80, 0x2606, 0x2002, 0xFF02, 0x64, 0]


def _written(s, d):
    """Orders as addresses of eight parts, some of them zero, in one of five forms; the last is none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    first = F.element_at(F.array(*map(F.lit, FIRST)), (k % len(FIRST) + 1).cast("int")).cast("long")
    parts = F.array(first, F.when(c % 3 == 0, 0xDB8).otherwise(c % 5 * 4097), *(F.when(F.floor(k / 2**j) % 2 == 0, F.lit(0)).otherwise((k * (j + 3)) % 65536) for j in range(4)), c % 65536, k % 65536)
    o = table(s, d, "orders").select("o_orderkey", F.inline(F.array(F.struct(parts.cast("array<long>").alias("p")))))
    low = lambda x: F.lower(F.conv(x.cast("string"), 10, 16))
    plain = F.array_join(F.transform("p", low), ":")
    padded = F.array_join(F.transform("p", lambda x: F.upper(F.lpad(low(x), 4, "0"))), ":")
    quad = F.concat_ws(".", *(x.cast("string") for j in (6, 7) for x in (F.floor(F.col("p")[j] / 256), F.col("p")[j] % 256)))
    dotted = F.concat(F.array_join(F.transform(F.slice("p", 1, 6), low), ":"), F.lit(":"), quad)
    form = F.col("o_orderkey") % 5
    text = F.when(form == 0, padded).when(form == 1, plain).when(form == 2, dotted).when(form == 3, F.concat(F.lit(" "), F.regexp_replace(plain, r"^(.*?)(?:^|:)0(?::0)*(?::|$)", "$1::"))).otherwise(F.concat(plain, F.lit(":1")))
    return o.select("o_orderkey", text.alias("ip"))


def ipv6_forms(s, d):
    return ips.judged(_written(s, d), "ip").drop("ip")


#: Of the parts, not of the text: the longest row of zeros, and ranges by comparison of numbers.
SQL = f"""WITH a AS (SELECT o_orderkey, o_custkey, [{FIRST}[o_orderkey % {len(FIRST)} + 1], CASE WHEN o_custkey % 3 = 0 THEN 3512 ELSE o_custkey % 5 * 4097 END, {", ".join(f"CASE WHEN (o_orderkey // {2**j}) % 2 = 0 THEN 0 ELSE (o_orderkey * {j + 3}) % 65536 END" for j in range(4))}, o_custkey % 65536, o_orderkey % 65536]::BIGINT[] AS p FROM orders),
z AS (SELECT *, list_filter(list_transform(range(64), lambda i: {{s: i // 8 + 1, n: i % 8 + 1}}), lambda r: r.s + r.n <= 9 AND r.n >= 2 AND list_sum(p[r.s:r.s + r.n - 1]) = 0) AS rows_ FROM a),
b AS (SELECT *, list_reduce(rows_, lambda x, y: CASE WHEN y.n > x.n THEN y ELSE x END) AS r FROM z WHERE len(rows_) > 0 UNION ALL SELECT *, NULL FROM z WHERE len(rows_) = 0),
t AS (SELECT *, CASE WHEN r IS NULL THEN array_to_string(list_transform(p, lambda x: printf('%x', x)), ':') ELSE array_to_string(list_transform(p[:r.s - 1], lambda x: printf('%x', x)), ':') || '::' || array_to_string(list_transform(p[r.s + r.n:], lambda x: printf('%x', x)), ':') END AS normal,
  p[1] = 64512 + 18 OR p[1] BETWEEN 65152 AND 65215 OR (p[1] = 8193 AND p[2] < 512 AND NOT (p[2] = 3 OR p[2] BETWEEN 32 AND 63)) OR (p[1] = 8193 AND p[2] = 3512) OR p[1] = 8194 OR p[1] < 256 AS special,
  CASE WHEN p[1] = 8194 THEN (p[2] // 256 IN (0, 10, 127) OR p[2] // 256 >= 224 OR (p[2] = 43518) OR (p[2] // 256 = 172 AND p[2] % 256 BETWEEN 16 AND 31) OR p[2] = 49320) END AS inner_ FROM b)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN normal END AS normal, CASE WHEN o_orderkey % 5 < 4 THEN 6 END AS version, CASE WHEN o_orderkey % 5 < 4 THEN special END AS private, o_orderkey % 5 = 4 OR CASE WHEN inner_ IS NOT NULL THEN inner_ ELSE special OR p[1] >= 65280 END AS blocked FROM t"""

QUERIES = {"ipv6_forms": ipv6_forms}
ORACLES = {"ipv6_forms": SQL}
