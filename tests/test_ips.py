"""IPv6 against Python's addresses: forms, ranges at both ends, what is no address."""

import ipaddress
import random

from pyspark.sql import functions as F

from attestor.functions import ips


def addresses():
    rng = random.Random(2)
    out = []
    for p in [*ips.PRIVATE, *ips.PUBLIC, *ips.RESERVED, *ips.UNREACHABLE, "::ffff:0:0/96", "2002:a00::/24", "2002:808::/32"]:
        net = ipaddress.IPv6Network(p)
        first, last = int(net.network_address), int(net.broadcast_address)
        out += [str(ipaddress.IPv6Address(n)) for n in (first, last, first - 1, last + 1) if 0 <= n < 1 << 128]
    for _ in range(400):
        n = ipaddress.IPv6Address(sum(rng.choice([0, 0, 0, 1, rng.randrange(1 << 16)]) << (16 * k) for k in range(8)))
        out += [n.exploded, n.exploded.upper(), n.compressed, ":".join(f"{int(x, 16):x}" for x in n.exploded.split(":"))]
    for n in ("10.1.2.3", "8.8.8.8", "100.100.100.200", "169.254.169.254", "224.0.0.1", "0.0.0.0"):
        out += [n, f"::ffff:{n}", f"::{n}", f"1:2:3:4:5:6:{n}", f"2002:{int(n.split('.')[0]):02x}{int(n.split('.')[1]):02x}:{int(n.split('.')[2]):02x}{int(n.split('.')[3]):02x}::1"]
    return [*out, "fe80::1%eth0", "[::1]", "2130706433", " ::1 ", "", "::", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "12345::", "g::", "1:", ":1", "::1.2.3", "::1.2.3.256", "1.2.3.4::", "::01.2.3.4", "::%", "fe80::1%a%b", "x", "1.2.3"]


def blocked_by_hand(raw):
    text = raw.strip()
    text = text[1:-1] if text.startswith("[") and text.endswith("]") else text
    try:
        ip = ipaddress.ip_address(int(text) if text.isdigit() else text)
    except ValueError:
        return True
    if ip.version == 6:
        ip = ip.ipv4_mapped or ip.sixtofour or ip
    general = not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified or getattr(ip, "is_site_local", False))
    return not general or str(ip) in ips.METADATA


def test_equal_to_python(spark):
    rows = addresses()
    df = spark.createDataFrame(list(enumerate(rows)), "k long, ip string").repartition(4)
    got = {r["k"]: r for r in df.select("k", ips.normal_ip(F.col("ip")).alias("n"), ips.ip_version(F.col("ip")).alias("v"), ips.private_ip(F.col("ip")).alias("p"), ips.blocked_ip(F.col("ip")).alias("b")).collect()}
    at_once = {r["k"]: r for r in ips.judged(df, "ip").collect()}
    for k, raw in enumerate(rows):
        try:
            ip = ipaddress.ip_address(raw.strip())
        except ValueError:
            ip = None
        private = None if ip is None else ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved
        assert (got[k]["n"], got[k]["v"]) == ((str(ip), ip.version) if ip else (None, None)), raw
        plain = raw.strip().isdigit() or "[" in raw  # which only the last rule takes for addresses
        assert plain or tuple(at_once[k])[2:] == tuple(got[k])[1:], raw
        assert got[k]["p"] == private and got[k]["b"] == blocked_by_hand(raw), raw


def test_null(spark):
    r = spark.createDataFrame([(None,)], "ip string").select(ips.normal_ip(F.col("ip")).alias("n"), ips.private_ip(F.col("ip")).alias("p"), ips.blocked_ip(F.col("ip")).alias("b")).first()
    assert tuple(r) == (None, None, True)
