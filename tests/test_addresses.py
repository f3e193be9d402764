"""Addresses in all their forms against Python's ipaddress."""

from __future__ import annotations

import ipaddress
import random
import socket

from pyspark.sql import functions as F

from gleanwise.functions import addresses, urls


def inside(ip):
    return bool(ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


def forms(ip):
    """An address as a URL may hold it."""
    if ip.version == 6:
        return [f"[{h}]" for h in (str(ip), ip.exploded, str(ip).upper(), f"{ip}%eth0")]
    v, (a, b, c, d) = int(ip), ip.packed
    out = [str(ip), str(v), hex(v), "0" + oct(v)[2:], f"{a}.{b * 65536 + c * 256 + d}", f"{a}.{b}.{c * 256 + d}", f"0x{a:x}.0{b:o}.{c}.{d}", f"0X{v:08X}"]
    assert all(socket.inet_aton(h) == ip.packed for h in out)
    return out


def test_addresses_against_ipaddress(spark):
    r = random.Random(1)
    rows: list[tuple[str, bool | None]] = []
    for name in addresses.INTERNAL_NETWORKS + addresses.PUBLIC_NETWORKS + ["8.8.8.0/24", "100.64.0.0/10", "2606:4700::/32", "fec0::/10"]:
        net = ipaddress.ip_network(name)
        for edge in (int(net.network_address), int(net.broadcast_address)):
            for k in (-2, -1, 0, 1, 2, r.getrandbits(20)):
                if 0 <= edge + k < 1 << net.max_prefixlen:
                    ip = type(net.network_address)(edge + k)
                    rows += [(h, inside(ip)) for h in forms(ip)]
                    if ip.version == 4:
                        a, b, c, d = ip.packed
                        rows += [(f"[{m}]", inside(ipaddress.ip_address(m))) for m in (f"::ffff:{ip}", f"::ffff:{a:x}{b:02x}:{c:x}{d:02x}")]
    for _ in range(1000):
        ip = ipaddress.IPv6Address(r.getrandbits(128) & r.choice([-1, ~((1 << 64) - 1), ~(((1 << 48) - 1) << 32)]) & ((1 << 128) - 1))
        rows += [(f"[{ip}]", inside(ip)), (str(v4 := ipaddress.IPv4Address(r.getrandbits(32))), inside(v4))]
    rows += [(h, False) for h in ("example.org", "1.2.3.4.5", "256.1.1.1", "1.2.3.256", "4294967296", "0x1ffffffff", "08.1.1.1", "1..2", "a.b", "0xg", "1.2.3.65536x")]
    rows += [(f"[{h}]", None) for h in ("", ":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "::g", "::1.2.3", "::1.2.3.256", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7:8::")]
    own = F.struct("h", "want")
    df = spark.createDataFrame(rows, "h string, want boolean").select(own.alias("r"), addresses.address(F.col("h")).alias("a"), urls.url_policy(F.concat(F.lit("http://u:p@"), "h", F.lit(":80/x"))).alias("reason"))
    for r in df.select("r", "a", "reason", addresses.internal(F.col("a")).alias("inside")).collect():
        if r["r"]["want"] is None:
            assert (r["a"], r["reason"]) == (None, "no host"), r
        else:
            assert (r["inside"], r["reason"]) == (r["r"]["want"], "internal" if r["r"]["want"] else ""), r


def test_disjoint_ranges():
    nets = ("10.0.0.0/8", "10.1.0.0/16", "11.0.0.0/8", "0.0.0.0/32", "255.255.255.255/32", "::/0")
    assert addresses.disjoint(nets, ("10.0.0.0/32",)) == tuple(
        (addresses.canonical(v, a), addresses.canonical(v, b)) for v, a, b in ((4, 0, 0), (4, (10 << 24) + 1, (12 << 24) - 1), (4, (1 << 32) - 1, (1 << 32) - 1), (6, 0, (1 << 128) - 1))
    )
    assert addresses.disjoint(()) == ()


def test_same_address_same_form(spark):
    rows = spark.createDataFrame([("2130706433",), ("127.1",), ("0x7f.0.0.1",), ("127.0.0.1.",), ("0177.0.1",)], "h string")
    assert rows.select(addresses.address(F.col("h")).alias("a")).distinct().count() == 1
    assert spark.range(1).select(addresses.address(F.lit(None).cast("string")).alias("a")).first()["a"] is None
