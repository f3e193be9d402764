"""Internet addresses as column expressions: canonical forms, and ranges searched by their starts.

An address is a string of 33 characters that sorts as a number: its version, 4 or 6, and 128 bits in hexadecimal (those of
IPv4 as mapped into IPv6). Hosts come in all forms that resolvers take without asking anyone: IPv4 of one to four parts,
each decimal, octal or hexadecimal, and IPv6 with `::`, with an IPv4 tail, with a zone.
"""

from __future__ import annotations

from functools import lru_cache
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks that no page may be read from: private, loopback, link-local, reserved, multicast and unspecified ones, by the
#: registries of special-purpose addresses (fixed values).
INTERNAL_NETWORKS = """
0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15
198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4
::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 2001::/23 2001:db8::/32 2002::/16 4000::/3 6000::/3 8000::/3 a000::/3
c000::/3 e000::/4 f000::/5 f800::/6 fc00::/7 fe00::/9 fe80::/10 ff00::/8
""".split()

#: Networks within those that are public (fixed values).
PUBLIC_NETWORKS = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()

#: The 96 bits before an IPv4 address.
_MAPPED = "0" * 20 + "f" * 4


def _number(part: Column) -> Column:
    """A decimal, octal or hexadecimal part of an IPv4 address; null if it is none or passes 32 bits."""
    digits = lambda prefix, most: F.regexp_extract(part, f"^{prefix}0*([0-9a-f]{{0,{most}}})$", 1)
    read = lambda d, base: F.when(d == "", 0).otherwise(F.conv(d, base, 10).cast("bigint"))
    return (
        F.when(part.rlike("^0x0*[0-9a-f]{0,8}$"), read(digits("0x", 8), 16))
        .when(part.rlike("^0+[0-7]{0,11}$"), read(digits("0", 11), 8))
        .when(part.rlike("^[1-9][0-9]{0,9}$"), part.cast("bigint"))
    )


def bound(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def ipv4(host: Column) -> Column:
    """The number of an IPv4 address in any of its forms; null if the host is none."""

    def value(parts: Column) -> Column:
        count, last = F.size(parts), F.element_at(parts, -1)
        ahead = F.slice(parts, 1, count - 1)
        fits = ~F.exists(parts, lambda p: p.isNull()) & ~F.exists(ahead, lambda p: p > 255) & (last < F.call_function("shiftleft", F.lit(1).cast("bigint"), 8 * (5 - count)))
        placed = F.transform(ahead, lambda p, i: p * F.call_function("shiftleft", F.lit(1).cast("bigint"), 24 - 8 * i))
        return F.when(fits, F.aggregate(placed, last, lambda x, y: x + y))

    numeric = F.regexp_extract(host, r"^([0-9][0-9a-fx]*(?:\.[0-9][0-9a-fx]*){0,3})\.?$", 1)
    return bound(numeric, lambda n: F.when(n != "", bound(F.transform(F.split(n, r"\."), _number), value)))


def _groups(text: Column) -> Column:
    """The groups of one side of `::`, each of four digits."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, ":"), lambda g: F.lpad(g, 4, "0")))


def ipv6(text: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; null if it is none."""
    quad = r"((?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3})$"

    def without_tail(plain: Column) -> Column:
        digits = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")
        colons = lambda d: F.concat(F.regexp_replace(plain, quad, ""), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4))
        return F.when(plain.contains("."), bound(digits(ipv4(F.regexp_extract(plain, quad, 1))), colons)).otherwise(plain)

    def from_sides(whole: Column, sides: Column) -> Column:
        left, right = _groups(F.get(sides, F.lit(0))), _groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        both = F.struct(left.alias("left"), right.alias("right"))

        def filled(s: Column) -> Column:
            count = F.size(s["left"]) + F.size(s["right"])
            formed = ~F.exists(F.concat(s["left"], s["right"]), lambda g: ~g.rlike("^[0-9a-f]{4}$")) & ~whole.rlike("[0-9a-f]{5}|^:[^:]|[^:]:$|:::")
            fits = F.when(F.size(sides) == 2, count < 8).otherwise((F.size(sides) == 1) & (count == 8))
            zeros = F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - count))
            return F.when(formed & fits, F.array_join(F.concat(s["left"], zeros, s["right"]), ""))

        return F.when(whole != "", bound(both, filled))

    plain = F.regexp_replace(F.lower(text), "%.*$", "")
    return bound(bound(plain, without_tail), lambda whole: bound(F.split(whole, "::", 3), lambda sides: from_sides(whole, sides)))


def address(host: Column) -> Column:
    """The canonical address of a host as it stands in a URL (IPv6 in brackets); null for names."""
    four = lambda n: F.concat(F.lit("4" + _MAPPED), F.lpad(F.lower(F.hex(n)), 8, "0"))
    six = F.concat(F.lit("6"), ipv6(F.regexp_extract(host, r"^\[(.*)\]$", 1)))
    return F.when(host.startswith("["), six).otherwise(bound(ipv4(F.lower(host)), four))


def canonical(version: int, number: int) -> str:
    """The canonical form of an address that is known by its number."""
    return f"{version}{number + (0xFFFF << 32 if version == 4 else 0):032x}"


@lru_cache
def disjoint(networks: tuple[str, ...], without: tuple[str, ...] = ()) -> tuple[tuple[str, str], ...]:
    """Sorted ranges (first, last), none touching another, that hold the addresses of `networks` but not those of `without`."""
    steps: dict[tuple[int, int], list[int]] = {}
    for k, names in enumerate((networks, without)):
        for network in map(ip_network, names):
            low, high = int(network.network_address), int(network.broadcast_address) + 1
            steps.setdefault((network.version, low), [0, 0])[k] += 1
            steps.setdefault((network.version, high), [0, 0])[k] -= 1
    out, inside, begun = [], [0, 0], None
    for (version, at), change in sorted(steps.items()):
        inside = [a + b for a, b in zip(inside, change, strict=True)]
        held = inside[0] > 0 and inside[1] == 0
        if held and begun is None:
            begun = at
        elif not held and begun is not None:
            out.append((canonical(version, begun), canonical(version, at - 1)))
            begun = None
    return tuple(out)


def in_ranges(value: Column, ranges: tuple[tuple[str, str], ...]) -> Column:
    """Whether a value lies in one of the sorted, disjoint ranges: the last start not after it is found by halving."""
    if not ranges:
        return F.lit(False)
    if len(ranges) == 1:
        return value.between(*ranges[0])
    half = len(ranges) // 2
    return F.when(value < ranges[half][0], in_ranges(value, ranges[:half])).otherwise(in_ranges(value, ranges[half:]))


def internal(address: Column) -> Column:
    """Whether a canonical address is one that no page may be read from; false for null."""
    ranges = disjoint(tuple(INTERNAL_NETWORKS), tuple(PUBLIC_NETWORKS))
    return bound(address, lambda a: F.when(a.isNotNull(), in_ranges(a, ranges)).otherwise(False))
