"""Address ranges that must not be fetched, as columns: the first range that holds an address decides."""

from __future__ import annotations

import ipaddress
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (range, kind, category), in the order in which they are tried.
V4_RANGES = [
    ("0.0.0.0/8", "other", "unspecified"),
    ("10.0.0.0/8", "private", "private"),
    ("100.64.0.0/10", "other", "shared address space (CGNAT)"),
    ("127.0.0.0/8", "loopback", "loopback"),
    ("169.254.169.254/32", "other", "cloud metadata"),
    ("169.254.0.0/16", "other", "link-local"),
    ("172.16.0.0/12", "private", "private"),
    ("192.0.0.0/24", "other", "reserved"),
    ("192.0.2.0/24", "other", "documentation"),
    ("192.88.99.0/24", "other", "reserved"),
    ("192.168.0.0/16", "private", "private"),
    ("198.18.0.0/15", "other", "benchmarking"),
    ("198.51.100.0/24", "other", "documentation"),
    ("203.0.113.0/24", "other", "documentation"),
    ("224.0.0.0/4", "other", "multicast"),
    ("240.0.0.0/4", "other", "reserved"),
    ("168.63.129.16/32", "other", "cloud metadata"),
]
V6_RANGES = [
    ("::/128", "other", "unspecified"),
    ("::1/128", "loopback", "loopback"),
    ("fd00:ec2::254/128", "other", "cloud metadata"),
    ("fc00::/7", "other", "unique local"),
    ("fe80::/10", "other", "link-local"),
    ("fec0::/10", "other", "site-local"),
    ("ff00::/8", "other", "multicast"),
    ("100::/64", "other", "discard-only"),
    ("2001:db8::/32", "other", "documentation"),
    ("2001::/23", "other", "reserved (protocol assignments, Teredo)"),
    ("64:ff9b:1::/48", "other", "reserved (local-use NAT64)"),
    ("::/96", "other", "deprecated IPv4-compatible"),
    ("3fff::/20", "other", "documentation"),
    ("5f00::/16", "other", "reserved (SRv6 SIDs)"),
    ("100:0:0:1::/64", "other", "reserved (dummy prefix)"),
]
#: IPv6 ranges that carry an IPv4 address, and the bit at which it starts, from the right.
EMBEDDED_V4 = [("::ffff:0:0/96", 0), ("::ffff:0:0:0/96", 0), ("64:ff9b::/96", 0), ("2002::/16", 80)]

BLOCKED = "struct<kind: string, category: string>"


def _signed(n: int) -> int:
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


@cache
def _long(n: int) -> Column:
    """Constants and results are made once: a plan meets the ranges several times."""
    return F.lit(n).cast("long")


@cache
def _hit(kind: str, category: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(category).alias("category"))


def classify_v4(ip: Column) -> Column:
    """struct<kind, category> of an IPv4 address as a long, null for a public one."""
    nets = [(ipaddress.ip_network(r), k, c) for r, k, c in V4_RANGES]
    return F.coalesce(*(F.when(ip.bitwiseAND(_long(int(n.netmask))) == _long(int(n.network_address)), _hit(k, c)) for n, k, c in nets))


def _within(hi: Column, lo: Column, net: ipaddress.IPv6Network) -> Column:
    tests = []
    for word, shift in ((hi, 64), (lo, 0)):
        mask, value = _signed(int(net.netmask) >> shift), _signed(int(net.network_address) >> shift)
        if mask == -1:
            tests.append(word == _long(value))
        elif mask:
            tests.append(word.bitwiseAND(_long(mask)) == _long(value))
    return reduce(Column.__and__, tests)


def classify_v6(hi: Column, lo: Column) -> Column:
    """struct<kind, category> of an IPv6 address as two longs. Its own ranges come first; then an IPv4 address that it
    carries decides."""
    own = [F.when(_within(hi, lo, ipaddress.ip_network(r)), _hit(k, c)) for r, k, c in V6_RANGES]
    low32 = _long(0xFFFFFFFF)
    carried = F.coalesce(*(F.when(_within(hi, lo, ipaddress.ip_network(r)), (lo if at == 0 else F.shiftrightunsigned(hi, at - 64)).bitwiseAND(low32)) for r, at in EMBEDDED_V4))
    return F.coalesce(*own, classify_v4(carried))


def v4_text(ip: Column) -> Column:
    return F.concat_ws(".", *(F.shiftrightunsigned(ip, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)))


def v4_number(text: Column) -> Column:
    """The long of a dotted quad; null for anything else."""
    parts = F.split(text, r"\.")
    number = F.aggregate(F.transform(parts, lambda p: p.try_cast("long")), F.lit(0).cast("long"), lambda n, p: n * 256 + p)
    return F.when(text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def _v6_words(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        try:
            n = int(ipaddress.IPv6Address(t)) if t and "%" not in t else None
        except ValueError:
            n = None
        out.append((None, None) if n is None else (_signed(n >> 64), _signed(n)))
    return pd.DataFrame(out, columns=["hi", "lo"]).astype("Int64")


def v6_words(text: Column) -> Column:
    """struct<hi, lo> of an IPv6 address without brackets; nulls for anything else, zone ids too."""
    return F.pandas_udf(_v6_words, "hi long, lo long")(text)


def classify_text(text: Column) -> Column:
    """struct<kind, category> of an address as text, IPv4 or IPv6."""
    v6 = v6_words(F.when(text.contains(":"), text))
    return F.coalesce(classify_v4(v4_number(text)), classify_v6(v6["hi"], v6["lo"]))
