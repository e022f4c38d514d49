"""Classes of IP addresses. IPv4 is arithmetic on Columns; IPv6 literals are parsed in an Arrow function (128 bits)."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Address blocks and their classes, in the order in which they are tried.
IPV4_BLOCKS = (
    ("0.0.0.0/8", "UNSPECIFIED"), ("10.0.0.0/8", "PRIVATE"), ("172.16.0.0/12", "PRIVATE"), ("192.168.0.0/16", "PRIVATE"), ("127.0.0.0/8", "LOOPBACK"),
    ("169.254.0.0/16", "LINK_LOCAL"), ("100.64.0.0/10", "PRIVATE"), ("192.0.0.0/24", "RESERVED"), ("192.0.2.0/24", "RESERVED"), ("198.18.0.0/15", "RESERVED"),
    ("198.51.100.0/24", "RESERVED"), ("203.0.113.0/24", "RESERVED"), ("224.0.0.0/4", "MULTICAST"), ("240.0.0.0/4", "RESERVED"),
)
IPV6_BLOCKS = (
    ("::/128", "UNSPECIFIED"), ("::1/128", "LOOPBACK"), ("::ffff:0:0/96", "V4:0"), ("64:ff9b::/96", "V4:0"), ("2002::/16", "V4:80"), ("2001::/32", "RESERVED"), ("2001:db8::/32", "RESERVED"),
    ("fe80::/10", "LINK_LOCAL"), ("fc00::/7", "PRIVATE"), ("ff00::/8", "MULTICAST"), ("::/32", "RESERVED"),
)
PUBLIC = "PUBLIC"


def ipv4_class(number: Column) -> Column:
    """Class of an address given as a number from 0 to 2^32 - 1."""
    out = None
    for block, name in IPV4_BLOCKS:
        net = ipaddress.ip_network(block)
        hit = F.shiftright(number, 32 - net.prefixlen) == (int(net.network_address) >> (32 - net.prefixlen))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(PUBLIC)


def ipv4_number(text: Column) -> Column:
    """The number of a dotted quad, or null."""
    parts = F.split(text, r"\.")
    fine = text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    n = F.aggregate(F.when(fine, parts), F.lit(0).cast("bigint"), lambda a, p: a * 256 + p.cast("bigint"))
    return F.when(fine & F.forall(F.when(fine, parts), lambda p: p.cast("int") <= 255), n)


def classify(literal: str | None) -> str | None:
    """Class of one address literal; null for what is none."""
    try:
        address = ipaddress.ip_address((literal or "").strip("[]").split("%")[0])
    except ValueError:
        return None
    blocks = IPV4_BLOCKS if address.version == 4 else IPV6_BLOCKS
    for block, name in blocks:
        if address in ipaddress.ip_network(block):
            return classify(str(ipaddress.IPv4Address((int(address) >> int(name[3:])) & 0xFFFFFFFF))) if name.startswith("V4:") else name
    return PUBLIC


@F.pandas_udf(T.StringType())
def address_class(literals: pd.Series) -> pd.Series:
    return literals.map(classify)


def dns_outcome(classes: Column) -> Column:
    """Of the classes of all answers: no answer fails, one that is not public blocks, null passes."""
    return F.when(F.coalesce(F.size(classes), F.lit(0)) <= 0, "NETWORK_ERROR").when(F.exists(classes, lambda c: c != PUBLIC), "SECURITY_BLOCKED")
