"""Addresses of public repositories: which are taken, and what they stand for. Column builders, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _v4(host: Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    parts = F.split(host, r"\.")
    plain = host.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}\z")
    numbers = F.transform(parts, lambda p: p.try_cast("long"))
    small = F.forall(numbers, lambda n: n <= 255)
    return F.when(plain & small, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a * 256 + n))


# IPv4 ranges that are private, local, reserved, for tests or for many.
INNER_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def _inner_v4(number: Column) -> Column:
    hit = F.lit(False)
    for base, bits in INNER_V4:
        a, b, c, d = map(int, base.split("."))
        start = (a << 24) + (b << 16) + (c << 8) + d
        hit = hit | number.between(start, start + (1 << (32 - bits)) - 1)
    return hit


def inner_address(host: Column) -> Column:
    """Whether a host is an address that is private, local, reserved or for many, or a name of this machine.

    IPv6 is judged by its written start; of addresses under 64:ff9b:: that hold an IPv4
    address in dots or two groups, by that. Names are not resolved.
    """
    low = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
    v6 = F.contains(low, F.lit(":"))
    dotted = F.nullif(F.regexp_extract(low, r"^64:ff9b::(\d+\.\d+\.\d+\.\d+)\z", 1), F.lit(""))
    groups = [F.conv(F.regexp_extract(low, r"^64:ff9b::([0-9a-f]{1,4}):([0-9a-f]{1,4})\z", i), 16, 10).cast("long") for i in (1, 2)]
    embedded = F.coalesce(_v4(dotted), F.when(low.rlike(r"^64:ff9b::[0-9a-f]{1,4}:[0-9a-f]{1,4}\z"), groups[0] * 65536 + groups[1]))
    local_v6 = low.isin("::", "::1") | low.rlike(r"^(f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]|ff[0-9a-f]{2}|2001:db8):") | low.rlike(r"^::ffff:")
    named = low.isin("localhost", "localhost.localdomain")
    return F.coalesce(F.when(v6, F.when(embedded.isNotNull(), _inner_v4(embedded)).otherwise(local_v6)).otherwise(_inner_v4(_v4(low))), F.lit(False)) | named


def repository(url: Column, hosts: tuple[str, ...]) -> Column:
    """struct(problem, owner, name, identifier) of an address of a public repository on one of ``hosts``.

    ``problem`` is null if the address is taken: https, no user, one of the hosts, no
    other port than 443, and a path of an owner and a name, whose ".git" goes.
    """
    text = F.trim(url)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    path = F.filter(F.split(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    owner, raw = F.get(path, 0), F.get(path, 1)
    name = F.regexp_replace(raw, r"\.git\z", "")
    reserved = lambda c: c.isin(".", "..", "...", ".git")
    problem = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(scheme != "https", "scheme")
        .when(F.contains(authority, F.lit("@")), "credentials")
        .when(~host.isin(*hosts), "host")
        .when(~port.isin("", "443"), "port")
        .when(F.size(path) != 2, "path")
        .when(~owner.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9-]{0,38}\z") | reserved(owner), "owner")
        .when(~name.rlike(r"^[a-zA-Z0-9._\-]{1,100}\z") | reserved(name), "name")
    )
    fine = problem.isNull()
    return F.struct(problem.alias("problem"), F.when(fine, owner).alias("owner"), F.when(fine, name).alias("name"), F.when(fine, F.lower(F.concat(F.lit(hosts[0] + ":"), owner, F.lit("/"), name))).alias("identifier"))
