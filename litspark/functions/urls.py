"""URL parts, and which URLs may be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PORTS = ("80", "443")
# IPv4 networks that are not public (address, prefix length).
SPECIAL_IPV4 = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("100.64.0.0", 10),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
)


#: The generic shape of a URL: scheme, authority, path, query, fragment.
SHAPE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = range(1, 6)


def url_part(url: Column, part: int) -> Column:
    """A part of a URL as it stands there, "" if missing; no URL is too odd to be taken apart."""
    return F.regexp_extract(url, SHAPE, part)


def _host(url: Column) -> Column:
    bare = F.regexp_replace(url_part(url, AUTHORITY), "(?s)^.*@", "")
    return F.lower(F.when(F.startswith(bare, F.lit("[")), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, "(?s):[^:]*$", "")))


def url_port(url: Column) -> Column:
    return F.regexp_extract(url_part(url, AUTHORITY), r":(\d+)$", 1)


def url_host(url: Column) -> Column:
    return F.coalesce(_host(url), F.lit(""))


def canonical_source_id(url: Column) -> Column:
    """scheme://host and path without a trailing slash, in lower case."""
    return F.lower(F.concat(url_part(url, SCHEME), F.lit("://"), url_host(url), F.regexp_replace(url_part(url, PATH), "/+$", "")))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ipv4_number(host: Column) -> Column:
    """The address of a host in any numeric form (parts decimal, octal or hex; the last fills what is left), else null."""

    def number(p: Column) -> Column:
        return F.when(p.rlike("^0x[0-9a-f]+$"), F.conv(F.substr(p, F.lit(3)), 16, 10)).when(p.rlike("^0[0-7]*$"), F.conv(p, 8, 10)).when(p.rlike("^[1-9][0-9]{0,10}$"), p).try_cast("long")

    def address(numbers: Column) -> Column:
        n = F.size(numbers)
        bound = F.element_at(F.array(*[F.lit(256 ** (5 - k)) for k in range(1, 5)]), F.least(n, F.lit(4)))
        rest = F.slice(numbers, 1, n - 1)
        fits = (n <= 4) & F.forall(numbers, lambda x: x.isNotNull()) & F.forall(rest, lambda x: x < 256) & (F.element_at(numbers, -1) < bound)
        return F.when(F.coalesce(fits, F.lit(False)), F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * bound + F.element_at(numbers, -1))

    return let(F.transform(F.split(host, r"\."), number), address)


def _ipv4_public(number: Column) -> Column:
    special = F.lit(False)
    for address, bits in SPECIAL_IPV4:
        low = int.from_bytes(bytes(map(int, address.split("."))), "big")
        special = special | number.between(low, low + (1 << 32 - bits) - 1)
    return ~special


def _ipv6_public(host: Column) -> Column:
    """Global unicast, 2000::/3, without its networks for protocols, documentation and 6to4."""
    group = lambda i: F.coalesce(F.conv(F.nullif(F.regexp_extract(host, r"^([0-9a-f]*):([0-9a-f]*)", i), F.lit("")), 16, 10).try_cast("int"), F.lit(0))
    a, b = group(1), group(2)
    inside = ((a == 0x2001) & ((b < 0x200) | (b == 0xDB8))) | (a == 0x2002) | ((a == 0x3FFF) & (b < 0x1000))
    return a.between(0x2000, 0x3FFF) & ~inside


def numeric_host_public(host: Column) -> Column:
    """Whether a numeric host is a public address; null for names."""
    return let(ipv4_number(host), lambda number: F.when(number.isNotNull(), _ipv4_public(number)).when(F.contains(host, F.lit(":")), _ipv6_public(host)))


def url_policy(url: Column, allow_list: list[str] | None = None) -> Column:
    """struct(allowed, reason): the first rule that a URL breaks, by its text alone (no name is looked up)."""
    allowed_hosts = [h.lower() for h in allow_list or []]
    authority = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.when(F.startswith(bare, F.lit("[")), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, ":[^:]*$", "")))
    parts = F.struct(
        F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"),
        F.contains(authority, F.lit("@")).alias("user"),
        F.regexp_extract(bare, r":([^:\]]*)$", 1).alias("port"),
        F.aggregate(F.array(*map(F.lit, range(3))), host, lambda h, _: F.coalesce(F.try_url_decode(h), h)).alias("host"),
    )

    def verdict(u: Column) -> Column:
        port, host = u["port"], u["host"]
        listed = host.isin(allowed_hosts) if allowed_hosts else F.lit(False)
        reason = (
            F.when(url.isNull() | ((port != "") & ~port.rlike("^[0-9]+$")), "unparseable URL")
            .when(~u["scheme"].isin("http", "https"), F.concat(F.lit("scheme '"), u["scheme"], F.lit("' not allowed")))
            .when(u["user"], "URLs with credentials are not allowed")
            .when(host == "", "missing host")
            .when((F.length(host) != F.octet_length(host)) & ~listed, "non-ASCII hostname blocked")
            .when((port != "") & ~port.isin(*PORTS), F.concat(F.lit("port "), port, F.lit(" not allowed")))
            .when(~F.coalesce(numeric_host_public(host), F.lit(True)), F.concat(F.lit("non-public numeric host "), host, F.lit(" blocked")))
            .when(host == "localhost", "localhost/loopback blocked")
            .when(host.rlike(r"\blocalhost\b") | F.endswith(host, F.lit(".local")), "local hostname blocked")
        )
        return let(reason, lambda r: F.struct(r.isNull().alias("allowed"), F.coalesce(r, F.when(listed, F.lit("explicit allow-list")).otherwise(F.lit("allowed"))).alias("reason")))

    return let(parts, verdict)
