"""Which URLs are safe to fetch: a public host, told by intervals of addresses, as Spark expressions. Nothing is looked up."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: address blocks that aren't globally routable, and blocks within them that are (IANA's registries)
IPV4_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
IPV4_GLOBAL = ("192.0.0.9/32", "192.0.0.10/32")
IPV6_BLOCKS = ("::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
IPV6_GLOBAL = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
SCHEMES = ("http", "https")


def intervals(blocks: tuple[str, ...], without: tuple[str, ...]) -> list[tuple[str, str]]:
    """Disjoint intervals of the blocks without some others, in order, as hexadecimal digits of full length."""
    nets = [ipaddress.ip_network(b) for b in blocks]
    width = nets[0].max_prefixlen // 4
    ends = lambda n: (int(n.network_address), int(n.broadcast_address))
    merged: list[list[int]] = []
    for first, last in sorted(map(ends, nets)):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    for first, last in sorted(ends(ipaddress.ip_network(b)) for b in without):
        merged = [part for a, b in merged for part in (([a, b],) if last < a or first > b else ([a, first - 1], [last + 1, b])) if part[0] <= part[1]]
    return [(f"{a:0{width}x}", f"{b:0{width}x}") for a, b in merged]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _within(digits: Column, table: list[tuple[str, str]]) -> Column:
    """Whether digits lie in one of the intervals, null for null: the table is a constant, searched by one small lambda."""
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in table])
    return let(digits, lambda d: F.when(d.isNotNull(), F.exists(rows, lambda r: (d >= r["a"]) & (d <= r["b"]))))


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and brackets; null without one or with broken brackets."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    place = F.nullif(F.regexp_extract(clean, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))
    after = F.regexp_extract(place, r"(?s)^(?:.*@)?([^@]*)$", 1)
    boxed = F.regexp_extract(after, r"^\[([^\[\]]*)\](?::.*)?$", 1)
    plain = F.when(~after.rlike(r"[\[\]]"), F.regexp_extract(after, r"^([^:]*)", 1)).otherwise(boxed)
    host = F.when(place.rlike(r"[\[\]]") & (boxed == ""), F.lit(None)).otherwise(plain)
    return F.lower(F.nullif(host, F.lit("")))


def url_scheme(url: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return F.lower(F.nullif(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit("")))


def ipv4_digits(host: Column) -> Column:
    """Eight hexadecimal digits of an IPv4 address as resolvers read it: one to four numbers, decimal, octal or hexadecimal, the last
    of which fills what is left; null for any other text."""
    shape = host.rlike(r"^(0x[0-9a-f]{1,8}|[0-9]{1,12})(\.(0x[0-9a-f]{1,8}|[0-9]{1,12})){0,3}$")

    def number(p: Column) -> Column:
        bare = F.substr(p, F.lit(3))
        return F.when(F.startswith(p, F.lit("0x")), F.conv(bare, 16, 10)).when(p.rlike("^0[0-7]*$"), F.conv(p, 8, 10)).when(p.rlike("^[1-9]"), p).cast("long")

    def digits(numbers: Column) -> Column:
        n = F.size(numbers)
        last = F.element_at(numbers, -1)
        head = F.slice(numbers, F.lit(1), n - 1)
        fits = ~F.exists(numbers, lambda x: x.isNull()) & ~F.exists(head, lambda x: x > 255) & (last < F.pow(F.lit(256), 5 - n).cast("long"))
        lead = F.array_join(F.transform(head, lambda x: F.lpad(F.hex(x), 2, "0")), "")
        return F.when(fits, F.lower(F.concat(lead, F.lpad(F.hex(last), F.lit(8) - 2 * (n - 1), F.lit("0")))))

    return F.when(shape, let(F.transform(F.split(host, r"\."), number), digits))


def ipv6_digits(host: Column) -> Column:
    """Thirty-two hexadecimal digits of an IPv6 address, its last four bytes dotted or not, a zone left aside; null for any other text."""
    group = "[0-9a-f]{1,4}"
    quads = r"^[0-9a-f:]*:((?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4})$"

    def plain(bare: Column, quad: Column) -> Column:
        """The last four bytes as two groups."""
        front = F.substr(bare, F.lit(1), F.length(bare) - F.length(quad))
        return F.when(quad == "", bare).otherwise(let(ipv4_digits(quad), lambda d: F.concat(front, F.substr(d, F.lit(1), F.lit(4)), F.lit(":"), F.substr(d, F.lit(5), F.lit(4)))))

    def padded(side: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")), "")

    def digits(text: Column) -> Column:
        short = text.rlike(rf"^(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?$")
        full = text.rlike(rf"^{group}(?::{group}){{7}}$")
        filled = let(F.transform(F.split(text, "::"), padded), lambda s: let(32 - F.length(s[0]) - F.length(s[1]), lambda room: F.when(room >= 4, F.concat(s[0], F.repeat(F.lit("0"), room), s[1]))))
        return F.when(full, padded(text)).when(short, filled)

    whole = let(F.regexp_replace(F.lower(host), r"%.+$", ""), lambda bare: let(F.regexp_extract(bare, quads, 1), lambda quad: plain(bare, quad)))
    return let(whole, digits)


def is_global(address: Column) -> Column:
    """Whether a literal address is globally routable; null for what is no address."""
    mapped = "0" * 20 + "ffff"

    def judged(four: Column, six: Column) -> Column:
        inner = F.coalesce(four, F.when(F.startswith(six, F.lit(mapped)), F.substr(six, F.lit(25))))
        public4, public6 = ~_within(inner, intervals(IPV4_BLOCKS, IPV4_GLOBAL)), ~_within(six, intervals(IPV6_BLOCKS, IPV6_GLOBAL))
        return F.when(inner.isNotNull(), public4).otherwise(public6)

    return let(F.struct(ipv4_digits(F.lower(address)).alias("four"), ipv6_digits(address).alias("six")), lambda d: judged(d["four"], d["six"]))


def safe_url(url: Column) -> Column:
    """Whether a URL is safe by itself: false for another scheme, without a host or with an address that isn't global, true with a
    global one, and null for a name, which only its addresses can tell."""
    named = F.coalesce(url_scheme(url).isin(list(SCHEMES)), F.lit(False))
    return let(F.when(named, url_host(url)), lambda host: F.when(host.isNull(), F.lit(False)).otherwise(is_global(host)))


def safe_urls(urls: DataFrame, addresses: DataFrame) -> DataFrame:
    """Rows of ``urls`` (url) with ``safe``: names are safe if ``addresses`` (host, address) has some of theirs and all are global.

    An address that can't be read isn't global; a host counts in any case. Null URLs are unsafe.
    """
    ok = F.coalesce(is_global(F.col("address")), F.lit(False))
    hosts = addresses.groupBy(F.lower("host").alias("_host")).agg(F.bool_and(ok).alias("_ok"))
    rows = urls.withColumns({"_own": safe_url(F.col("url")), "_of": url_host(F.col("url"))})
    joined = rows.join(hosts, rows["_own"].isNull() & (rows["_of"] == hosts["_host"]), "left")
    return joined.withColumn("safe", F.coalesce("_own", "_ok", F.lit(False))).select(*urls.columns, "safe")
