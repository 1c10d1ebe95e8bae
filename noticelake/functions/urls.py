"""URL expressions: identity, guards, platform keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import let

#: Query keys that carry no identity.
TRACKING = ["jsessionid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mode"]


ARTICLE = r"/bbs/[^/]+/\d+/\d+/artclView\.do"
EVENT_TAB = r"^(/competitions/(?:official|open)/\d+).*$"
#: Addresses that are canonical as they stand: a host in lower case and a path of plain signs, without a query, a fragment, a session or the tabs of an event.
CANONICAL = r"^https?://[a-z0-9.:-]+/(?!competitions/)[A-Za-z0-9_.~%!$'()*+,:@=/-]*\z"


def _unwrapped(url: Column) -> Column:
    """The article address that a board wraps in a base64 `enc` value, else the address itself."""
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    wrapped = F.regexp_extract(url, r"[?&]enc=([A-Za-z0-9+/%_-]+=*)", 1)
    plain = F.try_to_binary(F.regexp_replace(F.regexp_replace(wrapped, "%2B", "+"), "%3D|=", ""), F.lit("base64")).cast("string")
    inner = F.try_url_decode(F.element_at(F.split(plain, r"\|@@\|"), -1))
    return F.when((wrapped != "") & inner.rlike("^/") & inner.contains("/bbs/") & inner.contains("artclView.do"), F.concat(origin, inner)).otherwise(url)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, tracking keys dropped, query pairs sorted, no fragment or session path; '' for what is no public web address.

    Wrapped article addresses are unwrapped, a layout key of an article is dropped, and the tabs of one event are one address. An address that `CANONICAL` shows to be canonical is not taken apart.
    """

    def parts(trimmed: Column) -> Column:
        head = F.regexp_extract(trimmed, r"^(?i:(https?))://([^/?#@]+)", 0)
        scheme = F.lower(F.regexp_extract(trimmed, r"^(?i:(https?))://", 1))
        host = F.lower(F.regexp_extract(trimmed, r"^(?i:https?)://([^/?#]+)", 1))
        rest = F.regexp_replace(F.regexp_replace(trimmed, r"^(?i:https?)://[^/?#]+", ""), r"#.*$", "")
        return F.struct(head.alias("head"), scheme.alias("scheme"), host.alias("host"), rest.alias("rest"), trimmed.rlike(r'[\x00-\x20<>"\\]').alias("odd"))

    def split(x: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["rest"], r"\?.*$", ""), r"(?i);jsessionid=[^/?;]*", ""), EVENT_TAB, "$1/overview/")
        query = F.when(x["rest"].contains("?"), F.regexp_replace(x["rest"], r"^[^?]*\?", "")).otherwise("")
        return F.struct(path.alias("path"), query.alias("query"))

    def kept(x: Column) -> Column:
        key = lambda pair: F.lower(F.split(pair, "=")[0])
        pairs = F.filter(F.split(x["query"], "&"), lambda p: (p != "") & ~key(p).isin(TRACKING) & ~key(p).startswith("utm_") & ~(x["path"].rlike(ARTICLE) & (key(p) == "layout")))
        return F.concat(F.when(x["path"] == "", "/").otherwise(x["path"]), let(F.array_sort(pairs), lambda own: F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise("")))

    def whole(x: Column) -> Column:
        valid = (x["head"] != "") & ~x["host"].contains("@") & ~x["odd"]
        return F.when(valid, F.concat(x["scheme"], F.lit("://"), x["host"], let(split(x), kept))).otherwise("")

    return F.when(url.rlike(CANONICAL), url).otherwise(let(let(F.trim(_unwrapped(F.trim(url))), parts), whole))


def url_id(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(20))


def _number(octets: Column) -> Column:
    """The 32 bits of an address in four parts; null for what is none."""
    parts = F.transform(F.split(octets, r"\."), lambda x: x.cast("long"))
    valid = octets.rlike(r"^(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])(?:\.(?!$)|$)){4}$")
    return F.when(valid, F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x))


def public_url(url: Column) -> Column:
    """Whether an address is https, without user, on the default port, not too long, and leads to a host of the public network.

    Hosts without a dot, with an inner ending, and numeric ones that are no public address are refused, as are addresses with blanks, quotes, brackets or backslashes.
    """
    authority = F.regexp_extract(url, r"^(?i:https)://([^/?#]+)", 1)
    ending = lambda host: reduce(Column.__or__, [host.endswith(x) for x in P.INNER_HOSTS])

    def outside(host: Column, number: Column) -> Column:
        """Whether a numeric host is a public address."""
        inner = F.lit(False)
        for first, bits in P.INNER_NETWORKS:
            low = sum(int(x) << shift for x, shift in zip(first.split("."), (24, 16, 8, 0)))
            inner = inner | number.between(low, low + (1 << (32 - bits)) - 1)
        return number.isNotNull() & (~inner | host.isin(*P.PUBLIC_INSIDE))

    def reachable(host: Column) -> Column:
        named = (host != "") & ~host.contains("@") & ~host.contains(":") & host.contains(".") & ~ending(host)
        return named & F.when(host.rlike(r"^[\d.]+$"), let(_number(host), lambda number: outside(host, number))).otherwise(True)

    spelled = (F.length(url) <= P.MAX_ADDRESS) & ~url.rlike(r'[\s\\<>"\x00-\x1f]')
    return F.coalesce(spelled & let(F.lower(F.regexp_replace(authority, r":(?:443)?$", "")), reachable), F.lit(False))


def platform_key(url: Column) -> Column:
    """site:kind of an address whose first path step is a known kind of page, else ''."""
    host = F.regexp_extract(url, r"^https?://([^/?#]+)", 1)
    step = F.regexp_extract(url, r"^https?://[^/?#]+/([^/?#]+)/([^/?#]+)", 1)
    name = F.regexp_extract(url, r"^https?://[^/?#]+/([^/?#]+)/([^/?#]+)", 2)
    return F.when((step != "") & (name != ""), F.concat_ws(":", host, step, name)).otherwise("")
