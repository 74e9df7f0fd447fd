"""URL expressions built from one splitting pattern, because lenient input must not fail a job."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from listing_radar.fixed_values import (
    LOCAL_HOSTS,
    LOCAL_SUFFIXES,
    PUBLIC_ADMIN_HOSTS,
    TRACKING_PARAMETERS,
    TRACKING_PREFIX,
)
from listing_radar.functions.text import let

_SPLIT = r"(?s)^([hH][tT][tT][pP][sS]?)://([^/?#\\]+)([^?#]*)(\?[^#]*)?(#.*)?$"
_NOT_ALLOWED = r"[^A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(c), _SPLIT, group)


def _parts(c: Column) -> Column:
    """[_, scheme, authority, path, query] from one pass over the URL; a single element if it is none."""
    mark = "\u0001"
    return F.split(F.regexp_replace(F.trim(c), _SPLIT, mark + mark.join(("$1", "$2", "$3", "$4"))), mark)


def _host(authority: Column) -> Column:
    return F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", ""))


def is_http_url(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(_SPLIT), F.lit(False))


def is_https_url(c: Column) -> Column:
    return F.lower(_part(c, 1)) == "https"


def is_absolute_url(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]+|[^/]).*$"), F.lit(False))


def host_of(c: Column) -> Column:
    """Lower-case host without user and port; '' if the value is not an http(s) URL."""
    return _host(_part(c, 2))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def domain_of(c: Column) -> Column:
    """Host without ``www.`` of an https URL, else null."""
    return F.when(is_https_url(c), strip_www(host_of(c)))


def path_of(c: Column) -> Column:
    return F.regexp_replace(_part(c, 3), "^$", "/")


def path_and_query(c: Column) -> Column:
    return F.concat(path_of(c), _part(c, 4))


def _escape(c: Column, pattern: str) -> Column:
    """Percent-encode the characters that match ``pattern``; untouched (and cheap) if there is none."""
    def encode(char: Column) -> Column:
        return F.when(char.rlike(pattern), F.replace(F.url_encode(char), F.lit("+"), F.lit("%20"))).otherwise(char)

    def every(text: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), encode)
        return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)

    return let(c, every)


def escape_data(c: Column) -> Column:
    """Percent-encode everything but unreserved characters."""
    encoded = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def unescape_data(c: Column) -> Column:
    """Undo percent-encoding; ``+`` is kept and a malformed value stays as it is."""
    return F.when(
        c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    ).otherwise(c)


def _remove_dots(c: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        return (
            F.when(part == ".", acc)
            .when(part == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
            .otherwise(F.concat(acc, F.array(part)))
        )

    def fold(path: Column) -> Column:
        folded = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
        folded = F.concat(folded, F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
        folded = F.regexp_replace(folded, r"^(?!/)", "/")
        return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), folded).otherwise(path)

    return let(c, fold)


def _clean_query(raw: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(F.regexp_replace(raw, r"^\?+", ""), "&"), lambda s: s != ""),
        lambda s: F.struct(
            unescape_data(F.regexp_extract(s, r"(?s)^([^=]*)", 1)).alias("k"),
            unescape_data(F.regexp_extract(s, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["k"]).startswith(TRACKING_PREFIX) & ~F.lower(p["k"]).isin(TRACKING_PARAMETERS),
    )
    query = F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(escape_data(p["k"]), F.lit("="), escape_data(p["v"]))), "&"
    )
    return F.when(raw == "", F.lit("")).otherwise(F.regexp_replace(query, r"(?s)^(.+)$", "?$1"))


def normalize_url(c: Column) -> Column:
    """One spelling per page: https, lower host, no port, fragment, trailing slash or tracking keys."""
    def build(p: Column) -> Column:
        path = F.rtrim(_escape(_remove_dots(p[3]), _NOT_ALLOWED), F.lit("/"))
        return F.concat(F.lit("https://"), _host(p[2]), F.regexp_replace(path, "^$", "/"), _clean_query(p[4]))

    return let(_parts(c), lambda p: F.when(F.size(p) == 5, build(p)).otherwise(F.trim(c)))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on ``base``; '' unless it is http(s)."""
    def absolute(link: Column) -> Column:
        return _escape(F.regexp_replace(link, r"(?s)^([A-Za-z]+://[^/?#]+)$", "$1/"), _NOT_ALLOWED)

    def relative(p: Column, link: Column) -> Column:
        origin = F.concat(F.lower(p[1]), F.lit("://"), F.lower(p[2]))
        page = F.concat(origin, F.regexp_replace(p[3], "^$", "/"))
        target = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
        rest = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
        folder = F.regexp_replace(F.regexp_replace(p[3], "^$", "/"), r"[^/]*$", "")
        path = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
        return (
            F.when(link.startswith("//"), F.concat(F.lower(p[1]), F.lit(":"), link))
            .when(link == "", F.concat(page, p[4]))
            .when(link.startswith("#"), F.concat(page, p[4], link))
            .when(link.startswith("?"), F.concat(page, link))
            .otherwise(F.concat(origin, _remove_dots(path), rest))
        )

    def resolve(p: Column, link: Column) -> Column:
        return (
            F.when(is_http_url(link), absolute(link))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (F.size(p) != 5), F.lit(""))
            .otherwise(_escape(relative(p, link), _NOT_ALLOWED))
        )

    return let(F.trim(F.coalesce(href, F.lit(""))), lambda link: let(_parts(base), lambda p: resolve(p, link)))


def strip_query(c: Column) -> Column:
    return F.concat(F.lower(_part(c, 1)), F.lit("://"), F.lower(_part(c, 2)), path_of(c))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: turns 'equal or sub-domain of' into equality."""
    return let(
        F.split(F.rtrim(host, F.lit(".")), r"\."),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
        ),
    )


def host_matches(host: Column, domains: Column) -> Column:
    """Host equals one of the domains (array) or lies below it."""
    return F.coalesce(F.arrays_overlap(host_suffixes(host), domains), F.lit(False))


def public_admin_host(host: Column) -> Column:
    return host.rlike(PUBLIC_ADMIN_HOSTS)


def path_words(c: Column) -> Column:
    """Unescaped path with ``/``, ``-`` and ``_`` as blanks."""
    return F.when(is_http_url(c), F.translate(unescape_data(path_of(c)), "/-_", "   ")).otherwise(F.lit(""))


def _public_ipv4(host: Column) -> Column:
    def check(byte: Column) -> Column:
        a, b, c = byte[0], byte[1], byte[2]
        return (
            a.between(1, 223)
            & ~a.isin(10, 127)
            & ~((a == 100) & b.between(64, 127))
            & ~((a == 169) & (b == 254))
            & ~((a == 172) & b.between(16, 31))
            & ~((a == 192) & b.isin(0, 168))
            & ~((a == 198) & b.isin(18, 19))
            & ~((a == 198) & (b == 51) & (c == 100))
            & ~((a == 203) & (b == 0) & (c == 113))
        )

    return let(F.transform(F.split(host, r"\."), lambda part: part.try_cast("int")), check)


_IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


@F.pandas_udf(T.BooleanType())
def _public_ipv6(host: pd.Series) -> pd.Series:
    def check(value: str | None) -> bool | None:
        try:
            address = ipaddress.IPv6Address((value or "").strip("[]"))
        except ValueError:
            return None
        if address.ipv4_mapped is not None:
            # the mapped address follows the IPv4 ranges
            first, second, third, _ = address.ipv4_mapped.packed
            return (
                0 < first < 224
                and first not in (10, 127)
                and not (first == 100 and 64 <= second <= 127)
                and (first, second) != (169, 254)
                and not (first == 172 and 16 <= second <= 31)
                and not (first == 192 and second in (0, 168))
                and not (first == 198 and second in (18, 19))
                and (first, second, third) not in ((198, 51, 100), (203, 0, 113))
            )
        local = address.is_loopback or address.is_unspecified or address.is_link_local or address.is_multicast
        reserved = address.is_site_local or address in ipaddress.ip_network("fc00::/7")
        return not (local or reserved or address in ipaddress.ip_network("2001:db8::/32"))

    return host.map(check)


def is_public_ip(host: Column, with_ipv6: bool = False) -> Column:
    """True/false for an address literal, null for a name. IPv6 needs a Python pass: off by default."""
    verdict = F.when(host.rlike(_IPV4), _public_ipv4(host))
    if with_ipv6:
        verdict = verdict.when(host.contains(":"), _public_ipv6(host))
    return verdict


def is_private_host(host: Column, with_ipv6: bool = False) -> Column:
    named = host.isin(LOCAL_HOSTS)
    for suffix in LOCAL_SUFFIXES:
        named = named | host.endswith(suffix)
    return named | F.coalesce(~is_public_ip(host, with_ipv6), F.lit(False))
