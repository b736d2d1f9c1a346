"""URL resolution and canonicalisation as Column expressions.

A split URL travels as ``array<string>``: scheme, netloc, path, query. The fragment never matters here and
is dropped at once, which also frees ``#`` to act as an unambiguous separator. Every function takes and returns
Columns, so it works the same at the top level of a query and inside a ``transform`` over an array of links.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME, NETLOC, PATH, QUERY = 0, 1, 2, 3

# Query parameters that only serve tracking.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ["fbclid", "gclid", "mc_cid", "mc_eid", "yclid", "igshid", "_ga"]

# RFC 3986 appendix B, with the scheme restricted to its legal characters.
_RFC3986 = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_url(url: Column) -> Column:
    """Split into ``array(scheme, netloc, path, query)``; absent parts are empty strings."""
    # Most URLs hold no character to drop: test for them by plain byte search before translating.
    broken = url.contains("\n") | url.contains("\t") | url.contains("\r")
    one_line = F.when(broken, F.translate(url, "\t\r\n", "")).otherwise(url)
    trimmed = F.when(url < "!", F.regexp_replace(one_line, r"^[\x00-\x20]+", "")).otherwise(one_line)
    return F.split(F.regexp_replace(trimmed, _RFC3986, "$1#$2#$3#$4"), "#")


def _part(parts: Column, index: int) -> Column:
    return F.get(parts, F.lit(index))


def scheme_of(parts: Column) -> Column:
    return F.lower(_part(parts, SCHEME))


def netloc_of(parts: Column) -> Column:
    return _part(parts, NETLOC)


def path_of(parts: Column) -> Column:
    return _part(parts, PATH)


@cache
def _ipv6_pattern() -> str:
    group = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    dotted = rf"{octet}(?:\.{octet}){{3}}"
    forms = [f"(?:{group}:){{6}}(?:{group}:{group}|{dotted})"]
    for left in range(8):
        head = f"{group}(?::{group}){{{left - 1}}}" if left else ""
        tails = []
        if left < 7:
            tails.append(f"{group}(?::{group}){{0,{6 - left}}}")
        if left < 6:
            tails.append(f"(?:{group}:){{0,{5 - left}}}{dotted}")
        tail = f"(?:{'|'.join(tails)})?" if tails else ""
        forms.append(f"{head}::{tail}")
    return f"(?:{'|'.join(forms)})(?:%[^%\\]]+)?"


@cache
def _delimiter_lookalikes() -> str:
    """Characters that turn into a URL delimiter under NFKC; they may not appear in a host."""
    found = [
        chr(code)
        for code in range(0x80, 0x10000)
        if not 0xD800 <= code < 0xE000 and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(code)))
    ]
    return "[" + "".join(found) + "]"


def is_bad_netloc(netloc: Column) -> Column:
    """True where no URL parser would accept the authority part."""
    opened, closed = netloc.contains("["), netloc.contains("]")
    literal = netloc.rlike(rf"^[^\[]*\[(?:v[0-9A-Fa-f]+\.[^\]]+|{_ipv6_pattern()})\]")
    return (
        F.when(netloc == "", False)
        .when(opened != closed, True)
        .when(opened & ~literal, True)
        .when(F.octet_length(netloc) == F.length(netloc), False)
        .otherwise(netloc.rlike(_delimiter_lookalikes()))
    )


def _remove_dot_segments(path: Column) -> Column:
    """For a path that is empty or starts with a slash."""

    def resolved(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda done, segment: F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment))),
        )
        closing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return let(
            F.array_join(F.concat(kept, closing), "/"),
            lambda joined: F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined)),
        )

    return (
        F.when(path == "", F.lit("/"))
        .when(~path.contains("/."), path)
        .when(path.rlike(r"/\.\.?(?:/|\z)"), let(F.split(path, "/"), resolved))
        .otherwise(path)
    )


def resolve(base: Column, reference: Column) -> Column:
    """Resolve a split reference against a split http(s) base, as a browser-side link would be."""
    scheme, netloc, path, query = (_part(reference, i) for i in range(4))
    b_scheme, b_netloc, b_path, b_query = (_part(base, i) for i in range(4))
    own_scheme = F.when(scheme == "", F.lower(b_scheme)).otherwise(F.lower(scheme))
    other_scheme = (scheme != "") & (F.lower(scheme) != F.lower(b_scheme))
    directory = F.when(b_path.contains("/"), F.regexp_replace(b_path, r"[^/]*\z", "")).otherwise(F.lit("/"))

    def merged(bare: Column) -> Column:
        return F.when(bare.startswith("/"), bare).otherwise(F.regexp_replace(F.concat(directory, bare), "//+", "/"))

    # ";parameters" belong to the last segment; an empty list of them vanishes.
    has_params = path.contains(";")
    bare_path = F.when(has_params, F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path)
    params = F.when(has_params, F.regexp_extract(path, r"(;[^/]+)\z", 1)).otherwise(F.lit(""))

    def located(bare: Column) -> Column:
        return (
            F.when(netloc != "", F.array(own_scheme, netloc, F.concat(bare, params), query))
            .when(
                (bare == "") & (params == ""),
                F.array(own_scheme, b_netloc, b_path, F.when(query == "", b_query).otherwise(query)),
            )
            .otherwise(
                F.array(own_scheme, b_netloc, F.concat(let(merged(bare), _remove_dot_segments), params), query)
            )
        )

    return F.when(other_scheme, F.array(F.lower(scheme), netloc, path, query)).otherwise(let(bare_path, located))


def _decode(text: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda piece: piece != ""),
        lambda piece: F.struct(
            _decode(F.substring_index(piece, "=", 1)).alias("name"),
            F.when(piece.contains("="), _decode(F.regexp_replace(piece, r"(?s)^[^=]*=", ""))).otherwise(F.lit("")).alias("value"),
        ),
    )
    wanted = F.filter(
        pairs,
        lambda pair: ~F.lower(pair["name"]).startswith(TRACKING_PREFIX) & ~F.lower(pair["name"]).isin(TRACKING_PARAMS),
    )
    encoded = F.array_join(F.transform(wanted, lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"]))), "&")
    return F.when(query == "", F.lit("")).otherwise(encoded)


def canonical_netloc(parts: Column) -> Column:
    scheme, netloc = scheme_of(parts), F.lower(netloc_of(parts))
    return (
        F.when(~netloc.contains(":"), netloc)
        .when(scheme == "http", F.regexp_replace(netloc, r":80\z", ""))
        .when(scheme == "https", F.regexp_replace(netloc, r":443\z", ""))
        .otherwise(netloc)
    )


def canonical_path(parts: Column) -> Column:
    path = path_of(parts)
    return F.when(path == "", F.lit("/")).otherwise(path)


def compose_canonical(parts: Column) -> Column:
    """The comparison key of a split URL: no fragment, tracking parameter or default port."""
    path = canonical_path(parts)
    authority = let(
        canonical_netloc(parts),
        lambda netloc: F.when(netloc != "", F.concat(F.lit("//"), netloc))
        .when(path.startswith("/"), F.lit("//"))
        .otherwise(F.lit("")),
    )
    scheme = scheme_of(parts)
    return let(
        _clean_query(_part(parts, QUERY)),
        lambda query: F.concat(
            F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))),
            authority,
            path,
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        ),
    )


def normalize_url(url: Column) -> Column:
    """Canonical form of an absolute URL; NULL where the URL is malformed."""
    return let(
        split_url(url),
        lambda parts: F.when(~is_bad_netloc(netloc_of(parts)), compose_canonical(parts)),
    )


def join_url(base: Column, reference: Column) -> Column:
    """Absolute form of ``reference`` (fragment dropped); NULL where either side is malformed."""
    return let(
        F.struct(split_url(base).alias("base"), split_url(reference).alias("ref")),
        lambda both: F.when(
            ~is_bad_netloc(netloc_of(both["base"])) & ~is_bad_netloc(netloc_of(both["ref"])),
            let(
                resolve(both["base"], both["ref"]),
                lambda p: F.concat(
                    F.when(p[SCHEME] == "", F.lit("")).otherwise(F.concat(p[SCHEME], F.lit(":"))),
                    F.when(p[NETLOC] == "", F.lit("")).otherwise(F.concat(F.lit("//"), p[NETLOC])),
                    p[PATH],
                    F.when(p[QUERY] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p[QUERY])),
                ),
            ),
        ),
    )


def url_netloc(url: Column) -> Column:
    return netloc_of(split_url(url))


def url_path(url: Column) -> Column:
    return path_of(split_url(url))


def base_host(host: Column) -> Column:
    lower = F.lower(host)
    return F.when(lower.startswith("www."), F.substring(lower, 5, 2**31 - 1)).otherwise(lower)


def is_same_site(link_host: Column, page_host: Column, allow_hosts: Column | None = None) -> Column:
    """Same base host, a subdomain of the page's base host, or an allow-listed host or subdomain of one."""
    link, root = F.lower(link_host), base_host(page_host)
    own = (base_host(link) == root) | link.endswith(F.concat(F.lit("."), root))
    if allow_hosts is None:
        return own
    return own | F.exists(
        F.coalesce(allow_hosts, F.array().cast("array<string>")),
        lambda host: (link == F.lower(host)) | link.endswith(F.concat(F.lit("."), F.lower(host))),
    )


def parent_hosts(host: Column) -> Column:
    """The host's proper dotted suffixes: turns a subdomain test into an equi-join."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(
        F.slice(labels, F.lit(2), F.size(labels)),
        lambda _, i: F.array_join(F.slice(labels, i + 2, F.size(labels)), "."),
    )


def path_prefix(url: Column, depth: int = 2) -> Column:
    """The first ``depth`` directories of a URL's path; a trailing file name does not count."""

    def prefix(segments: Column) -> Column:
        is_file = F.coalesce(F.try_element_at(segments, F.lit(-1)).contains("."), F.lit(False))
        directories = F.when(is_file, F.slice(segments, F.lit(1), F.size(segments) - 1)).otherwise(segments)
        return F.concat(F.lit("/"), F.array_join(F.slice(directories, 1, depth), "/"))

    return let(F.filter(F.split(url_path(url), "/"), lambda s: s != ""), prefix)
