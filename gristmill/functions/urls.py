"""Addresses as column expressions: parts, normal form, hosts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import strip, text_of

#: Parts of an address as RFC 3986 splits it: scheme, authority, path, query, fragment.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(strip(text_of(url)), _PARTS, k)


def netloc(url: Column) -> Column:
    return part(url, 2)


def hostname(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":[0-9]*$", ""))


def domain(url: Column) -> Column:
    """Lower-case authority without a leading ``www.``; the port stays; '' if there is none."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def _query(q: Column) -> Column:
    """Pairs in the order of their names, each percent-encoded anew; the order among equal names stays."""
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    parsed = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.try_url_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), i.alias("i"), F.try_url_decode(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1)).alias("v")
        ),
    )
    return F.array_join(F.transform(F.array_sort(parsed), lambda s: F.concat(F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"]))), "&")


def normalized(url: Column) -> Column:
    """https, bare lower-case host, no trailing slash, sorted query, no fragment nor path parameters; '' for none."""
    host = F.regexp_replace(hostname(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part(url, 3), ";[^/]*$", ""), "/+$", "")
    path = F.when(path == "", "/").otherwise(F.when(F.left(path, F.lit(1)) == "/", path).otherwise(F.concat(F.lit("/"), path)))
    # without an authority the whole string is a path
    bare = netloc(url) == ""
    q = _query(part(url, 4))
    base = F.when(bare, F.concat(F.lit("https://"), F.regexp_replace(path, "^/", ""))).otherwise(F.concat(F.lit("https://"), host, path))
    return F.when(strip(text_of(url)) == "", "").otherwise(F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q)))
