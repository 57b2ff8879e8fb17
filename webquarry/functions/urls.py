"""URL expressions. All but ``resolve`` stay in the JVM; null in gives null out unless stated."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, strip

# Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_eid", "_ga", "_gl", "ref", "source")
# File name endings that aren't pages.
ASSETS = "pdf zip tar gz rar 7z jpg jpeg png gif webp svg ico bmp tiff mp3 wav ogg mp4 webm avi mov mkv css js json xml woff woff2 ttf eot otf doc docx xls xlsx ppt pptx csv".split()
# Schemes of links that lead to no page.
IGNORED = ("javascript:", "mailto:", "tel:", "data:", "sms:", "#")

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path with parameters, 4 query; '' where absent."""
    return F.regexp_extract(url, _PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def path(url: Column) -> Column:
    return part(url, 3)


def host(url: Column) -> Column:
    """Lower-case authority up to the first colon."""
    return F.regexp_extract(F.lower(part(url, 2)), r"^([^:]*)", 1)


def ensure_scheme(url: Column) -> Column:
    u = strip(url)
    return F.when(u.rlike(r"^(?i)https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_query(query: Column, drop=TRACKING) -> Column:
    """Pairs without tracking keys, sorted by key alone (stable), encoded again."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    rows = F.transform(pairs, lambda p, i: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.when(F.instr(p, "=") > 0, _decoded(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(rows, lambda r: ~F.lower(r["k"]).isin(*drop)))
    return F.array_join(F.transform(kept, lambda r: F.concat(_encoded(r["k"]), F.lit("="), _encoded(r["v"]))), "&")


def normalize(url: Column, drop=TRACKING) -> Column:
    """Canonical form: https:// where no scheme stands, lower-case scheme and authority, no default port, no fragment, single
    slashes, no tracking parameters, parameters sorted by key. '' stays ''; trailing slashes and www stay."""
    return F.when(url == "", "").otherwise(let(ensure_scheme(url), lambda u: _canonical(u, drop)))


def _canonical(u: Column, drop) -> Column:
    s, full = scheme(u), part(u, 3)
    site = F.lower(part(u, 2))
    site = F.when((s == "http") & site.endswith(":80"), F.regexp_replace(site, ":80$", "")).when((s == "https") & site.endswith(":443"), F.regexp_replace(site, ":443$", "")).otherwise(site)
    params = F.regexp_extract(full, r"(;[^/]*)$", 1)
    p = F.regexp_replace(F.regexp_replace(full, r";[^/]*$", ""), "/+", "/")
    p = F.concat(F.when(p == "", "/").otherwise(p), F.when(params == ";", "").otherwise(params))
    query = let(normal_query(part(u, 4), drop), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(s, F.lit("://"), site, p, query)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts after one leading www.; false where a host is missing."""
    x, y = (F.regexp_replace(host(c), r"^www\.", "") for c in (a, b))
    return F.coalesce((x != "") & (x == y), F.lit(False))


def is_page(url: Column) -> Column:
    """The path doesn't end like an asset."""
    return ~F.lower(path(url)).rlike(r"\.(" + "|".join(ASSETS) + ")$")


def loops(url: Column) -> Column:
    """Over 8 segments, one of them three times or more, or two that alternate (a/b/a/b)."""
    seg = F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")
    often = F.exists(F.array_distinct(seg), lambda s: F.size(F.filter(seg, lambda x: x == s)) >= 3)
    starts = F.when(F.size(seg) >= 4, F.sequence(F.lit(1), F.size(seg) - 3)).otherwise(F.array().cast("array<int>"))
    swap = F.exists(starts, lambda i: (F.get(seg, i - 1) == F.get(seg, i + 1)) & (F.get(seg, i) == F.get(seg, i + 2)))
    return (F.size(seg) > 8) | often | swap


def robots_url(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), F.lit("/robots.txt"))


def joined(base: str | None, href: str | None) -> str | None:
    """RFC 3986 resolution of a link; null for empty, ignored and non-http(s) targets."""
    if not href:
        return None
    href = href.strip()
    if href.lower().startswith(IGNORED):
        return None
    try:
        out = urljoin(base or "", href)
        return out if urlsplit(out).scheme.lower() in ("http", "https") else None
    except ValueError:
        return None


def resolve(base: Column, href: Column) -> Column:
    """``joined`` as a column function (Arrow batches)."""

    @F.arrow_udf(T.StringType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([joined(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())

    return run(base, href)


@F.arrow_udf(T.ArrayType(T.StringType()))
def resolve_many(base: pa.Array, hrefs: pa.Array) -> pa.Array:
    """``joined`` for every link of a page; null links stay null."""
    return pa.array([None if hs is None else [joined(b, h) for h in hs] for b, hs in zip(base.to_pylist(), hrefs.to_pylist())], pa.list_(pa.string()))
