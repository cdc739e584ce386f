"""URL functions as Column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visit (besides utm_*).
TRACKING_PARAMS = [
    "fbclid", "gclid", "dclid", "msclkid", "yclid", "twclid",
    "mc_cid", "mc_eid", "_ga", "_gl", "igshid", "ref_src",
]

# File extensions that mark a download instead of a page.
ASSET_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "bmp", "tif", "tiff",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "rtf", "odt", "ods", "odp",
    "zip", "rar", "7z", "tar", "gz", "bz2",
    "mp3", "mp4", "m4a", "avi", "mov", "wmv", "webm", "ogg", "ogv", "wav", "flac",
    "woff", "woff2", "ttf", "eot", "otf",
    "css", "js", "mjs", "map", "json", "xml", "rss", "atom", "txt",
    "exe", "dmg", "apk", "msi", "pkg", "deb", "rpm",
]


_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_HAS_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_UNSAFE = r"""[^!#$%&'()*+,\-./0-9:;=?@A-Z\[\]_a-z~]"""
# Characters form encoding escapes although they may stand in a URL as they are.
_KEEP = {
    "%2F": "/", "%3A": ":", "%3F": "?", "%23": "#", "%5B": "[", "%5D": "]", "%40": "@", "%21": "!",
    "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2B": "+", "%2C": ",", "%3B": ";",
    "%3D": "=", "%7E": "~",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def trim_ws(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def url_parts(url: Column) -> Column:
    """struct(scheme, authority, path, query, has_authority) of any reference."""
    return F.struct(
        F.lower(F.regexp_extract(url, _PARTS, 1)).alias("scheme"),
        F.regexp_extract(url, _PARTS, 2).alias("authority"),
        F.regexp_extract(url, _PARTS, 3).alias("path"),
        F.regexp_extract(url, _PARTS, 4).alias("query"),
        url.rlike(_HAS_AUTHORITY).alias("has_authority"),
    )


def percent_encode(x: Column) -> Column:
    """Escape what may not stand in a URL; clean input is passed through untouched."""
    encoded = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, char in _KEEP.items():
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    encoded = F.regexp_replace(encoded, r"%25([0-9A-Fa-f]{2})", r"%$1")
    return F.when(x.rlike(_UNSAFE), encoded).otherwise(x)


def strip_tracking(query: Column) -> Column:
    """Drop utm_* and the tracking parameters, keep the rest in order."""
    names = "|".join(TRACKING_PARAMS)
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (F.length(p) > 0) & ~p.rlike(rf"(?i)^(?:utm_[^=]*|(?:{names}))(?:=|$)"),
    )
    return F.when(F.length(query) == 0, F.lit("")).otherwise(F.array_join(kept, "&"))


def _merge_dots(path: Column) -> Column:
    """RFC 3986 dot-segment removal; only paths that have dot segments pay for it."""
    folded = F.aggregate(
        F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")), F.lit(1))),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
        lambda acc: F.concat(
            F.lit("/"),
            F.array_join(acc, "/"),
            F.when(path.rlike(r"/\.\.?$") & (F.size(acc) > 0), F.lit("/")).otherwise(F.lit("")),
        ),
    )
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def normalize_url(href: Column, base: Column | None = None) -> Column:
    """Canonical absolute URL of ``href`` seen from ``base``; null when it is not an http(s) page.

    Lower-case scheme and host, no fragment, no tracking parameters, no default
    port, empty path becomes ``/``, unsafe characters percent-encoded.
    """
    base = F.lit("") if base is None else base

    def assemble(t: Column) -> Column:
        ref, root = t["ref"], t["base"]
        absolute = ref["has_authority"]
        scheme = F.when(ref["scheme"] != "", ref["scheme"]).otherwise(root["scheme"])
        authority = F.when(absolute, ref["authority"]).otherwise(root["authority"])
        path = (
            F.when(absolute | ref["path"].startswith("/"), ref["path"])
            .when(ref["path"] == "", root["path"])
            .otherwise(
                F.concat(
                    F.when(root["path"] == "", F.lit("/")).otherwise(F.regexp_replace(root["path"], r"[^/]*$", "")),
                    ref["path"],
                )
            )
        )
        return F.struct(
            scheme.alias("scheme"),
            F.lower(authority).alias("authority"),
            path.alias("path"),
            strip_tracking(ref["query"]).alias("query"),
            ((ref["scheme"] == "") | absolute).alias("ok"),
        )

    def render(u: Column) -> Column:
        authority = F.when(u["scheme"] == "http", F.regexp_replace(u["authority"], r":(80)?$", "")).otherwise(
            F.regexp_replace(u["authority"], r":(443)?$", "")
        )
        path = F.when(u["path"] == "", F.lit("/")).otherwise(let(u["path"], _merge_dots))
        url = F.concat(
            u["scheme"],
            F.lit("://"),
            authority,
            percent_encode(path),
            F.when(u["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), percent_encode(u["query"]))),
        )
        host = F.regexp_replace(F.regexp_replace(u["authority"], r"^.*@", ""), r":\d*$", "")
        return F.when(u["ok"] & u["scheme"].isin("http", "https") & (host != ""), url)

    cleaned = trim_ws(href)
    usable = cleaned.isNotNull() & (cleaned != "") & ~cleaned.startswith("#")
    parts = F.struct(url_parts(cleaned).alias("ref"), url_parts(F.coalesce(base, F.lit(""))).alias("base"))
    return F.when(usable, let(let(parts, assemble), render))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def is_internal(url: Column, base: Column) -> Column:
    """Same host, ignoring a leading ``www.``; the scheme does not matter, subdomains are external."""
    return strip_www(host_of(url)) == strip_www(host_of(base))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def path_and_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)


def is_likely_asset(url: Column) -> Column:
    extension = F.lower(F.regexp_extract(path_of(url), r"\.([^./]+)$", 1))
    return extension.isin(ASSET_EXTENSIONS)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def page_key(crawl_id: Column, url: Column) -> Column:
    """Deterministic page id: re-running a job yields the same ids."""
    return F.sha2(F.concat(crawl_id, F.lit("|"), url), 256)


def normalize_site_base(url: Column) -> Column:
    """scheme + host (+ non-default port) + path without trailing slash; null if not http(s)."""

    def render(p: Column) -> Column:
        authority = F.lower(p["authority"])
        bare = F.when(p["scheme"] == "http", F.regexp_replace(authority, r":(80)?$", "")).otherwise(
            F.regexp_replace(authority, r":(443)?$", "")
        )
        return F.when(
            p["scheme"].isin("http", "https") & (F.regexp_replace(authority, r":\d*$", "") != ""),
            F.concat(p["scheme"], F.lit("://"), bare, F.regexp_replace(p["path"], r"/+$", "")),
        )

    return let(url_parts(trim_ws(url)), render)


def url_segments(url: Column) -> Column:
    """Non-empty path segments, percent-decoded and lower-cased."""
    raw = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    return F.transform(
        raw,
        lambda s: F.lower(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)),
    )


def trim_slash(url: Column) -> Column:
    """Without trailing slashes; used to compare canonical and page URL."""
    return F.regexp_replace(url, r"/+$", "")


def sitemap_key(url: Column) -> Column:
    """Comparison key for sitemap membership: a lone ``/`` is kept, case is ignored."""
    return F.lower(F.when(F.length(url) > 1, trim_slash(url)).otherwise(url))
