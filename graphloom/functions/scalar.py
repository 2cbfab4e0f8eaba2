"""Scalar functions as column expressions: URLs, text measures, comment stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings and hosts of static resources.
ASSET_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "svg", "woff", "woff2", "ttf", "otf", "eot", "css", "js", "mjs", "map", "pdf")
CDN_HOSTS = (
    "cdnjs.cloudflare.com", "cdn.jsdelivr.net", "unpkg.com", "fonts.googleapis.com", "fonts.gstatic.com", "code.jquery.com", "stackpath.bootstrapcdn.com", "maxcdn.bootstrapcdn.com", "ajax.googleapis.com",
)


def url_kind(host: Column, path: Column) -> Column:
    """Asset for known hosts of static files and for their endings, else http."""
    ending = F.lower(F.regexp_extract(F.regexp_replace(path, "[).,;]+$", ""), r"\.([^./]*)$", 1))
    return F.when(F.lower(host).isin(*CDN_HOSTS) | ending.isin(*ASSET_EXTENSIONS), "asset").otherwise("http")


def url_parts(url: Column) -> Column:
    """SRC12: scheme, host, port (0 if absent), path and query of a URL."""
    get = lambda pattern, k: F.regexp_extract(url, pattern, k)
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?"
    port = F.coalesce(F.try_to_number(F.nullif(get(whole, 3), F.lit("")), F.lit("99999")).cast("int"), F.lit(0))
    return F.struct(get(whole, 1).alias("scheme"), F.lower(get(whole, 2)).alias("host"), port.alias("port"), get(whole, 4).alias("path"), get(whole, 5).alias("query"))


def normal_path(path: Column) -> Column:
    """Parameters of either spelling are {*}; lower case; no slash at the end."""
    p = F.regexp_replace(F.regexp_replace(path, r"\{[^}]+\}", "{*}"), r"(?<=/):[A-Za-z_][A-Za-z0-9_]*", "{*}")
    return F.lower(F.coalesce(F.nullif(F.rtrim(p, F.lit("/")), F.lit("")), F.lit("/")))


def entropy(text: Column) -> Column:
    """Bits per character of a text (Shannon)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def strip_comments(text: Column, style: str = "c") -> Column:
    """SRC14: comments go, strings and line ends stay, so line numbers do too.

    The text is cut into strings, comments and the rest from the left; whichever starts first wins,
    so comment marks in strings and quotes in comments are read right.
    """
    if style not in ("c", "hash"):
        raise ValueError(f"unknown style {style}")
    strings = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
    if style == "c":
        tokens = rf"(?s)({strings}|`(?:\\.|[^`\\])*`|/\*.*?\*/|//[^\n]*|[^\"'`/]+|.)"
        comment = lambda t: t.startswith("/*") | t.startswith("//")
    else:
        tokens = rf"(?s)(\"\"\".*?\"\"\"|'''.*?'''|{strings}|#[^\n]*|[^\"'#]+|.)"
        comment = lambda t: t.startswith("#")
    parts = F.regexp_extract_all(text, F.lit(tokens), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.when(comment(t), F.regexp_replace(t, r"[^\n]+", "")).otherwise(t)), "")
