"""URL and path functions as Column expressions, for well-formed http(s) urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))


def path(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.when(raw == "", F.lit("/")).otherwise(raw)


def query(url: Column) -> Column:
    """The query with its question mark; the empty text if there is none."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def canonical(url: Column) -> Column:
    """Without fragment and without trailing slashes of a path other than the root."""
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.concat(origin(url), F.when(bare == "", F.lit("/")).otherwise(bare), query(url))


def output_path(url: Column) -> Column:
    """Where a page is written: index.html under a folder unless the path names a file; a query goes into the name."""
    stripped = F.regexp_replace(path(url), "^/+", "")
    last = F.regexp_extract(stripped, r"([^/]*)$", 1)
    plain = (
        F.when(stripped == "", F.lit("index.html")).when(stripped.endswith("/"), F.concat(stripped, F.lit("index.html")))
        .when(last.contains("."), stripped).otherwise(F.concat(stripped, F.lit("/index.html")))
    )
    return with_query(plain, query(url))


def with_query(plain: Column, question: Column) -> Column:
    """A path with a digest of the query before its extension."""
    suffix = F.when(question == "", F.lit("")).otherwise(F.concat(F.lit("__q_"), F.substring(F.sha2(question, 256), 1, 12)))
    extension = F.regexp_extract(plain, r"[^/](\.[^./]*)$", 1)
    stem = F.substring(plain, F.lit(1), F.length(plain) - F.length(extension))
    return F.concat(stem, suffix, extension)


def asset_path(url: Column) -> Column:
    """Where an asset is written."""
    stripped = F.regexp_replace(path(url), "^/+", "")
    return with_query(F.when(stripped == "", F.lit("assets/index")).otherwise(stripped), query(url))


def cache_name(url: Column, extension: str) -> Column:
    return F.concat(F.sha2(url, 256), F.lit(extension))


def same_origin(a: Column, b: Column) -> Column:
    """Scheme, host and port alike; the default ports may be left out."""
    plain = lambda u: F.regexp_replace(F.regexp_replace(origin(u), r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    return (origin(a) != "") & (plain(a) == plain(b))


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(#.*)$", 1)


def public_path(output: Column, base: str = "") -> Column:
    """The link to a written page, index.html left out."""
    prefix = base.removesuffix("/")
    folder = F.regexp_replace(output, r"(^|/)index\.html$", "$1")
    return F.concat(F.lit(f"{prefix}/"), folder)
