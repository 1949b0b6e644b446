"""Column expressions and row helpers for URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.functions.encode import canonical_host
from hedgemark.functions.hosts import host_text, trimmed

# Punctuation that text leaves at the end of a URL (fixed value).
TRAILING_JUNK = r"""[\\).,;:!?'"\]]+\z"""

_AUTHORITY_HOST = r"^(\[[a-zA-Z0-9:.]*\]|[^:]*)"


def clean_url(url: Column) -> Column:
    """A find as it is reported: trimmed and without trailing punctuation."""
    return F.regexp_replace(trimmed(url), TRAILING_JUNK, "")


def url_text(url: Column) -> Column:
    """The part of a find that is parsed; null unless it is http or https with an authority."""
    text = trimmed(clean_url(url))
    return F.regexp_extract(text, r"(?is)^(https?://[^/?#].*)", 1)


def site_of(text: Column) -> Column:
    """Host and port, without user information; empty for no URL."""
    return F.regexp_replace(F.regexp_extract(text, r"^[^:]+://([^/?#]*)", 1), r"^.*@", "")


def name_of(site: Column) -> Column:
    """The host as text, before encoding."""
    host = F.regexp_extract(site, _AUTHORITY_HOST, 1)
    return host_text(F.regexp_replace(host, r"^\[+|\]+$", ""))


def assemble(text: Column, site: Column, tail: Column, host: Column) -> Column:
    """The normal form from its parts; null if the host is."""
    secure = F.lower(F.substring(text, 1, 5)) == "https"
    digits = F.regexp_replace(
        F.regexp_extract(site, _AUTHORITY_HOST + r":([0-9]*)", 2), r"^0+(?=[0-9])", ""
    )
    port = F.concat(F.lit(":"), digits)
    standard = port.isin(":") | F.when(secure, port == ":443").otherwise(port == ":80")
    return F.concat(
        F.when(secure, "https://").otherwise("http://"), host,
        F.when(F.contains(site, F.lit(":")) & ~standard, port).otherwise(""),
        F.when(tail.rlike(r"^(?:\?|\z)"), "/").otherwise(""), tail,
    )


def tail_of(text: Column) -> Column:
    """Path and query as they stand, without the fragment."""
    return F.regexp_extract(text, r"^[^:]+://[^/?#]*([^#]*)", 1)


def with_normal_url(df: DataFrame, url: str, out: str = "normalized_url",
                    host: str = "hostname") -> DataFrame:
    """Add the normal form of ``url`` and its host; both null when it is no web URL.

    Runs inside the scan, without a shuffle: everything but the encoding of
    unusual hosts is a built-in expression, and each part is worked out once.
    """
    c = F.col
    step = df.withColumn("__text", url_text(c(url)))
    step = step.withColumns({"__site": site_of(c("__text")), "__tail": tail_of(c("__text"))})
    step = step.withColumn("__name", name_of(c("__site")))
    step = step.withColumn(host, canonical_host(c("__name")))
    step = step.withColumn(out, assemble(c("__text"), c("__site"), c("__tail"), c(host)))
    return step.drop("__text", "__site", "__tail", "__name")


def without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        .when(part == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(part))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def absolute_location(current: Column, location: Column) -> Column:
    """A scheme-less redirect target merged with the URL that sent it."""
    base_site = F.regexp_extract(current, r"^([^:]+://[^/?#]*)", 1)
    base_path = F.regexp_extract(current, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(current, r"^[^?#]*(\?[^#]*)", 1)
    bare = F.regexp_replace(location, r"(?s)#.*\z", "")
    path = F.regexp_extract(bare, r"^([^?]*)", 1)
    query = F.regexp_extract(bare, r"^[^?]*(\?.*)", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    return (
        F.when(bare.startswith("//"), F.concat(F.substring_index(current, "//", 1), bare))
        .when(path == "", F.concat(base_site, base_path, F.when(query == "", base_query).otherwise(query)))
        .when(path.startswith("/"), F.concat(base_site, without_dot_segments(path), query))
        .otherwise(F.concat(base_site, without_dot_segments(F.concat(folder, path)), query))
    )
