"""URL jobs: extraction, normal form, registrable domains, free-text targets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.config import ARTICLE_KIND, DEFAULTS, Limits
from hedgemark.functions.hosts import (
    host_suffixes, host_text, is_usable_host, registrable_domain, trimmed,
)
from hedgemark.functions.encode import canonical_host
from hedgemark.functions.urls import (
    assemble, clean_url, name_of, site_of, tail_of, url_text, with_normal_url,
)
from hedgemark.operators.joins import spread_join

# Patterns of the five ways a URL appears in text (fixed values).
MARKDOWN_IMAGE = r"(?i)!\[[^\]]*\]\((https?://[^)\s]+)"
MARKDOWN_LINK = r"(?i)(?<!!)\[[^\]]*\]\((https?://[^)\s]+)"
AUTOLINK = r"(?i)<(https?://[^>]+)>"
HTML_ATTRIBUTE = r"""(?i)(?:src|href)\s*=\s*["'](https?://[^"']+)["']"""
BARE_URL = r"""(?i)(https?://[^\s<>\[\]()"'\\`]+)"""

TEXT_FORMS = (
    ("markdown_image", MARKDOWN_IMAGE),
    ("markdown_link", MARKDOWN_LINK),
    ("autolink", AUTOLINK),
    ("html_attr", HTML_ATTRIBUTE),
    ("bare_url", BARE_URL),
)

_FINDS = "array<struct<original_url:string,source_type:string,source_location:string>>"


def _find(url: Column, kind: str, place: str) -> Column:
    return F.struct(
        clean_url(url).alias("original_url"),
        F.lit(kind).alias("source_type"),
        F.lit(place).alias("source_location"),
    )


def tag_finds(tags: Column) -> Column:
    """URLs of ``image`` and ``imeta`` tags, in tag order."""
    none = F.array().cast(_FINDS)
    per_tag = F.transform(
        tags,
        lambda t: F.when(
            (F.get(t, F.lit(0)) == "image") & (F.size(t) > 1), F.array(_find(F.get(t, F.lit(1)), "image_tag", "image"))
        ).when(
            F.get(t, F.lit(0)) == "imeta",
            F.transform(
                F.filter(F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda p: p.startswith("url ")),
                lambda p: _find(F.substring(p, 5, 1 << 30), "imeta_tag", "imeta"),
            ),
        ).otherwise(none),
    )
    return F.coalesce(F.flatten(per_tag), none)


def text_finds(content: Column) -> Column:
    """URLs of the text, form by form; text without ``://`` skips the patterns."""
    def of_form(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        return F.transform(hits, lambda u: _find(u, kind, "content"))

    per_form = [of_form(kind, pattern) for kind, pattern in TEXT_FORMS]
    none = F.array().cast(_FINDS)
    return F.when(F.instr(content, "://") > 0, F.concat(*per_form)).otherwise(none)


Extractor = Callable[[Column, Column], Column]


def article_finds(tags: Column, content: Column) -> Column:
    return F.concat(tag_finds(tags), text_finds(content))


EXTRACTORS: dict[int, Extractor] = {ARTICLE_KIND: article_finds}


def register_extractor(kind: int, extractor: Extractor,
                       registry: Mapping[int, Extractor] = EXTRACTORS) -> dict[int, Extractor]:
    """A registry with one more event kind; pass it to ``extract_urls``."""
    return {**registry, kind: extractor}


def extract_urls(events: DataFrame, limits: Limits | None = None, keep_empty: bool = False,
                 registry: Mapping[int, Extractor] = EXTRACTORS) -> DataFrame:
    """One row per URL find, duplicates kept, in order of extraction.

    Reads ``event_id, kind, tags, content``. Finds stay in one array per event
    until the cap (``limits.max_urls_per_event``; none without limits) has been
    applied, so there is no shuffle. An unregistered kind is an error.
    """
    kind = F.col("kind")
    finds = F.raise_error(F.concat(F.lit("no extractor for kind "), kind.cast("string"))).cast(_FINDS)
    for known, extractor in registry.items():
        finds = F.when(kind == known, extractor(F.col("tags"), F.col("content"))).otherwise(finds)
    # each part of a URL is worked out once and handed on inside the array
    parsed = F.transform(finds, lambda f: F.struct(f.alias("find"), url_text(f["original_url"]).alias("text")))
    sited = F.transform(parsed, lambda f: F.struct(
        f["find"].alias("find"), f["text"].alias("text"), site_of(f["text"]).alias("site")))
    named = F.transform(sited, lambda f: F.struct(
        f["find"].alias("find"), f["text"].alias("text"), f["site"].alias("site"),
        name_of(f["site"]).alias("name")))
    usable = events.select("event_id", F.filter(named, lambda f: is_usable_host(f["name"])).alias("finds"))
    if limits is not None:
        usable = usable.withColumn("finds", F.slice("finds", 1, limits.max_urls_per_event))
    # the outer form: the inner one would have the planner test the array first,
    # which means extracting everything a second time
    rows = usable.select("event_id", F.posexplode_outer("finds").alias("position", "f"))
    if not keep_empty:
        rows = rows.filter(F.col("position").isNotNull())
    rows = rows.withColumn("hostname", canonical_host(F.col("f.name")))
    return rows.select(
        "event_id", F.col("position").cast("bigint").alias("position"),
        F.col("f.find.original_url").alias("original_url"),
        assemble(F.col("f.text"), F.col("f.site"), tail_of(F.col("f.text")), F.col("hostname")).alias("normalized_url"),
        "hostname", F.col("f.find.source_type").alias("source_type"),
        F.col("f.find.source_location").alias("source_location"),
    )


def normalize_urls(df: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """Split a table into rows with a normal URL and rejected rows."""
    done = with_normal_url(df, url)
    return (
        done.filter(F.col("normalized_url").isNotNull()),
        done.filter(F.col("normalized_url").isNull()).drop("normalized_url", "hostname"),
    )


def with_domain(df: DataFrame, host: str = "hostname", out: str = "domain") -> DataFrame:
    return df.withColumn(out, registrable_domain(F.col(host)))


def with_normal_host(df: DataFrame, host: str, out: str = "hostname") -> DataFrame:
    """Normal form of a bare host; null if it is not usable."""
    return df.withColumn(out, canonical_host(host_text(F.col(host))))


def count_domains(df: DataFrame, host: str = "hostname") -> DataFrame:
    """Rows and hosts per registrable domain.

    Hosts are counted in two steps, so a domain with very many rows is reduced
    to its hosts before it meets in one task.
    """
    per_host = with_domain(df, host).groupBy("domain", host).agg(F.count(F.lit(1)).alias("rows"))
    return per_host.groupBy("domain").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("hosts")
    )


def classify_targets(df: DataFrame, query: str, limits: Limits = DEFAULTS) -> DataFrame:
    """Sort free-text look-ups into ``url``, ``domain`` or an error."""
    text = trimmed(F.col(query))
    scheme = text.contains("://")
    kind = (
        F.when(text == "", "error")
        .when(F.octet_length(text) > limits.max_target_bytes, "error")
        .when(scheme | text.contains("/"), "url")
        .otherwise("domain")
    )
    error = F.when(text == "", "empty").when(
        F.octet_length(text) > limits.max_target_bytes, "url_too_long"
    )
    target = F.when(kind == "url", F.when(scheme, text).otherwise(F.concat(F.lit("https://"), text))).when(
        kind == "domain", text
    )
    return df.withColumns({"target_kind": kind, "target": target, "target_error": error})


def suffix_rows(df: DataFrame, host: str = "hostname", out: str = "suffix") -> DataFrame:
    """One row per label suffix of the host, for tree matching by equi-join."""
    return df.withColumn(out, F.explode_outer(host_suffixes(F.col(host))))


def domain_tree_match(df: DataFrame, domains: DataFrame, tie: list[str], host: str = "hostname") -> DataFrame:
    """Pairs where the host is the listed domain or lies below it.

    Short suffixes such as ``com`` are shared by very many hosts, hence the spread.
    """
    listed = domains.select(F.col("domain").alias("suffix")).distinct()
    return spread_join(suffix_rows(df, host), listed, "suffix", "inner", tie).withColumnRenamed("suffix", "listed_domain")
