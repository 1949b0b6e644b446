"""The scan: finds of every article, chains, evidence and the scan summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgemark.config import DEFAULTS, Limits
from hedgemark.functions.hosts import registrable_domain
from hedgemark.operators.joins import narrowed, spread_join
from hedgemark.operators.policy import domain_hits
from hedgemark.operators.redirects import SETTLED, chain_hops, resolve_redirects
from hedgemark.operators.urls import extract_urls
from hedgemark.sources.tables import stage


@dataclass(frozen=True)
class ScanTables:
    scans: DataFrame
    occurrences: DataFrame
    chains: DataFrame
    resolutions: DataFrame
    hops: DataFrame
    matches: DataFrame
    classifications: DataFrame


def distinct_urls(occurrences: DataFrame) -> DataFrame:
    """Each URL of a scan once, hung on its first occurrence."""
    return occurrences.filter(F.col("normalized_url").isNotNull()).groupBy("event_id", "normalized_url").agg(
        F.min("position").alias("primary_position"), F.count(F.lit(1)).alias("occurrences")
    )


def match_hops(hops: DataFrame, hits: DataFrame) -> DataFrame:
    """Policy hits of every hop of every chain; match type is always ``domain``."""
    keyed = hops.select(
        "normalized_url", F.col("hop_index").cast("bigint").alias("hop_index"),
        F.col("url").alias("matched_url"), F.col("hostname").alias("matched_hostname"),
        registrable_domain(F.col("hostname")).alias("domain"),
    ).filter(F.col("domain") != "")
    met = narrowed(keyed, hits, "domain", "domains-met")
    joined = spread_join(keyed, met, "domain", "inner", tie=["normalized_url", "hop_index"])
    return joined.select(
        "normalized_url", "hop_index", "matched_url", "matched_hostname", F.inline("hits"),
    ).withColumn("match_type", F.lit("domain"))


def occurrence_matches(occurrences: DataFrame, chain_hits: DataFrame) -> DataFrame:
    """Evidence rows: occurrences x hops x hits."""
    places = occurrences.filter(F.col("normalized_url").isNotNull()).select("event_id", "position", "normalized_url")
    return spread_join(places, chain_hits, "normalized_url", "inner", tie=["event_id", "position"])


def url_facts(chains: DataFrame, chain_hits: DataFrame) -> DataFrame:
    """Per URL what a scan summary needs: status, redirects, hits, categories."""
    per_url = chain_hits.groupBy("normalized_url").agg(
        F.count(F.lit(1)).alias("hits"), F.collect_set("category_id").alias("category_ids")
    )
    return chains.select("normalized_url", "status", "redirect_count").join(per_url, "normalized_url", "left")


def scan_summary(occurrences: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts, status and matched categories of each scanned event.

    ``occurrences`` has one row with a null URL for an event without finds. The
    set of URLs of an event is bounded by the cap on finds.
    """
    places = occurrences.select("event_id", "position", "normalized_url")
    joined = spread_join(places, facts, "normalized_url", "left", tie=["event_id", "position"])
    url = F.when(F.col("normalized_url").isNotNull(), F.struct("normalized_url", "status", "redirect_count"))
    grouped = joined.groupBy("event_id").agg(
        F.count("normalized_url").alias("urls_discovered"),
        F.collect_set(url).alias("urls"),
        F.sum(F.coalesce("hits", F.lit(0))).alias("matches_found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col("category_ids"))))).alias("category_ids"),
    )
    redirects = F.aggregate("urls", F.lit(0).cast("bigint"), lambda acc, u: acc + u["redirect_count"])
    failed = F.exists("urls", lambda u: ~u["status"].isin(*SETTLED))
    status = F.when(failed, "partial").when(F.col("matches_found") > 0, "matched").otherwise("clean")
    return grouped.select(
        "event_id", status.alias("status"), "urls_discovered",
        F.size("urls").cast("bigint").alias("urls_resolved"),
        redirects.alias("redirects_followed"), "matches_found", "category_ids",
    )


def scan_id(event_id: str, generation: int):
    return F.concat_ws(":", F.col(event_id), F.lit(generation).cast("string"))


def classify_events(summary: DataFrame) -> DataFrame:
    """One classification per scan and category."""
    return summary.select(
        "scan_id", "event_id", F.explode("category_ids").alias("category_id"), F.lit("current").alias("status")
    )


def scan_articles(events: DataFrame, edges: DataFrame, hits: DataFrame, skip_hosts: DataFrame,
                  generation: int, now: int, limits: Limits = DEFAULTS) -> ScanTables:
    """Scan every event against one state of the policy.

    Texts are read once: the finds are staged and serve both the list of distinct
    URLs and the evidence. ``edges`` (``hop_edges``) and ``hits``
    (``one_hit_per_category``) are staged tables.
    """
    occurrences = stage(extract_urls(events, limits, keep_empty=True), "occurrences")
    urls = occurrences.filter(F.col("normalized_url").isNotNull()).select("normalized_url", "hostname").distinct()
    chains = resolve_redirects(urls, edges, skip_hosts, limits)  # made of staged rounds
    hops = chain_hops(chains)
    chain_hits = stage(match_hops(hops, domain_hits(hits)), "chain-hits")
    facts = stage(url_facts(chains, chain_hits), "url-facts")
    summary = stage(scan_summary(occurrences, facts), "summary")
    named = lambda df: df.withColumn("scan_id", scan_id("event_id", generation))
    scans = named(summary)
    primary = distinct_urls(occurrences)
    resolutions = spread_join(primary, chains.drop("hops"), "normalized_url", "inner", tie=["event_id"])
    found = occurrences.filter(F.col("normalized_url").isNotNull())
    return ScanTables(
        scans=scans.drop("category_ids").withColumns({
            "policy_generation": F.lit(generation).cast("bigint"),
            "started_at": F.lit(now).cast("bigint"), "completed_at": F.lit(now).cast("bigint"),
            "inserted_at": F.lit(now).cast("bigint"),
            "scanner_version": F.lit(limits.scanner_version),
        }),
        occurrences=named(found),
        chains=chains,
        resolutions=named(resolutions),
        hops=hops,
        matches=named(occurrence_matches(occurrences, chain_hits)),
        classifications=classify_events(scans),
    )
