"""Redirect chains over a log of observed hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.config import DEFAULT_SKIP_HOSTS, DEFAULTS, REDIRECT_STATUSES, Limits
from hedgemark.functions.addresses import has_blocked_address
from hedgemark.functions.hosts import trimmed
from hedgemark.functions.urls import absolute_location, with_normal_url
from hedgemark.operators import joins
from hedgemark.operators.joins import spread_join
from hedgemark.operators.urls import with_normal_host
from hedgemark.sources.tables import merge_rows, stage

SETTLED = ("completed", "skipped_host")
_HOPS = (
    "array<struct<hop_index:int,url:string,hostname:string,resolved_ip:string,http_status:int,"
    "location:string,dns_ms:bigint,connect_ms:bigint,head_ms:bigint>>"
)


def latest_observations(log: DataFrame) -> DataFrame:
    """The newest observation of each URL."""
    rest = [c for c in log.columns if c not in ("url", "observed_at")]
    return log.groupBy("url").agg(
        F.max_by(F.struct(*rest), F.struct("observed_at", F.xxhash64(*rest))).alias("o")
    ).select("url", "o.*")


def default_skip_hosts(current: DataFrame) -> DataFrame:
    """The known skip hosts and the built-in ones; a known host keeps its row."""
    offered = current.sparkSession.createDataFrame([(h,) for h in DEFAULT_SKIP_HOSTS], "host string")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in current.schema if f.name != "host"]
    return merge_rows(current, offered.select("host", *rest).select(*current.columns), ["host"], "ignore")


def parse_skip_hosts(df: DataFrame, value: str) -> DataFrame:
    """Typed hosts or URLs as hosts (column ``host``); null if they are neither."""
    text = trimmed(F.col(value))
    is_url = text.contains("://")
    step = df.withColumns({"__url": F.when(is_url, text), "__host": F.when(~is_url, text)})
    step = with_normal_host(with_normal_url(step, "__url", "__normal", "__from_url"), "__host", "__plain")
    return step.withColumn("host", F.coalesce("__from_url", "__plain")).drop(
        "__url", "__host", "__normal", "__from_url", "__plain")


def flag_skip_hosts(df: DataFrame, skip_hosts: DataFrame, host: str, out: str, tie: list[str]) -> DataFrame:
    """Mark rows whose host is matched but not followed."""
    listed = skip_hosts.select(F.col("host").alias(host)).distinct().withColumn(out, F.lit(True))
    return spread_join(df, listed, host, "left", tie).withColumn(out, F.coalesce(out, F.lit(False)))


def hop_edges(log: DataFrame, skip_hosts: DataFrame, limits: Limits = DEFAULTS,
              allow_loopback: bool = False) -> DataFrame:
    """What visiting each observed URL leads to, worked out once per URL.

    ``outcome`` is the final status, or null for a redirect to ``next_url``.
    """
    seen = latest_observations(log)
    location = F.when(F.octet_length("location") <= limits.max_location_bytes, F.col("location"))
    scheme = F.lower(F.regexp_extract(location, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    step = seen.withColumns({
        "location": location,
        "blocked": has_blocked_address(F.col("ips"), allow_loopback),
        "is_redirect": F.coalesce(F.col("http_status").isin(*REDIRECT_STATUSES), F.lit(False)),
        "target": F.when(scheme.isin("http", "https"), location).when(
            (scheme == "") & (location != ""), absolute_location(F.col("url"), location)
        ),
        "foreign": ~scheme.isin("", "http", "https"),
    })
    step = with_normal_url(step, "target", "next_url", "next_hostname")
    moved = (
        F.when(F.col("location").isNull() | (F.col("location") == ""), "malformed_redirect")
        .when(F.col("foreign"), "unsupported_scheme")
        .when(F.col("next_url").isNull(), "invalid_url")
    )
    outcome = (
        F.when(F.col("blocked"), "blocked_address")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("is_redirect"), moved)
        .otherwise("completed")
    )
    follows = F.col("is_redirect") & ~F.col("blocked") & F.col("error").isNull()
    reached = ~F.col("blocked")
    answered = reached & F.col("error").isNull()
    edges = step.select(
        "url", outcome.alias("outcome"), follows.alias("follows"),
        "next_url", "next_hostname",
        F.when(reached, F.get("ips", F.lit(0))).alias("resolved_ip"),
        F.when(answered, F.col("http_status")).cast("int").alias("http_status"),
        F.when(answered, F.col("location")).alias("location"),
        F.when(reached, F.col("dns_ms")).cast("bigint").alias("dns_ms"),
        F.when(answered, F.col("connect_ms")).cast("bigint").alias("connect_ms"),
        F.when(answered, F.col("head_ms")).cast("bigint").alias("head_ms"),
        F.lit(True).alias("observed"),
    )
    return flag_skip_hosts(edges, skip_hosts, "next_hostname", "next_skip", tie=["url"])


def _hop() -> Column:
    visited = F.col("observed").isNotNull() & ~F.col("skip")
    ms = lambda c: F.when(visited, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    return F.struct(
        F.size("hops").alias("hop_index"), "url", "hostname",
        *[F.when(visited, F.col(c)).alias(c) for c in ("resolved_ip", "http_status", "location")],
        ms("dns_ms"), ms("connect_ms"), ms("head_ms"),
    )


def _step(pending: DataFrame, edges: DataFrame, index: int, limits: Limits,
          unobserved: str, few: bool, broadcast_rows: int, hot_rows: int | None) -> DataFrame:
    """Visit the current URL of every open chain."""
    if few:
        # few chains left: filter the edges in place of shuffling them
        wanted = pending.select("url").distinct()
        near = edges.join(F.broadcast(wanted), "url", "left_semi")
        joined = pending.join(F.broadcast(near), "url", "left")
    else:
        joined = spread_join(pending, edges, "url", "left", ["start_url"], hot_rows, broadcast_rows)
    path = F.transform("hops", lambda h: h["url"])
    loop = F.array_contains(path, F.col("next_url")) | (F.col("next_url") == F.col("url"))
    last = index >= limits.max_redirects
    follows = F.coalesce("follows", F.lit(False))
    status = (
        F.when(F.col("skip"), "skipped_host")
        .when(F.col("observed").isNull(), unobserved)
        .when(follows & F.lit(last), "too_many_redirects")
        .when(F.col("outcome").isNotNull(), F.col("outcome"))
        .when(loop, "redirect_loop")
    )
    done = joined.withColumn("hops", F.concat("hops", F.array(_hop()).cast(_HOPS))).withColumn("status", status)
    return done.withColumn(
        "final_url", F.when(F.col("status") == "redirect_loop", F.col("next_url")).otherwise(F.col("url"))
    )


def resolve_redirects(urls: DataFrame, edges: DataFrame, skip_hosts: DataFrame,
                      limits: Limits = DEFAULTS, unobserved: str = "connection_failure",
                      broadcast_rows: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """The chain of each distinct URL: final status, URL, host and all hops.

    ``urls`` has ``normalized_url, hostname``, one row per URL; ``edges`` comes
    staged from ``hop_edges``. Each round advances only the chains still open, at
    most ``max_redirects + 1`` rounds, and is written before the next one starts.
    """
    broadcast_rows = joins.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    start = urls.select(F.col("normalized_url").alias("start_url"), F.col("normalized_url").alias("url"), "hostname")
    start = flag_skip_hosts(start, skip_hosts, "hostname", "skip", tie=["start_url"])
    pending = stage(start.withColumn("hops", F.array().cast(_HOPS)), "chains-start")
    finished, tail = [], []
    for index in range(limits.max_redirects + 1):
        # reads no more rows than the bound
        open_chains = pending.limit(broadcast_rows + 1).count()
        if open_chains == 0:
            break
        few = open_chains <= broadcast_rows
        if index == 1 and not few:
            # from here on only redirect targets can be visited
            targets = edges.filter("follows").select(F.col("next_url").alias("url")).distinct()
            edges = stage(edges.join(targets, "url", "left_semi"), "edges-targets")
        visited = stage(
            _step(pending, edges, index, limits, unobserved, few, broadcast_rows, hot_rows).select(
                "start_url", "hops", "status", "final_url", "next_url", "next_hostname", "next_skip"
            ),
            f"chains-{index}",
        )
        (tail if few else finished).append(
            visited.filter(F.col("status").isNotNull()).select("start_url", "status", "final_url", "hops"))
        pending = visited.filter(F.col("status").isNull()).select(
            "start_url", F.col("next_url").alias("url"), F.col("next_hostname").alias("hostname"),
            F.coalesce("next_skip", F.lit(False)).alias("skip"), "hops",
        )
    if tail:
        # many small pieces become one table; the large early rounds are not written again
        finished.append(stage(reduce(DataFrame.unionByName, tail), "chains-tail"))
    chains = reduce(DataFrame.unionByName, finished) if finished else pending.select(
        "start_url", F.lit("").alias("status"), F.col("url").alias("final_url"), "hops")
    last = F.element_at("hops", -1)
    total = lambda name: F.aggregate("hops", F.lit(0).cast("bigint"), lambda acc, h: acc + h[name])
    return chains.select(
        F.col("start_url").alias("normalized_url"), "status", "final_url",
        last["hostname"].alias("final_hostname"), last["http_status"].alias("http_status"),
        (F.size("hops") - 1).cast("bigint").alias("redirect_count"),
        F.when(~F.col("status").isin(*SETTLED), F.col("status")).alias("error"),
        total("dns_ms").alias("dns_ms"), total("connect_ms").alias("connect_ms"),
        total("head_ms").alias("head_ms"), "hops",
    )


def chain_hops(chains: DataFrame) -> DataFrame:
    """One row per hop of each chain."""
    return chains.select("normalized_url", F.explode("hops").alias("hop")).select("normalized_url", "hop.*")


def filter_public_addresses(targets: DataFrame, ips: str = "ips", allow_loopback: bool = False) -> DataFrame:
    """Targets none of whose addresses is private, reserved or otherwise not public."""
    return targets.filter(~has_blocked_address(F.col(ips), allow_loopback))


def resolution_timing(chains: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Chains that took long, with where the time went."""
    total = F.col("dns_ms") + F.col("connect_ms") + F.col("head_ms")
    return chains.withColumn("duration_ms", total).filter(F.col("duration_ms") >= limits.slow_url_ms)
