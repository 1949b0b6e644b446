"""Article states, look-ups, target verdicts and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.config import ARTICLE_KIND, DEFAULTS, Limits
from hedgemark.functions.hosts import registrable_domain
from hedgemark.operators.joins import narrowed, spread_join
from hedgemark.operators.redirects import chain_hops
from hedgemark.sources.tables import stage

TERMINAL = ("clean", "matched", "partial", "failed")


# -- articles -----------------------------------------------------------------

def latest_scans(scans: DataFrame) -> DataFrame:
    """The newest scan of each event; equal times are decided by id."""
    rest = [c for c in scans.columns if c != "event_id"]
    return scans.groupBy("event_id").agg(
        F.max_by(F.struct(*rest), F.struct("inserted_at", "scan_id")).alias("s")
    ).select("event_id", "s.*")


def classification_categories(classifications: DataFrame, categories: DataFrame) -> DataFrame:
    """Current classifications whose category is still enabled."""
    enabled = categories.filter("enabled").select("category_id", "slug", "blocks_serving")
    current = classifications.filter(F.col("status") == "current").drop("status")
    # a handful of categories share all rows: never shuffle on this key
    return spread_join(current, enabled, "category_id", "inner", tie=["scan_id"])


def scan_verdicts(scans: DataFrame, classified: DataFrame) -> DataFrame:
    """Public status, categories and the three-valued ``blacklisted`` of each scan."""
    per_scan = classified.groupBy("scan_id").agg(
        F.bool_or("blocks_serving").alias("blocking"),
        F.array_sort(F.collect_set("slug")).alias("categories"),
    )
    open_scan = F.col("status").isin("pending", "running")
    return scans.join(per_scan, "scan_id", "left").withColumns({
        "blacklisted": F.when(~open_scan, F.coalesce("blocking", F.lit(False))),
        "status": F.when(F.col("status").isin(*TERMINAL), F.col("status")).otherwise("pending"),
        "categories": F.coalesce("categories", F.array().cast("array<string>")),
    }).drop("blocking")


def article_states(addresses: DataFrame, scans: DataFrame, classifications: DataFrame,
                   categories: DataFrame) -> DataFrame:
    """The state row of every article from the latest scan of its current event."""
    latest = latest_scans(scans.select("event_id", "scan_id", "status", "policy_generation", "completed_at", "inserted_at"))
    verdicts = scan_verdicts(latest, classification_categories(classifications, categories)).select(
        F.col("event_id").alias("current_event_id"), "scan_id", "status", "blacklisted",
        "categories", "policy_generation", F.col("completed_at").alias("scanned_at"),
    )
    joined = addresses.join(verdicts, "current_event_id", "left")
    return joined.select(
        "kind", "pubkey", "d_tag", "article_address",
        F.col("current_event_id").alias("event_id"),
        F.col("current_event_created_at").alias("event_created_at"), "scan_id",
        F.coalesce("status", F.lit("pending")).alias("status"), "blacklisted",
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        "policy_generation", "scanned_at",
    )


def needs_scan(events: DataFrame, states: DataFrame) -> DataFrame:
    """Events without a final state for this very event."""
    done = states.filter(F.col("status").isin(*TERMINAL)).select("event_id")
    return events.join(done, "event_id", "left_anti")


def rescan_set(events: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """All stored events, or those of a given id list."""
    return events if only is None else events.join(only.select("event_id"), "event_id", "left_semi")


def batch_lookup(keys: DataFrame, addresses: DataFrame, states: DataFrame,
                 limits: Limits = DEFAULTS) -> DataFrame:
    """Answer article keys ``(batch, pos, kind, pubkey, d_tag)``, one row each.

    A batch over the limit and an unsupported kind are errors. Order within a
    batch is given by ``pos``.
    """
    sizes = keys.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limits.lookup_batch)
    asked = spread_join(keys, sizes.select("batch", F.lit(True).alias("oversize")), "batch", "left", tie=["pos"])
    named = F.concat_ws(":", F.col("kind").cast("string"), "pubkey", "d_tag").alias("article")
    known = addresses.select(
        named, "current_event_id", "current_event_created_at", F.lit(True).alias("known"))
    present = states.select(
        named, F.col("status").alias("state"), "blacklisted", "event_id",
        "categories", "scanned_at", "policy_generation",
    )
    # one row per article on the right; an article asked for very often is spread
    joined = spread_join(
        asked.select("*", named), known.join(present, "article", "left"), "article", "left", tie=["batch", "pos"])
    error = F.when(F.col("oversize"), "batch too large").when(F.col("kind") != ARTICLE_KIND, "unsupported kind")
    valid = error.isNull()
    missing = F.when(F.col("known").isNull() | F.col("current_event_id").isNull(), "unknown").otherwise("pending")
    shown = lambda c: F.when(valid, c)
    return joined.select(
        "batch", "pos", "kind", "pubkey", "d_tag", error.alias("error"),
        shown(F.col("article")).alias("article_address"),
        shown(F.coalesce("state", missing)).alias("status"), shown(F.col("blacklisted")).alias("blacklisted"),
        shown(F.when(F.col("state").isNull(), F.col("current_event_id")).otherwise(F.col("event_id"))).alias("event_id"),
        shown(F.col("current_event_created_at")).alias("event_created_at"),
        shown(F.coalesce("categories", F.array().cast("array<string>"))).alias("categories"),
        shown(F.col("scanned_at")).alias("scanned_at"), shown(F.col("policy_generation")).alias("policy_generation"),
    )


def scan_detail(scans: DataFrame, occurrences: DataFrame, resolutions: DataFrame, chains: DataFrame,
                matches: DataFrame, classifications: DataFrame) -> DataFrame:
    """One row per scan with all its evidence nested.

    Every array is bounded by the caps of a scan; the hops of a URL come nested in its chain.
    """
    chain = chains.select("normalized_url", F.transform("hops", lambda h: F.struct(
        h["hop_index"].alias("hop_index"), h["url"].alias("hop_url"), h["hostname"].alias("hostname"),
        h["http_status"].alias("http_status"), h["location"].alias("location"))).alias("hops"))
    placed = spread_join(resolutions, chain, "normalized_url", "left", tie=["event_id"])
    with_hops = placed.groupBy("scan_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "primary_position", "normalized_url", "status", "final_url", "redirect_count", "hops",
        ))).alias("resolutions")
    )
    finds = occurrences.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "normalized_url", "hostname", "source_type"))).alias("occurrences"))
    evidence = matches.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "hop_index", "category_id", "blocklist_id", "matched_hostname"))).alias("matches"))
    labels = classifications.groupBy("scan_id").agg(F.array_sort(F.collect_set("category_id")).alias("categories"))
    detail = scans
    for child in (finds, with_hops, evidence, labels):
        detail = detail.join(child, "scan_id", "left")
    return detail


def event_detail(events: DataFrame, relays: DataFrame, details: DataFrame) -> DataFrame:
    """Stored events with their relays and all their scans, oldest first, each with its evidence.

    ``details`` is ``scan_detail`` with ``event_id, inserted_at, scan_id``. An event has as many
    scans as it was scanned times, each of bounded size.
    """
    first = ["inserted_at", "scan_id"]
    rest = [c for c in details.columns if c not in ("event_id", *first)]
    nested = details.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("scans"))
    sources = relays.groupBy("event_id").agg(F.array_sort(F.collect_set("relay_url")).alias("relays"))
    joined = events.join(sources, "event_id", "left").join(nested, "event_id", "left")
    return joined.withColumn("scans", F.coalesce("scans", F.array().cast(joined.schema["scans"].dataType)))


def recent_events(events: DataFrame, relays: DataFrame, scans: DataFrame,
                  limits: Limits = DEFAULTS) -> DataFrame:
    """The last seen events with their relays and their scans, oldest first.

    The top rows are chosen first; only their children are then read.
    """
    top = events.orderBy(F.desc("last_seen_at"), "event_id").limit(limits.recent_events).select(
        "event_id", "kind", "article_address", "last_seen_at"
    )
    # at most ``recent_events`` rows
    ids = F.broadcast(top.select("event_id"))
    sources = relays.join(ids, "event_id", "left_semi").groupBy("event_id").agg(
        F.array_sort(F.collect_set("relay_url")).alias("relays"))
    known = scans.join(ids, "event_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_list(
        F.struct("inserted_at", "scan_id", "status", "policy_generation", "completed_at"))).alias("scans"))
    joined = top.join(sources, "event_id", "left").join(known, "event_id", "left")
    return joined.withColumn("scans", F.coalesce("scans", F.array().cast(joined.schema["scans"].dataType)))


def recent_matches(matches: DataFrame, categories: DataFrame, blocklists: DataFrame, scans: DataFrame,
                   limits: Limits = DEFAULTS) -> DataFrame:
    """The newest evidence rows with category, list and scan status."""
    top = stage(matches.orderBy(
        F.desc("inserted_at"), "scan_id", "position", "hop_index", "category_id"
    ).limit(limits.recent_matches), "recent-matches")
    scans = scans.join(F.broadcast(top.select("scan_id").distinct()), "scan_id", "left_semi")
    return (
        top.join(categories.select("category_id", "slug"), "category_id", "left")
        .join(blocklists.select("blocklist_id", F.col("name").alias("list_name")), "blocklist_id", "left")
        .join(scans.select("scan_id", F.col("status").alias("scan_status")), "scan_id", "left")
    )


def dashboard_stats(events: DataFrame, scans: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts of events, scans, matched scans and evidence rows in one row."""
    def tally(df: DataFrame, name: str, flag: Column | None = None) -> DataFrame:
        hit = F.count_if(flag) if flag is not None else F.lit(0)
        return df.agg(F.count(F.lit(1)).alias("n"), hit.alias("m")).withColumn("what", F.lit(name))

    parts = tally(events, "events").unionByName(
        tally(scans, "scans", F.col("status") == "matched")).unionByName(tally(matches, "matches"))
    pick = lambda name, c: F.sum(F.when(F.col("what") == name, F.col(c))).cast("bigint")
    return parts.agg(
        pick("events", "n").alias("events"), pick("scans", "n").alias("scans"),
        pick("scans", "m").alias("matched"), pick("matches", "n").alias("matches"),
    )


# -- domains and URLs -----------------------------------------------------------

def verdict(status: Column, blacklisted: Column) -> Column:
    return F.when(blacklisted, "blocked").when(status == "matched", "listed").otherwise("clean")


def _answered(df: DataFrame) -> DataFrame:
    hits = F.coalesce(F.col("hits"), F.array().cast(df.schema["hits"].dataType))
    status = F.when(F.size(hits) > 0, "matched").otherwise("clean")
    return df.withColumns({
        "status": status,
        "blacklisted": F.exists(hits, lambda h: h["blocks_serving"]),
        "categories": F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["category_slug"]))),
    }).drop("hits")


def without_verdict(answered: DataFrame, error: Column) -> DataFrame:
    """Add ``target_error``; where there is one, nothing is known, so status and flag are null."""
    known = F.col("target_error").isNull()
    return answered.withColumn("target_error", error).withColumns({
        "status": F.when(known, F.col("status")), "blacklisted": F.when(known, F.col("blacklisted"))})


def domain_verdicts(targets: DataFrame, hits: DataFrame, tie: list[str]) -> DataFrame:
    """Verdict of each target with a ``domain``; ``hits`` from ``domain_hits``."""
    return _answered(spread_join(targets, hits, "domain", "left", tie))


def _chain_arrays(chains: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Per URL the union over its hop hosts of an array held per domain."""
    hosts = chain_hops(chains).select("normalized_url", registrable_domain(F.col("hostname")).alias("domain"))
    hosts = hosts.filter("domain is not null")
    met = narrowed(hosts, right, "domain", f"{column}-met")
    joined = spread_join(hosts, met, "domain", "inner", tie=["normalized_url"])
    return joined.groupBy("normalized_url").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column)
    )


def url_verdicts(chains: DataFrame, hits: DataFrame) -> DataFrame:
    """Verdict of each resolved URL over all its hops."""
    step = chains.join(_chain_arrays(chains, hits, "hits"), "normalized_url", "left")
    return _answered(step.drop("hops").withColumnRenamed("status", "chain_status"))


def explain_chain(chains: DataFrame, lists: DataFrame) -> DataFrame:
    """Per URL its hosts, every list that hits one of them, once, and for each host its domain and lists.

    ``explained`` keeps the order in which the chain met the hosts; a host that no list hits has no lists.
    """
    hosts = F.filter(F.array_distinct(F.transform("hops", lambda h: h["hostname"])), lambda h: h != "")
    met = chains.select("normalized_url", hosts.alias("hosts"))
    placed = met.select("normalized_url", F.posexplode("hosts").alias("pos", "host")).withColumn(
        "domain", registrable_domain(F.col("host")))
    found = narrowed(placed, lists, "domain", "lists-met")
    each = spread_join(placed, found, "domain", "left", tie=["normalized_url", "pos"])
    own = F.coalesce("lists", F.array().cast(lists.schema["lists"].dataType))
    nested = each.groupBy("normalized_url").agg(F.array_sort(F.collect_list(
        F.struct("pos", "host", "domain", F.array_sort(F.array_distinct(own)).alias("lists")))).alias("explained"))
    merged = F.array_sort(F.array_distinct(F.flatten(F.transform("explained", lambda e: e["lists"]))))
    return met.join(nested, "normalized_url", "left").withColumn("lists", F.when(F.size(merged) > 0, merged))


def _part(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def target_fingerprint(domain: Column, final_url: Column, generation: Column, resolution: Column,
                       categories: Column, list_ids: Column) -> Column:
    """Hash of what identifies a target result; missing parts count as empty."""
    parts = [
        _part(domain), _part(final_url), _part(generation), _part(resolution),
        F.coalesce(F.array_join(categories, ","), F.lit("")),
        F.coalesce(F.array_join(list_ids, ","), F.lit("")),
    ]
    return F.sha2(F.concat_ws(":", *parts), 256)


def article_fingerprint(event_id: Column, scan_id: Column, generation: Column) -> Column:
    return F.sha2(F.concat_ws(":", _part(event_id), _part(scan_id), _part(generation)), 256)


def changed_results(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose fingerprint is new or differs from the last snapshot."""
    return current.join(previous.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")
