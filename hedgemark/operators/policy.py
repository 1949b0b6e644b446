"""Policy jobs: list parsing, import guards, versions, snapshot, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgemark.config import DEFAULT_CATEGORIES, DEFAULTS, Limits
from hedgemark.functions.hosts import registrable_domain, trimmed
from hedgemark.functions.urls import with_normal_url
from hedgemark.operators.joins import small_side, spread_join
from hedgemark.operators.urls import with_normal_host
from hedgemark.sources.tables import merge_rows

_IP_TOKEN = r"(?i)^((0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}|[0-9a-f]*:[0-9a-f]*:[0-9a-f:.]*)$"
MATCHING_RULES = ("host", "domain")

TOO_LARGE = "download too large"
TOO_MANY = "too many entries"
NO_ENTRIES = "no valid entries"
DECREASE = "suspicious entry count decrease"


# -- import -------------------------------------------------------------------

def body_lines(bodies: DataFrame) -> DataFrame:
    """Rule lines of each body: numbered, trimmed, without blanks and comments."""
    lines = bodies.select(
        "blocklist_id", "format", F.posexplode(F.split("body", "\n")).alias("line_no", "line")
    )
    text = trimmed(F.regexp_replace("line", r"\r+\z", ""))
    return lines.withColumn("line", text).filter(~F.col("line").rlike(r"^(?:[#!]|\z)"))


def parse_blocklists(bodies: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Every valid rule line of every body within the size limit."""
    lines = body_lines(bodies.filter(F.octet_length("body") <= limits.max_list_bytes))
    first = F.regexp_extract("line", r"^(\S+)", 1)
    second = F.regexp_extract("line", r"^\S+\s+(\S+)", 1)
    is_url = F.col("format") == "urls"
    hosts_line = (F.col("format") == "hosts") & (second != "") & first.rlike(_IP_TOKEN)
    token = F.when(hosts_line, second).otherwise(first)
    step = lines.filter(F.col("format").isin("domains", "hosts", "urls")).withColumns({
        "url_token": F.when(is_url, token), "host_token": F.when(~is_url, token),
    })
    step = with_normal_url(step, "url_token", "url_value", "url_host")
    step = with_normal_host(step, "host_token", "host_value")
    rules = step.select(
        "blocklist_id", F.col("line_no").cast("bigint").alias("line_no"),
        F.when(is_url, "url_prefix").when(F.col("format") == "hosts", "host").otherwise("domain").alias("rule_type"),
        F.coalesce("url_value", "host_value").alias("normalized_value"),
        registrable_domain(F.col("host_value")).alias("registrable_domain"),
    )
    return rules.filter(F.col("normalized_value").isNotNull())


def distinct_rules(rules: DataFrame) -> DataFrame:
    """The first line of each rule of a list."""
    return rules.groupBy("blocklist_id", "rule_type", "normalized_value", "registrable_domain").agg(
        F.min("line_no").alias("line_no")
    )


def list_checksums(bodies: DataFrame) -> DataFrame:
    return bodies.select(
        "blocklist_id", F.octet_length("body").cast("bigint").alias("bytes"),
        F.sha2("body", 256).alias("checksum"),
    )


def import_decision(bodies: DataFrame, rules: DataFrame, active: DataFrame,
                    limits: Limits = DEFAULTS) -> DataFrame:
    """Per body: activate it, or why not.

    ``rules`` are the distinct rules; ``active`` has ``blocklist_id`` and the
    ``previous_count`` of the version in force. If it has ``active_checksum`` too, a body
    with that content is ``unchanged``: no error and no new version.
    """
    counts = rules.groupBy("blocklist_id").agg(F.count(F.lit(1)).alias("entry_count"))
    known = F.col("active_checksum") if "active_checksum" in active.columns else F.lit(None).cast("string")
    step = list_checksums(bodies).join(counts, "blocklist_id", "left").join(
        active.select("blocklist_id", "previous_count", known.alias("active_checksum")), "blocklist_id", "left"
    )
    same = F.coalesce(F.col("checksum") == F.col("active_checksum"), F.lit(False))
    n = F.coalesce("entry_count", F.lit(0))
    decrease = (F.col("previous_count") > 0) & (n / F.col("previous_count") < limits.min_size_ratio)
    error = (
        F.when(same, F.lit(None).cast("string"))
        .when(F.col("bytes") > limits.max_list_bytes, TOO_LARGE)
        .when(n > limits.max_list_rules, TOO_MANY)
        .when(n == 0, NO_ENTRIES)
        .when(F.coalesce(decrease, F.lit(False)), DECREASE)
    )
    return step.select(
        "blocklist_id", "bytes", "checksum", n.cast("bigint").alias("entry_count"), "previous_count",
        error.alias("error"),
        F.when(same, "unchanged").when(error.isNull(), "activate").otherwise("reject").alias("decision"),
    )


def is_permanent(error: Column) -> Column:
    return error.startswith(TOO_LARGE) | error.isin(TOO_MANY, NO_ENTRIES, DECREASE)


def failure_class(df: DataFrame, error: str = "error") -> DataFrame:
    """Add ``rejected`` for lasting failures, ``failed`` for those worth a retry."""
    e = F.col(error)
    return df.withColumn(
        "refresh_status", F.when(e.isNull(), "ok").when(is_permanent(e), "rejected").otherwise("failed")
    )


def activate_versions(versions: DataFrame) -> DataFrame:
    """Newest good version of a list becomes active, earlier ones superseded.

    Failed and pending versions change nothing.
    """
    good = F.col("status").isin("validated", "active", "superseded")
    newest = versions.filter(good).groupBy("blocklist_id").agg(
        F.max(F.struct("activated_at", "version_id")).alias("newest")
    ).select("blocklist_id", F.col("newest.version_id").alias("active_version_id"))
    status = (
        F.when(~good, F.col("status"))
        .when(F.col("version_id") == F.col("active_version_id"), "active")
        .otherwise("superseded")
    )
    return spread_join(versions, newest, "blocklist_id", "left", tie=["version_id"]).withColumn("status", status)


def next_generation(generations: DataFrame) -> DataFrame:
    return generations.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).cast("bigint").alias("generation"))


def bump_generation(generations: DataFrame, reason: str, now: int) -> DataFrame:
    """The generation log with one more row for a policy change."""
    row = next_generation(generations).select(
        "generation", F.lit(reason).alias("reason"), F.lit(now).cast("bigint").alias("inserted_at"))
    return generations.unionByName(row)


def due_blocklists(blocklists: DataFrame, now: int, force: bool = False) -> DataFrame:
    """Lists to refresh; a failed or rejected list waits for a person."""
    due = blocklists.filter(
        F.col("enabled") & (F.col("source_type") == "remote")
        & ~F.col("refresh_status").isin("failed", "rejected") & F.col("last_error").isNull()
    )
    if force:
        return due
    return due.filter(F.col("next_refresh_at").isNull() | (F.col("next_refresh_at") <= now))


def finish_refresh(blocklists: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    """Refresh columns of each list after an import."""
    step = failure_class(decisions).select("blocklist_id", "error", F.col("refresh_status").alias("outcome"))
    joined = blocklists.join(step, "blocklist_id", "left")
    tried, good = F.col("outcome").isNotNull(), F.col("outcome") == "ok"
    return joined.withColumns({
        "last_error": F.when(tried, F.col("error")).otherwise(F.col("last_error")),
        "refresh_status": F.coalesce("outcome", "refresh_status"),
        "next_refresh_at": F.when(good, F.lit(now) + F.col("refresh_interval_s")).otherwise(F.col("next_refresh_at")),
    }).drop("error", "outcome")


# -- upkeep -------------------------------------------------------------------

def seed_categories(current: DataFrame) -> DataFrame:
    """The known categories and the built-in ones; a known slug keeps its row."""
    offered = current.sparkSession.createDataFrame(
        [(f"c-{slug}", slug, name, description, enabled, blocks)
         for slug, name, description, enabled, blocks in DEFAULT_CATEGORIES],
        "category_id string, slug string, name string, description string, enabled boolean, blocks_serving boolean",
    )
    return merge_rows(current, offered.select(*current.columns), ["slug"], "ignore")


def backfill_domains(entries: DataFrame) -> DataFrame:
    """Fill missing registrable domains of host and domain rules."""
    missing = F.col("registrable_domain").isNull() & F.col("rule_type").isin(*MATCHING_RULES)
    return entries.withColumn(
        "registrable_domain",
        F.when(missing, registrable_domain(F.col("normalized_value"))).otherwise(F.col("registrable_domain")),
    )


def backfill_pending(entries: DataFrame) -> bool:
    missing = entries.filter(F.col("registrable_domain").isNull() & F.col("rule_type").isin(*MATCHING_RULES))
    return not missing.limit(1).isEmpty()


def dedup_blocklists(blocklists: DataFrame) -> DataFrame:
    """Keep the oldest list per category and name, then per source URL."""
    age = ("inserted_at", "blocklist_id")
    by_name = Window.partitionBy("category_id", "name").orderBy(*age)
    kept = blocklists.withColumn("rn", F.row_number().over(by_name)).filter("rn = 1").drop("rn")
    has_url = F.coalesce(F.col("source_url") != "", F.lit(False))
    by_url = Window.partitionBy("source_url").orderBy(*age)
    with_url = kept.filter(has_url).withColumn("rn", F.row_number().over(by_url)).filter("rn = 1").drop("rn")
    return kept.filter(~has_url).unionByName(with_url)


def drop_rows_of(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent key was not removed."""
    return child.join(small_side(gone.select(key).distinct()), key, "left_anti")


def delete_blocklist(gone: DataFrame, blocklists: DataFrame, versions: DataFrame,
                     entries: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """Every table without the lists in ``gone`` and what hangs on them."""
    versions_gone = versions.join(gone.select("blocklist_id"), "blocklist_id", "left_semi").select(
        F.col("version_id").alias("blocklist_version_id")
    )
    return {
        "blocklists": drop_rows_of(blocklists, gone, "blocklist_id"),
        "versions": drop_rows_of(versions, gone, "blocklist_id"),
        "entries": drop_rows_of(entries, versions_gone, "blocklist_version_id"),
        "matches": drop_rows_of(matches, gone, "blocklist_id"),
    }


def undeletable_categories(categories: DataFrame, blocklists: DataFrame) -> DataFrame:
    """Categories that cannot be removed because lists still use them."""
    return categories.join(blocklists.select("category_id").distinct(), "category_id", "left_semi")


def set_enabled(blocklists: DataFrame, enabled: bool, only: DataFrame | None = None) -> DataFrame:
    """Switch all lists, or the lists in ``only``, on or off."""
    if only is None:
        return blocklists.withColumn("enabled", F.lit(enabled))
    chosen = only.select("blocklist_id").distinct().withColumn("chosen", F.lit(True))
    return blocklists.join(small_side(chosen), "blocklist_id", "left").withColumn(
        "enabled", F.when(F.col("chosen"), F.lit(enabled)).otherwise(F.col("enabled"))
    ).drop("chosen")


def list_categories(categories: DataFrame) -> DataFrame:
    return categories.orderBy("slug")


def list_entries(entries: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """The first entries of every version by value, with their rank."""
    by_value = Window.partitionBy("blocklist_version_id").orderBy("normalized_value", "entry_id")
    return entries.withColumn("rank", F.row_number().over(by_value)).filter(
        F.col("rank") <= limits.listed_entries)


def list_versions(versions: DataFrame) -> DataFrame:
    """The versions of every list, newest first."""
    return versions.orderBy("blocklist_id", F.desc("inserted_at"), "version_id")


def list_blocklists(blocklists: DataFrame, categories: DataFrame, versions: DataFrame) -> DataFrame:
    """Lists by name with their category and active version."""
    cats = categories.select("category_id", F.col("slug").alias("category_slug"))
    vers = versions.select(F.col("version_id").alias("active_version_id"), "entry_count")
    return (
        blocklists.join(cats, "category_id", "left").join(vers, "active_version_id", "left")
        .orderBy("name", "blocklist_id")
    )


# -- matching -----------------------------------------------------------------

def policy_snapshot(entries: DataFrame, versions: DataFrame, blocklists: DataFrame,
                    categories: DataFrame) -> DataFrame:
    """Rules in force, keyed by the domain they block.

    The key is one expression, so every later match is an equi-join.
    """
    lists = blocklists.filter("enabled").select(
        "blocklist_id", F.col("name").alias("list_name"), "category_id",
        F.col("active_version_id").alias("version_id"),
    )
    cats = categories.filter("enabled").select(
        "category_id", F.col("slug").alias("category_slug"), F.col("name").alias("category_name"),
        "blocks_serving",
    )
    in_force = (
        lists.join(cats, "category_id").join(versions.select("version_id", "blocklist_id"), ["version_id", "blocklist_id"])
        .withColumnRenamed("version_id", "blocklist_version_id")
    )
    rules = entries.filter(F.col("rule_type").isin(*MATCHING_RULES)).select(
        "entry_id", "blocklist_version_id",
        F.coalesce("registrable_domain", "normalized_value").alias("domain"),
    )
    return spread_join(rules, in_force, "blocklist_version_id", "inner", tie=["entry_id"])


def one_hit_per_category(snapshot: DataFrame) -> DataFrame:
    """Per domain and category the hit with the smallest list, then entry id."""
    best = snapshot.groupBy("domain", "category_id").agg(
        F.min(F.struct("blocklist_id", "entry_id", "blocklist_version_id")).alias("hit"),
        F.first("category_slug").alias("category_slug"),
        F.first("blocks_serving").alias("blocks_serving"),
    )
    return best.select("domain", "category_id", "category_slug", "blocks_serving", "hit.*")


def domain_hits(hits: DataFrame) -> DataFrame:
    """One row per domain; its array has at most one hit per category."""
    return hits.groupBy("domain").agg(
        F.array_sort(F.collect_list(F.struct(
            "category_id", "category_slug", "blocks_serving", "blocklist_id",
            "blocklist_version_id", "entry_id",
        ))).alias("hits")
    )


def match_targets(targets: DataFrame, hits: DataFrame, tie: list[str]) -> DataFrame:
    """Hit rows of targets with a ``domain``; ``hits`` from ``one_hit_per_category``."""
    return spread_join(targets, hits, "domain", "inner", tie)


def domain_lists(snapshot: DataFrame) -> DataFrame:
    """Per domain every list that holds it, once, by category and name."""
    per_list = snapshot.groupBy("domain", "blocklist_id").agg(
        F.first(F.struct("category_slug", "list_name", "category_name", "blocks_serving")).alias("l")
    )
    return per_list.groupBy("domain").agg(
        F.array_sort(F.collect_list(F.struct(
            "l.category_slug", "l.list_name", "blocklist_id", "l.category_name", "l.blocks_serving",
        ))).alias("lists")
    )


def explain_lists(hosts: DataFrame, lists: DataFrame, tie: list[str]) -> DataFrame:
    """Hosts with a ``domain`` and the array of lists that hit them."""
    joined = spread_join(hosts, lists, "domain", "left", tie)
    return joined.withColumn("lists", F.coalesce("lists", F.array().cast(joined.schema["lists"].dataType)))
