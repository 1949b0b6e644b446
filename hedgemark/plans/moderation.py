"""End-to-end plans: events to article verdicts, targets to target verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.config import DEFAULTS, Limits
from hedgemark.functions.urls import with_normal_url
from hedgemark.operators import events as ev
from hedgemark.operators import policy as pol
from hedgemark.operators import redirects as red
from hedgemark.operators import scan as sc
from hedgemark.operators import state as st
from hedgemark.operators.joins import spread_join
from hedgemark.operators.urls import with_domain, with_normal_host
from hedgemark.sources.tables import stage


@dataclass(frozen=True)
class Policy:
    """One state of the policy, ready for matching."""

    snapshot: DataFrame
    hits: DataFrame
    generation: int
    domain_hits: DataFrame
    domain_lists: DataFrame

    @staticmethod
    def of(snapshot: DataFrame, hits: DataFrame, generation: int) -> Policy:
        """Build the look-up tables once; joins check their size and then read them, so they are staged."""
        return Policy(snapshot, hits, generation, stage(pol.domain_hits(hits), "domain-hits"),
                      stage(pol.domain_lists(snapshot), "domain-lists"))

    @staticmethod
    def load(entries: DataFrame, versions: DataFrame, blocklists: DataFrame,
             categories: DataFrame, generation: int) -> Policy:
        snapshot = stage(pol.policy_snapshot(entries, versions, blocklists, categories), "snapshot")
        return Policy.of(snapshot, stage(pol.one_hit_per_category(snapshot), "hits"), generation)


def target_verdicts(targets: DataFrame, url: str, hits: DataFrame, tie: list[str], limits: Limits = DEFAULTS) -> DataFrame:
    """Verdict of each raw URL by its own domain, without following redirects; unusable ones have ``target_error``."""
    known = with_domain(with_normal_url(targets, url))
    answered = st.without_verdict(
        st.domain_verdicts(known, pol.domain_hits(hits), tie),
        F.when(F.octet_length(url) > limits.max_target_bytes, "url_too_long").when(F.col("normalized_url").isNull(), "invalid_url"))
    return answered.withColumn(
        "verdict", F.when(F.col("target_error").isNotNull(), "invalid").otherwise(
            st.verdict(F.col("status"), F.col("blacklisted")))
    )


def domain_answers(domains: DataFrame, host: str, policy: Policy, tie: list[str]) -> DataFrame:
    """Domain look-ups: verdict, categories and every list that holds the domain.

    A host that is none has ``target_error`` and no verdict: its status and flag are null, not clean.
    """
    known = with_domain(with_normal_host(domains, host))
    answered = st.domain_verdicts(known, policy.domain_hits, tie)
    explained = pol.explain_lists(answered, policy.domain_lists, tie)
    return st.without_verdict(explained, F.when(F.col("hostname").isNull(), "invalid_domain")).withColumn(
        "policy_generation", F.lit(policy.generation).cast("bigint"))


def url_answers(urls: DataFrame, edges: DataFrame, skip_hosts: DataFrame, policy: Policy,
                limits: Limits = DEFAULTS) -> DataFrame:
    """URL look-ups: verdict over the whole chain and the lists that explain it.

    ``urls`` has ``normalized_url, hostname``, one row per URL.
    """
    chains = red.resolve_redirects(urls, edges, skip_hosts, limits)
    verdicts = st.url_verdicts(chains, policy.domain_hits)
    explained = st.explain_chain(chains, policy.domain_lists)
    return with_domain(verdicts.join(urls, "normalized_url").join(explained, "normalized_url")).withColumn(
        "policy_generation", F.lit(policy.generation).cast("bigint"))


def article_verdicts(feed: DataFrame, edges: DataFrame, skip_hosts: DataFrame, policy: Policy,
                     categories: DataFrame, now: int, limits: Limits = DEFAULTS) -> DataFrame:
    """From landed events to the state of every article."""
    events = stage(ev.dedup_events(ev.accepted_events(feed, limits)), "events")
    tables = sc.scan_articles(events, edges, policy.hits, skip_hosts, policy.generation, now, limits)
    return st.article_states(ev.current_revisions(events), tables.scans, tables.classifications, categories)


@dataclass(frozen=True)
class Import:
    """What an import of list bodies adds and decides."""

    decisions: DataFrame
    versions: DataFrame
    entries: DataFrame


def version_id() -> Column:
    """Id of a version, made from its list and content so that runs repeat."""
    return F.sha2(F.concat_ws(":", "blocklist_id", "checksum"), 256)


def import_lists(bodies: DataFrame, active: DataFrame, now: int, limits: Limits = DEFAULTS) -> Import:
    """Parse list bodies, apply the guards, and build the new versions and entries.

    A rejected body yields a failed version and no entries, so the version in force
    stays as it is; a body equal to the one in force (``active_checksum``) yields neither.
    ``active`` has ``blocklist_id, previous_count`` and may have ``active_checksum``.
    """
    rules = stage(pol.distinct_rules(pol.parse_blocklists(bodies, limits)), "rules")
    decisions = stage(pol.import_decision(bodies, rules, active, limits), "decisions")
    versions = decisions.filter("decision <> 'unchanged'").select(
        version_id().alias("version_id"), "blocklist_id", "checksum", "error",
        F.when(F.col("error").isNull(), "validated").otherwise("failed").alias("status"),
        F.when(F.col("error").isNull(), F.col("entry_count")).otherwise(0).alias("entry_count"),
        F.when(F.col("error").isNull(), F.lit(now)).cast("bigint").alias("activated_at"),
    )
    accepted = versions.filter("error is null").select(
        "blocklist_id", F.col("version_id").alias("blocklist_version_id"))
    entries = spread_join(rules, accepted, "blocklist_id", "inner", tie=["line_no"]).select(
        F.concat_ws(":", "blocklist_version_id", "line_no").alias("entry_id"), "blocklist_version_id",
        "rule_type", "normalized_value", "registrable_domain")
    return Import(decisions, versions, entries)
