"""Every job as a named query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgemark.functions.addresses import address_classes
from hedgemark.operators import audit, constraints, events as ev, labels as lab
from hedgemark.operators import policy as pol, ranges as rng, redirects as red, scan as sc, state as st
from hedgemark.operators import urls as url_jobs
from hedgemark.plans import inputs as inp, moderation as mod
from hedgemark.session import prepare
from hedgemark.sources import buckets, feeds, tables as tb
from hedgemark.streaming import jobs as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _flat(df: DataFrame) -> DataFrame:
    """Arrays of text as one text and whole numbers as BIGINT, for comparison."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _flat(fn(prepare(spark), sf))

    QUERIES[fn.__name__] = run
    return run


def _path(spark: SparkSession, name: str) -> str:
    import uuid
    return f"{tb.run_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


_policies: dict[tuple[str, str], mod.Policy] = {}


def _policy(spark: SparkSession, sf: str) -> mod.Policy:
    key = (tb.run_dir(spark), sf)
    if key not in _policies:
        _policies[key] = mod.Policy.of(inp.snapshot(spark, sf), inp.hits(spark, sf), inp.GENERATION)
    return _policies[key]


# -- sources and sinks ------------------------------------------------------------

@query
def read_events(spark, sf):
    return inp.feed(spark, sf).select(
        "relay", "received_at",
        F.try_variant_get("event", "$.id", "string").alias("event_id"),
        F.try_variant_get("event", "$.sig", "string").alias("sig"),
    )


@query
def read_blocklist_bodies(spark, sf):
    path = _path(spark, "bodies")
    feeds.write_list_bodies(inp.bodies(spark, sf), path)
    return feeds.read_list_bodies(spark, path, inp.GUARD).select(
        "blocklist_id", "bytes", F.sha2("body", 256).alias("checksum"))


@query
def write_entries(spark, sf):
    path = _path(spark, "entries")
    tb.write_entries(inp.entries(spark, sf), path)
    return spark.read.parquet(path).groupBy("blocklist_version_id", "rule_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("normalized_value").alias("first_value"))


@query
def upsert_table(spark, sf):
    """Oldest event per article first, then the current one takes over two columns."""
    stored = inp.stored(spark, sf).filter("d_tag is not null")
    oldest = stored.groupBy("article_address").agg(F.min(F.struct("created_at", "event_id")).alias("o"))
    current = oldest.select(
        "article_address", F.col("o.event_id").alias("first_event_id"),
        F.col("o.event_id").alias("current_event_id"), F.col("o.created_at").alias("current_event_created_at"))
    changes = inp.addresses(spark, sf).select(
        "article_address", F.lit(None).cast("string").alias("first_event_id"),
        "current_event_id", "current_event_created_at")
    return tb.merge_rows(current, changes, ["article_address"], "replace", ["current_event_id", "current_event_created_at"])


@query
def upsert_ignore(spark, sf):
    """Offered hosts added to the known skip hosts; a known host keeps its row."""
    known = inp.skip_hosts(spark, sf).withColumn("origin", F.lit("known"))
    offered = inp.page_urls(spark, sf).filter("hostname is not null").select("hostname").distinct().select(
        F.col("hostname").alias("host"), F.lit("offered").alias("origin"))
    return tb.merge_rows(known, offered, ["host"], "ignore")


@query
def write_moderation_results(spark, sf):
    path = _path(spark, "results")
    public = inp.states(spark, sf).select(
        "article_address", "blacklisted", "status", "event_id", "event_created_at", "categories",
        "scanned_at", "policy_generation")
    public.write.json(path)
    return spark.read.schema(public.schema).json(path)


@query
def write_target_results(spark, sf):
    path = _path(spark, "target-results")
    public = _page_answers(spark, sf).select(
        F.col("hostname").alias("domain"), F.col("domain").alias("registrable_domain"), F.col("normalized_url").alias("url"),
        "final_url", F.col("final_hostname").alias("final_domain"), "redirect_count",
        F.col("chain_status").alias("resolution_status"), "blacklisted", "status", "categories",
        F.transform("lists", lambda l: l["list_name"]).alias("lists"), "policy_generation")
    public.write.parquet(path)
    return spark.read.parquet(path)


@query
def write_label_drafts(spark, sf):
    path = _path(spark, "drafts")
    lab.write_label_drafts(lab.label_drafts(_plan(spark, sf), inp.NAMESPACE), path)
    drafts = spark.read.schema("kind bigint, content string, tags array<array<string>>").json(path)
    return drafts.select("kind", "content", F.array_join(F.transform("tags", lambda t: F.array_join(t, "|")), ";").alias("tags"))


# -- projections and filters --------------------------------------------------------

@query
def validate_events(spark, sf):
    return ev.check_events(inp.feed(spark, sf), inp.GUARD).select(
        F.try_variant_get("event", "$.id", "string").alias("event_id"), "relay", "received_at",
        F.coalesce("reason", F.lit("accepted")).alias("outcome"))


@query
def recompute_event_ids(spark, sf):
    return ev.recompute_event_ids(inp.feed(spark, sf)).filter("event is not null").select(
        "event_id", "computed_id", "id_matches", "relay")


@query
def derive_addresses(spark, sf):
    return ev.derive_addresses(inp.stored(spark, sf).drop("d_tag", "article_address")).select(
        "event_id", "d_tag", "article_address")


@query
def ingest_filter(spark, sf):
    return ev.ingest_filter(inp.valid(spark, sf), inp.NOW, inp.LIMITS).select(
        "relay", "event_id", "created_at", "rank")


@query
def extract_urls(spark, sf):
    return url_jobs.extract_urls(inp.stored(spark, sf))


@query
def normalize_urls(spark, sf):
    good, bad = url_jobs.normalize_urls(inp.raw_urls(spark, sf), "raw_url")
    return good.select("page_id", "normalized_url", "hostname", F.lit(True).alias("valid")).unionByName(
        bad.select("page_id", F.lit(None).cast("string").alias("normalized_url"),
                   F.lit(None).cast("string").alias("hostname"), F.lit(False).alias("valid")))


@query
def registrable_domains(spark, sf):
    return url_jobs.count_domains(inp.page_urls(spark, sf).filter("hostname is not null"))


@query
def classify_targets(spark, sf):
    n = F.col("page_id")
    asked = inp.raw_urls(spark, sf).withColumn(
        "query",
        F.when(n % 6 == 1, F.regexp_extract("url", r"^https?://([^/]+)", 1))
        .when(n % 6 == 2, F.regexp_replace("raw_url", r"^[a-zA-Z]+://", ""))
        .when(n % 6 == 3, F.lit("   ")).when(n % 6 == 4, F.repeat("raw_url", 100)).otherwise(F.col("raw_url")))
    return url_jobs.classify_targets(asked, "query").select("page_id", "target_kind", "target", "target_error")


@query
def filter_public_addresses(spark, sf):
    return red.filter_public_addresses(inp.observations(spark, sf)).select("url", "observed_at")


@query
def skip_hosts(spark, sf):
    urls = inp.page_urls(spark, sf).filter("normalized_url is not null")
    return red.flag_skip_hosts(urls, inp.skip_hosts(spark, sf), "hostname", "skipped", ["page_id"]).select(
        "page_id", "hostname", "skipped")


@query
def parse_blocklists(spark, sf):
    return pol.parse_blocklists(inp.bodies(spark, sf))


@query
def due_blocklists(spark, sf):
    registry = inp.registry(spark, sf)
    now = inp.BASE + 3_000
    due = pol.due_blocklists(registry, now).select("blocklist_id", F.lit(False).alias("forced"))
    forced = pol.due_blocklists(registry, now, force=True).select("blocklist_id", F.lit(True).alias("forced"))
    return due.unionByName(forced)


@query
def failure_class(spark, sf):
    failed = pol.failure_class(inp.version_log(spark, sf))
    return failed.groupBy("refresh_status", "error").agg(F.count(F.lit(1)).alias("n"))


@query
def check_constraints(spark, sf):
    return constraints.check_constraints({
        "categories": inp.categories(spark, sf), "blocklists": inp.registry(spark, sf),
        "versions": inp.version_log(spark, sf), "entries": inp.entries(spark, sf),
        "relays": inp.relays(spark, sf), "scans": inp.scan_log(spark, sf),
    })


@query
def locked_slugs(spark, sf):
    before = inp.categories(spark, sf)
    after = before.withColumn("slug", F.concat("slug", F.lit("-new")))
    return constraints.locked_slug_changes(before, after, inp.labels(spark, sf))


@query
def backfill_domains(spark, sf):
    return pol.backfill_domains(inp.entries(spark, sf)).select("entry_id", "rule_type", "registrable_domain")


@query
def result_fingerprints(spark, sf):
    answers = _domain_answers(spark, sf)
    none = F.lit(None).cast("string")
    return answers.select("page_id", st.target_fingerprint(
        F.col("domain"), none, F.col("policy_generation"), none, F.col("categories"),
        F.transform("lists", lambda l: l["blocklist_id"])).alias("fingerprint"))


@query
def changed_articles(spark, sf):
    """Articles whose result differs from a snapshot without the newest generation."""
    mark = lambda df: df.withColumn("fingerprint", st.article_fingerprint(
        F.col("event_id"), F.col("scan_id"), F.col("policy_generation")))
    before = st.article_states(
        inp.addresses(spark, sf), inp.scan_log(spark, sf).filter(F.col("policy_generation") <= inp.GENERATION),
        inp.classification_log(spark, sf), inp.categories(spark, sf))
    return st.changed_results(mark(inp.states(spark, sf)), mark(before), ["article_address"]).select(
        "article_address", "fingerprint")


@query
def article_change_feed(spark, sf):
    """Results that came, went or changed between two snapshots, by the digests of their buckets.

    The earlier one lacks the events of one first digit and knows no newest generation; the later one lacks those of another.
    """
    states, first = inp.states(spark, sf), F.substring("event_id", 1, 1)
    def written(df, generation, name):
        path = _path(spark, name)
        marked = df.withColumn("fingerprint", st.article_fingerprint(F.col("event_id"), F.col("scan_id"), generation))
        buckets.write_bucketed(marked.select("article_address", "fingerprint"), path, ["article_address"], 64)
        return path
    now = F.col("policy_generation")
    before = written(states.where(first != "0"), F.when(now > inp.GENERATION, inp.GENERATION).otherwise(now), "results-before")
    after = written(states.where(first != "1"), now, "results-after")
    feed = buckets.change_feed(spark, before, after, ["article_address"])
    return feed.select("article_address", "kind", F.col("before.fingerprint").alias("old"), F.col("after.fingerprint").alias("new"))


@query
def verdicts(spark, sf):
    targets = mod.target_verdicts(inp.raw_urls(spark, sf), "raw_url", inp.hits(spark, sf), ["page_id"])
    return targets.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# -- joins --------------------------------------------------------------------------

@query
def policy_snapshot(spark, sf):
    return pol.policy_snapshot(
        inp.entries(spark, sf), inp.versions(spark, sf), inp.blocklists(spark, sf), inp.categories(spark, sf)
    ).select("entry_id", "domain", "blocklist_version_id", "blocklist_id", "list_name", "category_slug", "blocks_serving")


@query
def match_targets(spark, sf):
    targets = url_jobs.with_domain(inp.page_urls(spark, sf)).filter("normalized_url is not null")
    return pol.match_targets(targets.select("page_id", "domain"), inp.hits(spark, sf), ["page_id"]).select(
        "page_id", "domain", "category_id", "blocklist_id", "blocklist_version_id", "entry_id")


@query
def explain_lists(spark, sf):
    hosts = url_jobs.with_domain(inp.page_urls(spark, sf).filter("hostname is not null")).select("page_id", "hostname", "domain")
    explained = pol.explain_lists(hosts, pol.domain_lists(inp.snapshot(spark, sf)), ["page_id"])
    return explained.withColumn("lists", F.transform("lists", lambda l: F.concat_ws(":", l["category_slug"], l["list_name"])))


@query
def match_hops(spark, sf):
    return inp.scan(spark, sf).matches.select(
        "scan_id", "position", "hop_index", "matched_url", "matched_hostname", "category_id",
        "blocklist_id", "blocklist_version_id", "entry_id", "match_type")


@query
def classification_categories(spark, sf):
    return st.classification_categories(inp.classification_log(spark, sf), inp.categories(spark, sf)).select(
        "scan_id", "category_id", "slug", "blocks_serving")


@query
def article_states(spark, sf):
    return st.article_states(
        inp.addresses(spark, sf), inp.scan_log(spark, sf), inp.classification_log(spark, sf),
        inp.categories(spark, sf)).drop("kind", "pubkey", "d_tag")


@query
def needs_scan(spark, sf):
    return st.needs_scan(inp.stored(spark, sf), inp.states(spark, sf)).select("event_id")


@query
def current_policy_rescan(spark, sf):
    """All stored events, and those of a list of ids: the articles still pending."""
    pending = inp.states(spark, sf).filter("status = 'pending'")
    every = st.rescan_set(inp.stored(spark, sf)).select("event_id", F.lit("existing").alias("mode"))
    return every.unionByName(
        st.rescan_set(inp.stored(spark, sf), pending).select("event_id", F.lit("listed").alias("mode")))


@query
def ip_ranges(spark, sf):
    log = inp.observations(spark, sf).withColumn("class", address_classes(F.col("ips")))
    return log.select("url", F.explode(F.arrays_zip("ips", "class")).alias("z")).select(
        "url", F.col("z.ips").alias("ip"), F.col("z.class").alias("class"))


@query
def narrowest_ranges(spark, sf):
    """Addresses of all order lines against a range table with one row per order."""
    found = rng.narrowest_ranges(inp.range_addresses(spark, sf), inp.address_ranges(spark, sf), "ip", ["orderkey", "linenumber"])
    return found.select("orderkey", "linenumber", "ip", F.col("range.range_id"), F.col("range.cidr"))


@query
def resolve_redirects(spark, sf):
    urls = inp.page_urls(spark, sf).filter("normalized_url is not null").select("normalized_url", "hostname").distinct()
    chains = red.resolve_redirects(urls, inp.edges(spark, sf), inp.skip_hosts(spark, sf))
    return chains.select(
        "normalized_url", "status", "final_url", "final_hostname", "http_status", "redirect_count", "error",
        F.transform("hops", lambda h: h["url"]).alias("hops"))


def _listed(column: str, text) -> Column:
    """An array as one text, in its own order; empty if missing."""
    return F.coalesce(F.array_join(F.transform(column, text), ";"), F.lit(""))


def _spelled(*parts) -> Column:
    return F.concat_ws("=", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


@query
def event_detail(spark, sf):
    """All scans of all events with the contents of their evidence, as one text per event."""
    s = inp.scan(spark, sf)
    logged = inp.scan_log(spark, sf).select("scan_id", "event_id", "inserted_at", "status", "policy_generation")
    details = st.scan_detail(logged, s.occurrences, s.resolutions, s.chains, s.matches, inp.classification_log(spark, sf))
    detail = st.event_detail(
        inp.stored(spark, sf).select("event_id", "article_address"), ev.event_relays(inp.valid(spark, sf)), details)
    one = lambda scan: F.concat_ws(
        "|", scan["scan_id"], scan["status"], scan["policy_generation"].cast("string"),
        _listed(scan["occurrences"], lambda o: _spelled(o["position"], o["normalized_url"], o["source_type"])),
        _listed(scan["resolutions"], lambda r: _spelled(
            r["primary_position"], r["normalized_url"], r["status"], r["final_url"], r["redirect_count"],
            F.array_join(F.transform(r["hops"], lambda h: h["hop_url"]), ">"))),
        _listed(scan["matches"], lambda m: _spelled(
            m["position"], m["hop_index"], m["category_id"], m["blocklist_id"], m["matched_hostname"])),
        F.coalesce(F.array_join(scan["categories"], ","), F.lit("")))
    text = F.array_join(F.transform("scans", one), "\n")
    return detail.select(
        "event_id", "article_address", "relays", F.size("scans").alias("scans"), F.length(text).alias("letters"),
        F.sha2(text, 256).alias("content"))


@query
def batch_lookup(spark, sf):
    return st.batch_lookup(inp.lookup_keys(spark, sf), inp.addresses(spark, sf), inp.states(spark, sf), inp.LIMITS).drop(
        "pubkey", "d_tag")


@query
def delete_blocklist(spark, sf):
    gone = inp.blocklists(spark, sf).filter("name = 'adult-primary'")
    kept = pol.delete_blocklist(
        gone, inp.blocklists(spark, sf), inp.versions(spark, sf), inp.entries(spark, sf), inp.scan(spark, sf).matches)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name)) for name, df in kept.items()]
    held = pol.undeletable_categories(inp.categories(spark, sf), kept["blocklists"])
    parts.append(held.agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("held_categories")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def disable_list(spark, sf):
    """Matches left when one list is switched off, and when all are."""
    only = inp.blocklists(spark, sf).filter("name = 'adult-primary'")
    def left(lists, label):
        snap = pol.policy_snapshot(inp.entries(spark, sf), inp.versions(spark, sf), lists, inp.categories(spark, sf))
        return snap.agg(F.count(F.lit(1)).alias("rules"), F.count_distinct("domain").alias("domains")).withColumn("case", F.lit(label))
    lists = inp.blocklists(spark, sf)
    return left(pol.set_enabled(lists, False, only), "one_off").unionByName(left(pol.set_enabled(lists, False), "all_off"))


@query
def domain_tree_match(spark, sf):
    domains = inp.entries(spark, sf).filter("rule_type <> 'url_prefix'").select(F.col("normalized_value").alias("domain"))
    hosts = inp.page_urls(spark, sf).filter("hostname is not null").select("page_id", "hostname")
    return url_jobs.domain_tree_match(hosts, domains, ["page_id"])


@query
def stale_labels(spark, sf):
    rescanned = inp.addresses(spark, sf).select(F.col("current_event_id").alias("event_id"))
    return lab.stale_labels(
        inp.labels(spark, sf), inp.scan_log(spark, sf), inp.classification_log(spark, sf), rescanned
    ).select("label_id", "event_id", "category_id", "status")


def _plan(spark, sf):
    return lab.label_plan(
        inp.classification_log(spark, sf), inp.categories(spark, sf), ev.event_relays(inp.valid(spark, sf)), inp.labels(spark, sf))


@query
def label_plan(spark, sf):
    return _plan(spark, sf).select("event_id", "category_id", "slug", "source_relay", "action")


@query
def fetch_newest_match(spark, sf):
    keys = inp.lookup_keys(spark, sf).withColumn("pubkey", F.upper("pubkey"))
    return ev.fetch_newest_match(keys.select("pos", "kind", "pubkey", "d_tag"), inp.stored(spark, sf)).select(
        "pos", "event_id", "created_at")


# -- aggregations --------------------------------------------------------------------

@query
def dedup_events(spark, sf):
    return ev.dedup_events(inp.valid(spark, sf)).select("event_id", "first_seen_at", "last_seen_at", "relays", F.sha2("content", 256).alias("content_hash"))


@query
def current_revisions(spark, sf):
    return ev.current_revisions(inp.stored(spark, sf)).select(
        "article_address", "current_event_id", "current_event_created_at")


def _rules(spark, sf):
    return pol.distinct_rules(pol.parse_blocklists(inp.bodies(spark, sf), inp.GUARD))


@query
def distinct_rules(spark, sf):
    return pol.distinct_rules(pol.parse_blocklists(inp.bodies(spark, sf), inp.LIMITS))


@query
def import_decision(spark, sf):
    return pol.import_decision(inp.bodies(spark, sf), _rules(spark, sf), inp.previous_counts(spark, sf), inp.GUARD)


@query
def distinct_urls(spark, sf):
    return sc.distinct_urls(inp.scan(spark, sf).occurrences)


@query
def scan_summary(spark, sf):
    return inp.scan(spark, sf).scans.select(
        "scan_id", "event_id", "status", "urls_discovered", "urls_resolved", "redirects_followed", "matches_found")


@query
def classify_events(spark, sf):
    return inp.scan(spark, sf).classifications


@query
def one_hit_per_category(spark, sf):
    return pol.one_hit_per_category(inp.snapshot(spark, sf))


@query
def article_verdict(spark, sf):
    classified = st.classification_categories(inp.classification_log(spark, sf), inp.categories(spark, sf))
    return st.scan_verdicts(inp.scan_log(spark, sf), classified).select("scan_id", "status", "blacklisted", "categories")


def _domain_answers(spark, sf):
    asked = inp.raw_urls(spark, sf).select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    n = F.col("page_id")
    own = F.when(n % 40 == 5, "not a host").when(n % 40 == 15, "").when(n % 40 == 25, F.lit(None).cast("string")).otherwise(
        F.replace(F.col("host"), F.lit(".example."), F.lit("-example.")))
    return mod.domain_answers(asked.withColumn("query", F.upper(own)), "query", _policy(spark, sf), ["page_id"])


@query
def target_verdict(spark, sf):
    return _domain_answers(spark, sf).withColumn("lists", F.transform("lists", lambda l: l["list_name"])).select(
        "page_id", "hostname", "domain", "target_error", "status", "blacklisted", "categories", "lists", "policy_generation")


def _page_answers(spark, sf):
    urls = inp.page_urls(spark, sf).filter("normalized_url is not null").select("normalized_url", "hostname").distinct()
    return inp.shared(spark, sf, "url_answers", lambda: mod.url_answers(
        urls, inp.edges(spark, sf), inp.skip_hosts(spark, sf), _policy(spark, sf)))


@query
def url_verdict(spark, sf):
    return _page_answers(spark, sf).select(
        "normalized_url", "domain", F.col("status"), "blacklisted", "categories", "final_url", "redirect_count")


@query
def explain_chain(spark, sf):
    named = lambda lists: F.transform(lists, lambda l: F.concat_ws(":", l["category_slug"], l["list_name"]))
    host = lambda e: F.concat_ws("=", e["host"], F.coalesce(e["domain"], F.lit("")), F.array_join(named(e["lists"]), "+"))
    return _page_answers(spark, sf).select(
        "normalized_url", "hosts", F.coalesce(named("lists"), F.array().cast("array<string>")).alias("lists"),
        F.transform("explained", host).alias("explained"))


@query
def dashboard_stats(spark, sf):
    return st.dashboard_stats(inp.stored(spark, sf), inp.scan_log(spark, sf), inp.scan(spark, sf).matches)


@query
def ingest_counters(spark, sf):
    return ev.ingest_counters(ev.check_events(inp.feed(spark, sf), inp.GUARD))


@query
def label_delivery_status(spark, sf):
    return lab.label_delivery_status(inp.labels(spark, sf), inp.deliveries(spark, sf), inp.relays(spark, sf)).select("label_id", "status")


@query
def next_generation(spark, sf):
    return pol.next_generation(inp.scan_log(spark, sf).select(F.col("policy_generation").alias("generation")))


@query
def bump_generation(spark, sf):
    log = inp.scan_log(spark, sf).select(F.col("policy_generation").alias("generation")).distinct().select(
        "generation", F.lit("invalidate").alias("reason"), F.col("generation").alias("inserted_at"))
    return pol.bump_generation(log, "list switched off", inp.NOW)


@query
def skip_host_values(spark, sf):
    """Typed skip hosts: plain hosts, URLs and text that is neither."""
    n = F.col("page_id")
    typed = inp.raw_urls(spark, sf).select(
        "page_id", F.when(n % 3 == 0, F.concat(F.lit("  "), F.upper(F.regexp_extract("url", r"^https?://([^/]+)", 1)), F.lit(". ")))
        .when(n % 3 == 1, F.col("raw_url")).when(n % 2 == 0, "not a host").otherwise("").alias("value"))
    return red.parse_skip_hosts(typed, "value").select("page_id", "host")


@query
def resolution_timing(spark, sf):
    return red.resolution_timing(inp.scan(spark, sf).chains).select(
        "normalized_url", "final_hostname", "dns_ms", "connect_ms", "head_ms", "duration_ms")


@query
def refresh_outcome(spark, sf):
    """All registered lists after a refresh: new, rejected, unchanged and those that offered nothing."""
    active = inp.checksums_in_force(spark, sf)
    decisions = pol.import_decision(inp.bodies(spark, sf), _rules(spark, sf), active, inp.GUARD)
    after = pol.finish_refresh(inp.registry(spark, sf), decisions.drop("checksum"), inp.NOW)
    return after.join(decisions.select("blocklist_id", "decision"), "blocklist_id", "left").select(
        "blocklist_id", "decision", "refresh_status", "last_error", "next_refresh_at")


@query
def seed_categories(spark, sf):
    """The built-in categories beside those made from the languages of the documents; English is the adult one."""
    slug = F.when(F.col("lang") == "en", "adult").otherwise(F.col("lang"))
    known = inp.table(spark, sf, "documents").filter("lang is not null").select(slug.alias("slug")).distinct().select(
        F.concat(F.lit("own-"), "slug").alias("category_id"), "slug", F.upper("slug").alias("name"), F.lit("").alias("description"),
        F.lit(False).alias("enabled"), F.lit(False).alias("blocks_serving"))
    return pol.seed_categories(known).drop("description")


@query
def seed_skip_hosts(spark, sf):
    """The built-in skip hosts beside all hosts of pages."""
    hosts = inp.page_urls(spark, sf).filter("hostname is not null").groupBy(F.col("hostname").alias("host")).agg(
        F.count(F.lit(1)).alias("pages"))
    return red.default_skip_hosts(hosts)


@query
def import_lists(spark, sf):
    """Entries of the versions an import of all bodies activates."""
    done = mod.import_lists(inp.bodies(spark, sf), inp.previous_counts(spark, sf), inp.NOW, inp.GUARD)
    return done.entries


@query
def imported_versions(spark, sf):
    done = mod.import_lists(inp.bodies(spark, sf), inp.previous_counts(spark, sf), inp.NOW, inp.GUARD)
    return pol.activate_versions(done.versions).select(
        "version_id", "blocklist_id", "status", "entry_count", "error")


@query
def list_checksums(spark, sf):
    return pol.list_checksums(inp.bodies(spark, sf))


# -- windows, top-k, sets --------------------------------------------------------------

@query
def latest_scans(spark, sf):
    return st.latest_scans(inp.scan_log(spark, sf)).select("event_id", "scan_id", "status", "policy_generation")


@query
def dedup_blocklists(spark, sf):
    return pol.dedup_blocklists(inp.registry(spark, sf)).select("blocklist_id", "category_id", "name", "source_url")


@query
def cap_urls(spark, sf):
    from dataclasses import replace
    return url_jobs.extract_urls(inp.stored(spark, sf), replace(inp.LIMITS, max_urls_per_event=6)).select(
        "event_id", "position", "normalized_url")


@query
def primary_occurrence(spark, sf):
    return inp.scan(spark, sf).resolutions.select(
        "event_id", "normalized_url", "primary_position", "status", "redirect_count")


@query
def activate_versions(spark, sf):
    return pol.activate_versions(inp.version_log(spark, sf)).select("version_id", "blocklist_id", "status", "active_version_id")


@query
def recent_events(spark, sf):
    rows = st.recent_events(inp.stored(spark, sf), ev.event_relays(inp.valid(spark, sf)), inp.scan_log(spark, sf))
    return rows.withColumn("scans", F.transform("scans", lambda s: F.concat_ws(":", s["scan_id"], s["status"])))


@query
def recent_matches(spark, sf):
    matches = inp.scan(spark, sf).matches.join(
        inp.stored(spark, sf).select("event_id", F.col("last_seen_at").alias("inserted_at")), "event_id")
    return st.recent_matches(matches, inp.categories(spark, sf), inp.blocklists(spark, sf), inp.scan_log(spark, sf)).select(
        "scan_id", "position", "hop_index", "category_id", "slug", "list_name", "scan_status", "inserted_at")


@query
def policy_listing(spark, sf):
    from dataclasses import replace
    return pol.list_entries(inp.entries(spark, sf), replace(inp.LIMITS, listed_entries=20)).select(
        "blocklist_version_id", "rank", "entry_id", "normalized_value")


@query
def blocklist_listing(spark, sf):
    versions = pol.activate_versions(inp.version_log(spark, sf)).filter("status = 'active'")
    lists = inp.registry(spark, sf).join(
        versions.select("blocklist_id", "active_version_id").distinct(), "blocklist_id", "left")
    return pol.list_blocklists(lists, inp.categories(spark, sf), versions.drop("active_version_id")).select(
        "blocklist_id", "name", "category_slug", "active_version_id", "entry_count")


@query
def version_listing(spark, sf):
    return pol.list_versions(inp.version_log(spark, sf)).select("blocklist_id", "version_id", "status", "inserted_at")


@query
def relay_union(spark, sf):
    hints = inp.table(spark, sf, "documents").select(F.concat(F.lit("  wss://"), "lang", F.lit(".example ")).alias("url"))
    blank = inp.table(spark, sf, "documents").select(F.lit("  ").alias("url"))
    return ev.relay_union(hints.unionByName(blank), inp.relays(spark, sf))


# -- streams ---------------------------------------------------------------------------

#: Files of a micro-batch, so that the landed logs make several.
PACE = 4
LANDINGS = 8


@query
def stream_ingest(spark, sf):
    accepted, rejected = live.run_ingest(spark, inp.feed_path(spark, sf), _path(spark, "ingest"), inp.GUARD, PACE)
    return accepted.select("event_id", "relay", "received_at", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("event_id", "relay", "received_at", F.col("reason").alias("outcome")))


@query
def stream_dedup(spark, sf):
    return live.run_dedup(spark, inp.feed_path(spark, sf), _path(spark, "dedup"), inp.LIMITS, PACE)


@query
def stream_first_sight(spark, sf):
    return live.run_first_sight(spark, inp.feed_path(spark, sf), _path(spark, "sight"), inp.LIMITS, PACE)


@query
def stream_current_revision(spark, sf):
    return live.run_revisions(spark, inp.feed_path(spark, sf), _path(spark, "revisions"), inp.LIMITS, PACE)


_live: dict[tuple[str, str], str] = {}


def _live_states(spark, sf):
    key = (tb.run_dir(spark), sf)
    if key not in _live:
        policy = _policy(spark, sf)
        _live[key] = live.run_scans(
            spark, inp.feed_path(spark, sf), _path(spark, "scans"), lambda: policy, inp.edges(spark, sf),
            inp.skip_hosts(spark, sf), inp.categories(spark, sf), inp.SCANNED, inp.LIMITS, PACE)
    return _live[key]


@query
def stream_scan(spark, sf):
    scans = live.scanned(spark, _live_states(spark, sf))
    return scans.select("scan_id", "event_id", "status", "urls_discovered", "urls_resolved", "redirects_followed", "matches_found")


@query
def stream_article_state(spark, sf):
    return live.article_states(spark, _live_states(spark, sf)).select(
        "article_address", "event_id", "status", "blacklisted", "categories", "policy_generation")


@query
def article_verdicts(spark, sf):
    """The main path in one job: landed feed to the state of every article."""
    states = mod.article_verdicts(
        inp.feed(spark, sf), inp.edges(spark, sf), inp.skip_hosts(spark, sf), _policy(spark, sf), inp.categories(spark, sf),
        inp.SCANNED, inp.LIMITS)
    return states.select("article_address", "event_id", "status", "blacklisted", "categories", "policy_generation")


@query
def category_listing(spark, sf):
    """Categories that registered lists use."""
    used = inp.registry(spark, sf).select("category_id").distinct()
    return pol.list_categories(inp.categories(spark, sf).join(used, "category_id", "left_semi"))


@query
def freshness_classes(spark, sf):
    return ev.freshness_classes(inp.request_log(spark, sf), "arrived_at").groupBy("freshness", "in_feed_window").agg(
        F.count(F.lit(1)).alias("n"))


@query
def rate_window_audit(spark, sf):
    return audit.rate_window_audit(inp.request_log(spark, sf), inp.LIMITS)


def _landed_requests(spark, sf, delayed=False):
    """The request log, landed in the order of time, a file for each of eight stretches; some requests two files late."""
    path = _path(spark, "requests")
    log = inp.request_log(spark, sf).withColumn("us", F.unix_micros("ts"))
    low, high = log.agg(F.min("us"), F.max("us")).first()
    file = F.floor((F.col("us") - low) * LANDINGS / (high - low + 1))
    if delayed:
        file = F.when(F.col("id") % 50 == 7, F.least(file + 2, F.lit(LANDINGS - 1))).otherwise(file)
    log = tb.stage(log.withColumn("file", file), "request-log")
    for n in range(LANDINGS):
        log.where(F.col("file") == n).drop("us", "file").coalesce(1).write.mode("append").parquet(path)
    return path


@query
def stream_rate_windows(spark, sf):
    """Windows that closed or are open, and beside them what came too late for them."""
    root = _path(spark, "rates")
    windows = live.run_rate_windows(spark, _landed_requests(spark, sf, delayed=True), root, inp.LIMITS, files_per_batch=1)
    length = inp.LIMITS.rate_window_s
    late = live.late_requests(spark, root).groupBy(
        "key", (F.floor(F.unix_timestamp("ts") / length) * length).alias("window_start")).agg(F.sum("cost").alias("late_used"))
    return windows.join(late, ["key", "window_start"], "full")


@query
def replay_detection(spark, sf):
    found = audit.replay_detection(inp.request_log(spark, sf))
    return found.select("id", "times", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query
def stream_replays(spark, sf):
    return live.run_replays(spark, _landed_requests(spark, sf), _path(spark, "replays"), inp.LIMITS, files_per_batch=1)


@query
def stream_ingest_counters(spark, sf):
    return live.run_counters(spark, inp.feed_path(spark, sf), _path(spark, "counters"), inp.GUARD, files_per_batch=PACE)


# -- extension points --------------------------------------------------------------------

@query
def register_extractor(spark, sf):
    """A second event kind whose extractor reads the text only."""
    registry = url_jobs.register_extractor(1, lambda tags, content: url_jobs.text_finds(content))
    notes = inp.stored(spark, sf).withColumn("kind", F.when(F.substring("event_id", 1, 1) < "8", 1).otherwise(F.col("kind")))
    found = url_jobs.extract_urls(notes, registry=registry)
    return found.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


@query
def event_source_hook(spark, sf):
    """The same jobs over events from another source: a Parquet table of lines."""
    path = _path(spark, "other-source")
    inp.feed_lines(spark, sf).write.parquet(path)
    feed = feeds.parse_feed(spark.read.parquet(path))
    return ev.ingest_counters(ev.check_events(feed, inp.GUARD))


@query
def idna_udf(spark, sf):
    """Hosts with letters outside ASCII; checked against fixed cases in the tests."""
    hosts = inp.page_urls(spark, sf).filter("hostname is not null").select(
        F.replace(F.replace(F.col("hostname"), F.lit("th"), F.lit("thö")), F.lit("an"), F.lit("ÄN")).alias("typed")).distinct()
    return url_jobs.with_normal_host(hosts, "typed")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """One verdict per page URL."""
    prepare(spark)
    answered = mod.target_verdicts(inp.raw_urls(spark, sf), "raw_url", inp.hits(spark, sf), ["page_id"])
    return _flat(answered.select("page_id", "normalized_url", "domain", "status", "blacklisted", "categories", "verdict"))


@query
def page_verdicts(spark, sf):
    return flagship(spark, sf)
