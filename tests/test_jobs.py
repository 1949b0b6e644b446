"""Policy, redirect, scan, state and storage jobs against small fixed cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from hedgemark.config import Limits
from hedgemark.operators import audit, constraints, events as ev, joins, labels as lab
from hedgemark.operators import policy as pol, redirects as red, scan as sc, state as st
from hedgemark.plans import moderation as mod
from hedgemark.sources import feeds, tables as tb


# -- joins ------------------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join_with_a_hot_key(spark, how):
    rng = random.Random(7)
    left = spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else (None if i % 10 == 1 else f"k{rng.randint(0, 80)}")) for i in range(3_000)], "id int, k string")
    right = tb.stage(spark.createDataFrame([("hot", 1), ("hot", 2)] + [(f"k{i}", i) for i in range(60)], "k string, v int"), "r")
    got = joins.spread_join(left, right, "k", how, ["id"], hot_rows=100, broadcast_rows=1, spread=8)
    want = left.join(right, "k", how)
    assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=repr) == sorted(
        map(tuple, want.select("id", "k", "v").collect()), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__part" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_without_key_are_spread(spark):
    left = tb.stage(spark.createDataFrame([(i, None if i % 2 else "a") for i in range(1_000)], "id int, k string"), "l")
    assert joins.hot_keys(left, "k", 100, nulls=True) == [None, "a"] and joins.hot_keys(left, "k", 100) == ["a"]
    right = tb.stage(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "r")
    got = joins.spread_join(left, right, "k", "left", ["id"], hot_rows=100, broadcast_rows=1, spread=8)
    assert got.count() == 1_000 and got.filter("v = 1").count() == 500
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 1


def test_small_right_side_is_broadcast(spark):
    left = spark.createDataFrame([(1, "a")], "id int, k string")
    right = spark.createDataFrame([("a", 2)], "k string, v int")
    plan = joins.spread_join(left, right, "k", "left", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


# -- events -------------------------------------------------------------------------

def event(**over):
    base = {"pubkey": "a" * 64, "created_at": 1, "kind": 30023, "tags": [["d", "hello"]], "content": "hi"}
    base.update({k: v for k, v in over.items() if k in base})
    text = json.dumps([0, base["pubkey"], base["created_at"], base["kind"], base["tags"], base["content"]],
                      separators=(",", ":"), ensure_ascii=False)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return {**base, "id": over.get("id", digest), "sig": over.get("sig", "b" * 128)}


def feed_of(spark, *events, relay="wss://r0.example", at=10):
    lines = [(json.dumps({"relay": relay, "received_at": at, "event": e}, ensure_ascii=False),) for e in events]
    return feeds.parse_feed(spark.createDataFrame(lines, "value string"))


def reasons(spark, *events, limits=Limits()):
    return [r.reason for r in ev.check_events(feed_of(spark, *events), limits).collect()]


def test_reject_reasons(spark):
    cases = [
        (event(), None), (event(kind=1), "unsupported_kind"), (event(id="x"), "invalid_id"),
        (event(pubkey="zz"), "invalid_pubkey"), (event(created_at="1"), "invalid_created_at"),
        (event(created_at=1.5), "invalid_created_at"), (event(content=7), "invalid_content"),
        (event(tags="none"), "invalid_tags"), (event(tags=[["t", "x"]] * 201), "too_many_tags"),
        (event(tags=[["t", "é" * 1025]]), "tag_too_long"), (event(tags=[["t", "é" * 1024]]), None),
        (event(sig="b" * 64), "invalid_signature"), (event(id="c" * 64), "id_mismatch"),
        (event(content="x" * 512_001), "content_too_large"), (event(content="x" * 512_000), None),
        (event(tags=[["d", "x"], "odd", ["n", 5]]), None),
        (event(content='q"\\ \b\f\n\r\t \u0001 / é   \U0001f600 \u007f'), None),
        (event(pubkey="A" * 64), None), ([1], "invalid_event"),
    ]
    assert reasons(spark, *[e for e, _ in cases]) == [r for _, r in cases]


def test_signature_column_counts(spark):
    feed = feed_of(spark, event()).withColumn("sig_ok", F.lit(False))
    assert ev.check_events(feed).first().reason == "invalid_signature"


def test_typed_event(spark):
    row = ev.accepted_events(feed_of(spark, event(pubkey="A" * 64, tags=[["e"], ["d", "slug", "z"], ["d", "other"]]))).first()
    assert (row.pubkey, row.d_tag, row.article_address) == ("a" * 64, "slug", f"30023:{'a' * 64}:slug")
    row = ev.accepted_events(feed_of(spark, event(tags=[["d", "x" * 400]]))).first()
    assert row.d_tag == "x" * 400
    assert ev.accepted_events(feed_of(spark, event(tags=[]))).first().article_address is None


def test_two_relays_are_one_event(spark):
    both = feed_of(spark, event()).unionByName(feed_of(spark, event(), relay="wss://r1.example", at=20))
    valid = ev.accepted_events(both)
    row = ev.dedup_events(valid).collect()
    assert len(row) == 1 and row[0].relays == ["wss://r0.example", "wss://r1.example"]
    assert (row[0].first_seen_at, row[0].last_seen_at) == (10, 20)
    assert ev.event_relays(valid).count() == 2


def test_newest_revision_by_time_then_id(spark):
    rows = [("aa", 50), ("bb", 50), ("zz", 10)]
    df = spark.createDataFrame([(i, 30023, "p", c, "d") for i, c in rows] + [("nn", 30023, "p", 99, None), ("kk", 1, "p", 99, "d")],
                               "event_id string, kind int, pubkey string, created_at bigint, d_tag string")
    got = ev.current_revisions(df).collect()
    assert [(r.current_event_id, r.current_event_created_at) for r in got] == [("bb", 50)]


def test_freshness(spark):
    df = spark.createDataFrame([(100, 165), (99, 165), (171, 165), (170, 165), (None, 165)], "created_at bigint, now bigint")
    assert [r.freshness for r in ev.freshness_classes(df, "now").collect()] == ["ok", "stale", "future", "ok", "invalid_created_at"]


# -- policy --------------------------------------------------------------------------

def bodies(spark, *rows):
    return spark.createDataFrame(list(rows), "blocklist_id string, format string, body string")


def rules(spark, fmt, body):
    got = pol.distinct_rules(pol.parse_blocklists(bodies(spark, ("b", fmt, body)))).orderBy("line_no").collect()
    return [(r.rule_type, r.normalized_value, r.registrable_domain) for r in got]


def test_list_formats(spark):
    assert rules(spark, "domains", "Evil.COM.\r\n# comment\n! note\n\n  evil.com x\n[bad host]\nmünchen.example") == [
        ("domain", "evil.com", "evil.com"), ("domain", "bad", "bad"),
        ("domain", "xn--mnchen-3ya.example", "xn--mnchen-3ya.example")]
    assert rules(spark, "hosts", "0.0.0.0 a.evil.com # x\n::1 b.evil.com\nc.evil.com d\n127.0.0.1") == [
        ("host", "a.evil.com", "evil.com"), ("host", "b.evil.com", "evil.com"), ("host", "c.evil.com", "evil.com"),
        ("host", "127.0.0.1", "127.0.0.1")]
    assert rules(spark, "urls", "https://Evil.com/a b\nnope\n") == [("url_prefix", "https://evil.com/a", None)]


def test_many_rules(spark):
    body = "\n".join(f"host{i}.example" for i in range(10_000))
    assert pol.distinct_rules(pol.parse_blocklists(bodies(spark, ("b", "domains", body)))).count() == 10_000


def test_import_decisions(spark):
    limits = Limits(max_list_bytes=60, max_list_rules=2)
    b = bodies(spark, ("ok", "domains", "a.com\nb.com"), ("half", "domains", "a.com"), ("less", "domains", "a.com"),
               ("empty", "domains", "# x\n"), ("many", "domains", "a.com\nb.com\nc.com"), ("large", "domains", "x" * 100),
               ("first", "domains", "a.com"), ("zero", "domains", "a.com"))
    active = spark.createDataFrame([("half", 2), ("less", 3), ("zero", 0), ("empty", 5)], "blocklist_id string, previous_count bigint")
    got = pol.import_decision(b, pol.distinct_rules(pol.parse_blocklists(b, limits)), active, limits)
    assert {r.blocklist_id: r.error for r in got.collect()} == {
        "ok": None, "half": None, "less": pol.DECREASE, "empty": pol.NO_ENTRIES, "many": pol.TOO_MANY, "large": pol.TOO_LARGE,
        "first": None, "zero": None}
    lists = spark.createDataFrame([("ok", "late", "failed", 5, 100), ("less", None, "ok", 5, 100), ("idle", None, "idle", 5, 100)],
                                  "blocklist_id string, last_error string, refresh_status string, next_refresh_at bigint, refresh_interval_s bigint")
    after = {r.blocklist_id: (r.last_error, r.refresh_status, r.next_refresh_at) for r in pol.finish_refresh(lists, got, 1_000).collect()}
    assert after == {"ok": (None, "ok", 1_100), "less": (pol.DECREASE, "rejected", 5), "idle": (None, "idle", 5)}


def test_seeds_keep_known_rows(spark):
    known = spark.createDataFrame([("mine", "adult", "My adult", "d", False, False)],
                                  "category_id string, slug string, name string, description string, enabled boolean, blocks_serving boolean")
    got = {r.slug: r.name for r in pol.seed_categories(known).collect()}
    assert got == {"adult": "My adult", "malware": "Malware", "scam": "Scam", "spam": "Spam"}
    hosts = red.default_skip_hosts(spark.createDataFrame([("m.primal.net", 1)], "host string, added int"))
    assert hosts.count() == 4 and hosts.filter("added = 1").count() == 1


def test_failed_version_leaves_old_one_active(spark):
    df = spark.createDataFrame([("b", "v1", "active", 1), ("b", "v2", "failed", None), ("c", "v3", "active", 1), ("c", "v4", "validated", 2)],
                               "blocklist_id string, version_id string, status string, activated_at bigint")
    assert {r.version_id: r.status for r in pol.activate_versions(df).collect()} == {
        "v1": "active", "v2": "failed", "v3": "superseded", "v4": "active"}


def small_policy(spark, rows, lists=None):
    categories = spark.createDataFrame([("ca", "adult", "Adult", True, True), ("cb", "ads", "Ads", True, False), ("cc", "old", "Old", False, True)],
                                       "category_id string, slug string, name string, enabled boolean, blocks_serving boolean")
    blocklists = spark.createDataFrame(lists or [
        ("l1", "ca", "adult-primary", True, "v1"), ("l2", "ca", "adult-mirror", True, "v2"), ("l3", "cb", "ads-trackers", True, "v3"),
        ("l4", "ca", "adult-disabled", False, "v4"), ("l5", "cc", "old-list", True, "v5")],
        "blocklist_id string, category_id string, name string, enabled boolean, active_version_id string")
    versions = spark.createDataFrame([(f"v{i}", f"l{i}") for i in range(1, 6)] + [("v1old", "l1")], "version_id string, blocklist_id string")
    entries = spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)],
                                    "entry_id string, blocklist_version_id string, rule_type string, normalized_value string, registrable_domain string")
    return mod.Policy.load(entries, versions, blocklists, categories, 1), categories


def answers(spark, policy, *hosts):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, host string")
    got = mod.domain_answers(df, "host", policy, ["i"]).orderBy("i").collect()
    return [(r.status, r.blacklisted, r.categories, [x.list_name for x in r.lists]) for r in got]


def test_explain_and_verdict(spark):
    policy, _ = small_policy(spark, [(f"v{i}", "domain", "evil.com", "evil.com") for i in range(1, 6)])
    assert answers(spark, policy, "www.evil.com", "notevil.com", "good.example") == [
        ("matched", True, ["ads", "adult"], ["ads-trackers", "adult-mirror", "adult-primary"]),
        ("clean", False, [], []), ("clean", False, [], [])]


def test_match_rules(spark):
    policy, _ = small_policy(spark, [
        ("v1", "domain", "cdn.blocked.example", "blocked.example"), ("v1", "url_prefix", "http://prefix.example/", None),
        ("v3", "host", "ads.example", None), ("v1old", "domain", "past.example", "past.example")])
    assert answers(spark, policy, "www.blocked.example", "prefix.example", "x.ads.example", "past.example") == [
        ("matched", True, ["adult"], ["adult-primary"]), ("clean", False, [], []),
        ("matched", False, ["ads"], ["ads-trackers"]), ("clean", False, [], [])]


def test_backfill(spark):
    df = spark.createDataFrame([("host", "cdn.blocked.example", None), ("url_prefix", "http://x.example/", None), ("domain", "a.b.c", "kept")],
                               "rule_type string, normalized_value string, registrable_domain string")
    assert pol.backfill_pending(df)
    done = pol.backfill_domains(df)
    assert [r.registrable_domain for r in done.collect()] == ["blocked.example", None, "kept"]
    assert not pol.backfill_pending(done)


def test_due_lists(spark):
    df = spark.createDataFrame([("a", True, "remote", "rejected", "too many entries", None), ("b", True, "remote", "failed", "timeout", None),
                                ("c", True, "remote", "ok", None, 500), ("d", True, "manual", "ok", None, None), ("e", False, "remote", "ok", None, None)],
                               "blocklist_id string, enabled boolean, source_type string, refresh_status string, last_error string, next_refresh_at bigint")
    assert pol.due_blocklists(df, 100).count() == 0
    assert [r.blocklist_id for r in pol.due_blocklists(df, 100, force=True).collect()] == ["c"]
    assert [r.blocklist_id for r in pol.due_blocklists(df, 500).collect()] == ["c"]


def test_constraints_find_rows(spark):
    relays = spark.createDataFrame([("wss://a",), ("wss://a",), ("http://b",), (None,)], "url string")
    got = {(r.key, r.rule) for r in constraints.check_constraints({"relays": relays}).collect()}
    assert got == {("http://b", "url_format"), (None, "url_required"), ("wss://a", "url_unique")}


# -- redirects -------------------------------------------------------------------------

HOPS = "url string, observed_at bigint, http_status int, location string, ips array<string>, error string, dns_ms int, connect_ms int, head_ms int"


def hop(url, status=200, location=None, ips=("1.1.1.1",), error=None, at=1):
    return (url, at, status, location, list(ips), error, 1, 2, 3)


def walk(spark, hops, starts, limits=Limits(), skip=("skip.example",), **kw):
    skip_hosts = spark.createDataFrame([(h,) for h in skip], "host string")
    edges = tb.stage(red.hop_edges(spark.createDataFrame(hops, HOPS), skip_hosts, limits), "edges")
    urls = spark.createDataFrame([(u, u.split("/")[2]) for u in starts], "normalized_url string, hostname string")
    got = red.resolve_redirects(urls, edges, skip_hosts, limits, **kw).collect()
    return {r.normalized_url: r for r in got}


CASES = [
    hop("http://a.example/from", 302, "/to"), hop("http://a.example/to"),
    hop("http://a.example/loop", 302, "/loop"),
    hop("http://a.example/r0", 301, "/r1"), hop("http://a.example/r1", 301, "/r2"), hop("http://a.example/r2", 301, "/r3"),
    hop("http://a.example/bad", 302), hop("http://a.example/ftp", 302, "ftp://x/"), hop("http://a.example/inv", 302, "http://"),
    hop("http://a.example/priv", ips=["1.1.1.1", "10.0.0.1"]), hop("http://a.example/err", error="timeout"),
    hop("http://a.example/long", 302, "/" + "x" * 2_048), hop("http://a.example/out", 302, "https://skip.example/x"),
    hop("http://a.example/old", 302, "/gone", at=1), hop("http://a.example/old", 200, at=2),
    hop("http://a.example/b1", 302, "/b2"), hop("http://a.example/b2", 302, "/b1"),
]
EXPECTED = {
    "http://a.example/from": ("completed", "http://a.example/to", 1, 200), "http://a.example/loop": ("redirect_loop", "http://a.example/loop", 0, 302),
    "http://a.example/r0": ("too_many_redirects", "http://a.example/r2", 2, 301), "http://a.example/bad": ("malformed_redirect", "http://a.example/bad", 0, 302),
    "http://a.example/ftp": ("unsupported_scheme", "http://a.example/ftp", 0, 302), "http://a.example/inv": ("invalid_url", "http://a.example/inv", 0, 302),
    "http://a.example/priv": ("blocked_address", "http://a.example/priv", 0, None), "http://a.example/err": ("timeout", "http://a.example/err", 0, None),
    "http://a.example/long": ("malformed_redirect", "http://a.example/long", 0, 302), "http://a.example/out": ("skipped_host", "https://skip.example/x", 1, None),
    "http://skip.example/y": ("skipped_host", "http://skip.example/y", 0, None), "http://a.example/none": ("connection_failure", "http://a.example/none", 0, None),
    "http://a.example/old": ("completed", "http://a.example/old", 0, 200), "http://a.example/b1": ("redirect_loop", "http://a.example/b1", 1, 302),
}


@pytest.mark.parametrize("kw", [{}, {"broadcast_rows": 0, "hot_rows": 1}])
def test_redirect_statuses(spark, kw):
    got = walk(spark, CASES, EXPECTED, Limits(max_redirects=2), **kw)
    assert {u: (r.status, r.final_url, r.redirect_count, r.http_status) for u, r in got.items()} == EXPECTED
    assert got["http://a.example/out"].error is None and got["http://a.example/err"].error == "timeout"
    assert got["http://a.example/from"].head_ms == 6 and got["http://a.example/priv"].dns_ms == 0


def brute(hops, skip, start, cap):
    """The same walk as a plain loop over a dictionary."""
    from urllib.parse import urljoin
    seen, url, path = set(), start, []
    while True:
        if url in seen:
            return "redirect_loop", url, path
        seen.add(url)
        path.append(url)
        if url.split("/")[2] in skip:
            return "skipped_host", url, path
        if url not in hops:
            return "connection_failure", url, path
        status, location = hops[url]
        if status == 200:
            return "completed", url, path
        if len(path) > cap:
            return "too_many_redirects", url, path
        if not location:
            return "malformed_redirect", url, path
        url = urljoin(url, location)


@pytest.mark.parametrize("seed", range(2))
def test_redirects_against_brute_force(spark, seed):
    rng = random.Random(seed)
    url = lambda i: f"http://h{i % 5}.example/{i}"
    # a third of all pages point to one page
    hops = {url(i): ((302, rng.choice([url(0), url(rng.randint(0, 119)), None])) if rng.random() < .8 else (200, None)) for i in range(100)}
    got = walk(spark, [hop(u, s, l) for u, (s, l) in hops.items()], [url(i) for i in range(120)], skip=("h3.example",), broadcast_rows=0, hot_rows=5)
    for i in range(120):
        r = got[url(i)]
        assert (r.status, r.final_url, [h.url for h in r.hops]) == brute(hops, {"h3.example"}, url(i), 8)


# -- scans and states --------------------------------------------------------------------

def article_run(spark, content, entries, hops=(), now=100):
    policy, categories = small_policy(spark, entries)
    skip = spark.createDataFrame([], "host string")
    edges = tb.stage(red.hop_edges(spark.createDataFrame(list(hops), HOPS), skip), "edges")
    feed = feed_of(spark, *[event(content=c, tags=[["d", f"a{i}"]]) for i, c in enumerate(content)])
    got = mod.article_verdicts(feed, edges, skip, policy, categories, now)
    return {r.d_tag: (r.status, r.blacklisted, r.categories) for r in got.collect()}


def test_article_verdicts_end_to_end(spark):
    got = article_run(
        spark, ["https://ok.example/", "https://go.example/", "https://evil.com/ https://ok.example/", "https://none.example/ https://evil.com/", "no links",
                "https://ads.example/"],
        [("v1", "domain", "evil.com", "evil.com"), ("v3", "domain", "ads.example", "ads.example")],
        [hop("https://ok.example/"), hop("https://go.example/", 302, "https://x.evil.com/"), hop("https://x.evil.com/"), hop("https://evil.com/"),
         hop("https://ads.example/")])
    assert got == {
        "a0": ("clean", False, []), "a1": ("matched", True, ["adult"]), "a2": ("matched", True, ["adult"]),
        "a3": ("partial", True, ["adult"]), "a4": ("clean", False, []), "a5": ("matched", False, ["ads"])}


def test_three_valued_states(spark):
    addresses = spark.createDataFrame([(30023, "p", d, f"30023:p:{d}", e, 1) for d, e in [("a", "e1"), ("b", "e2"), ("c", "e3"), ("d", "e4")]],
                                      "kind int, pubkey string, d_tag string, article_address string, current_event_id string, current_event_created_at bigint")
    scans = spark.createDataFrame([("s1", "e1", "failed", 1, 5, 5), ("s2", "e2", "running", 1, None, 5), ("s3", "e2", "matched", 1, 4, 4),
                                   ("s4", "e4", "matched", 1, 5, 5), ("s5", "e4", "clean", 1, 5, 5)],
                                  "scan_id string, event_id string, status string, policy_generation bigint, completed_at bigint, inserted_at bigint")
    classes = spark.createDataFrame([("s3", "e2", "ca", "current"), ("s4", "e4", "ca", "current")], "scan_id string, event_id string, category_id string, status string")
    cats = spark.createDataFrame([("ca", "adult", True, True)], "category_id string, slug string, enabled boolean, blocks_serving boolean")
    states = st.article_states(addresses, scans, classes, cats)
    assert {r.d_tag: (r.status, r.blacklisted, r.scan_id) for r in states.collect()} == {
        "a": ("failed", False, "s1"), "b": ("pending", None, "s2"), "c": ("pending", None, None), "d": ("clean", False, "s5")}
    events = spark.createDataFrame([("e1",), ("e2",), ("e3",), ("e4",), ("e5",)], "event_id string")
    assert {r.event_id for r in st.needs_scan(events, states).collect()} == {"e2", "e3", "e5"}
    keys = spark.createDataFrame([("q", 0, 30023, "p", "a"), ("q", 1, 30023, "p", "zz"), ("q", 2, 1, "p", "a"), ("q", 3, 30023, "p", "c")],
                                 "batch string, pos int, kind int, pubkey string, d_tag string")
    got = st.batch_lookup(keys, addresses, states).orderBy("pos").collect()
    assert [(r.status, r.blacklisted, r.error) for r in got] == [
        ("failed", False, None), ("unknown", None, None), (None, None, "unsupported kind"), ("pending", None, None)]
    assert {r.error for r in st.batch_lookup(keys, addresses, states, Limits(lookup_batch=3)).collect()} == {"batch too large"}


def test_label_drafts_and_delivery(spark):
    classes = spark.createDataFrame([("e1", "ca"), ("e1", "ca"), ("e2", "ca")], "event_id string, category_id string")
    cats = spark.createDataFrame([("ca", "adult")], "category_id string, slug string")
    relays = spark.createDataFrame([("e1", "wss://b"), ("e1", "wss://a")], "event_id string, relay_url string")
    none = spark.createDataFrame([("e9", "ca")], "event_id string, category_id string")
    drafts = lab.label_drafts(lab.label_plan(classes, cats, relays, none), "space").orderBy("event_id").collect()
    assert [d.tags for d in drafts] == [
        [["L", "space"], ["l", "adult", "space"], ["e", "e1", "wss://a"]], [["L", "space"], ["l", "adult", "space"], ["e", "e2", ""]]]
    labels = spark.createDataFrame([("l1", "x"), ("l2", "x"), ("l3", "x")], "label_id string, status string")
    sent = spark.createDataFrame([("l1", "error"), ("l1", "ok"), ("l2", "error")], "label_id string, status string")
    on = spark.createDataFrame([("wss://a", True, True)], "url string, enabled boolean, write_enabled boolean")
    status = lambda r: {x.label_id: x.status for x in lab.label_delivery_status(labels, sent, r).collect()}
    assert status(on) == {"l1": "active", "l2": "pending", "l3": "pending"}
    assert set(status(on.withColumn("write_enabled", F.lit(False))).values()) == {"pending"}


def test_fingerprint_keeps_empty_parts(spark):
    df = spark.createDataFrame([("a.com", ["x", "y"], ["l1"])], "d string, c array<string>, l array<string>")
    none = F.lit(None).cast("string")
    got = df.select(st.target_fingerprint(F.col("d"), none, F.lit(3), none, F.col("c"), F.col("l"))).first()[0]
    assert got == hashlib.sha256(b"a.com::3::x,y:l1").hexdigest()


def test_rate_windows(spark):
    df = spark.sql("select timestamp_seconds(s) ts, 'k' key, c cost from values (0, 100), (59, 21), (60, 120) as t(s, c)")
    assert [(r.window_start, r.used, r.limited) for r in audit.rate_window_audit(df).orderBy("window_start").collect()] == [
        (0, 121, True), (60, 120, False)]


# -- tables ---------------------------------------------------------------------------------

def test_merge_rows(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "y"), (3, "C", "y")], "k int, v string, w string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tb.merge_rows(old, new, ["k"], "ignore")) == [(1, "a", "x"), (2, "b", "x"), (3, "C", "y")]
    assert rows(tb.merge_rows(old, new, ["k"])) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "y")]
    assert rows(tb.merge_rows(old, new, ["k"], "replace", ["v"])) == [(1, "a", "x"), (2, "B", "x"), (3, "C", "y")]


def test_snapshots_ignore_unfinished_versions(spark, tmp_path):
    import os
    path = str(tmp_path / "t")
    assert tb.latest_snapshot(spark, path) is None
    tb.publish_snapshot(spark.range(3), path)
    tb.publish_snapshot(spark.range(5), path)
    os.remove(f"{path}/v=0000000002/_SUCCESS")
    assert tb.read_snapshot(spark, path).count() == 3


def test_change_log_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "log")
    row = lambda k, n: spark.createDataFrame([(k, n)], "k string, n int")
    tb.append_changes(row("a", 1), path, 0)
    tb.append_changes(row("a", 2), path, 1)
    tb.append_changes(row("a", 3), path, 1)
    got = tb.latest_rows(tb.read_changes(spark, path), ["k"], ["n"]).collect()
    assert [(r.k, r.n) for r in got] == [("a", 3)]


def test_bodies_over_the_limit_are_not_read(spark, tmp_path):
    path = str(tmp_path / "bodies")
    feeds.write_list_bodies(bodies(spark, ("s", "domains", "a.com"), ("l", "domains", "x" * 100)), path)
    got = {r.blocklist_id: (r.bytes, r.body) for r in feeds.read_list_bodies(spark, path, Limits(max_list_bytes=50)).collect()}
    assert got == {"s": (5, "a.com"), "l": (100, None)}
