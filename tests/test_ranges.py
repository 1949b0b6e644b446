"""Address ranges against the standard library, and jobs whose results nest."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from hedgemark.functions.addresses import address_bits
from hedgemark.operators import joins, policy as pol, state as st
from hedgemark.operators.ranges import narrowest_ranges, prefix_key


def plain_bits(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return f"{ip.version}{int(ip):0{ip.max_prefixlen}b}"


def test_bits_of_addresses(spark):
    drawn = random.Random(5)
    texts = ["", "::", "::1", "1::", "1.2.3.4", "256.1.1.1", "1.2.3", "::ffff:10.0.0.1", "::ffff:0a00:0001", "::10.0.0.1", "1:2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "1::2::3", ":::", ":1", "1:", "12345::", "g::", "ABCD::Ef", "::1.2.3.999", "host"]
    texts += [str(ipaddress.ip_address(drawn.getrandbits(128) >> drawn.choice([0, 16, 60, 90]))) for _ in range(60)]
    texts += [str(ipaddress.IPv4Address(drawn.getrandbits(32))) for _ in range(30)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "a string").select("a", address_bits(F.col("a")).alias("b")).collect()
    assert {r.a: r.b for r in rows} == {t: plain_bits(t) for t in texts} | {None: None}


def test_keys_of_malformed_ranges_are_null(spark):
    bad = ["1.2.3.4/33", "::/129", "x/8", "1.2.3.4/", "1.2.3.4/-1", "1.2.3.4/8/8", None]
    rows = spark.createDataFrame([(c,) for c in bad], "c string").select(prefix_key(F.col("c")).alias("k")).collect()
    assert [r.k for r in rows] == [None] * len(bad)
    good = spark.createDataFrame([("::ffff:10.0.0.0/104",), ("::/90",), ("::ffff:0:0/90",), ("0.0.0.0/0",), ("10.1.1.1",)], "c string")
    keys = [r.k for r in good.select(prefix_key(F.col("c")).alias("k")).collect()]
    assert keys == ["4" + "00001010", "6" + "0" * 90, "6" + "0" * 80 + "1" * 10, "4", plain_bits("10.1.1.1")]


@pytest.mark.parametrize("spread", [False, True])
def test_narrowest_ranges_against_all_pairs(spark, monkeypatch, spread):
    if spread:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(joins, "HOT_ROWS", 3)
    drawn = random.Random(7)
    number = lambda: 0x0A000000 | drawn.getrandbits(10) << 14
    nets = [(i, f"{ipaddress.IPv4Address(number())}/{drawn.randint(6, 24)}") for i in range(80)]
    nets += [(100 + i, f"2001:db8:{drawn.getrandbits(4):x}::{drawn.getrandbits(4):x}/{drawn.randint(30, 128)}") for i in range(60)]
    nets += [(200, "0.0.0.0/0"), (201, "0.0.0.0/0"), (202, "broken/8"), (203, None), (204, "::/0")]
    ips = [str(ipaddress.IPv4Address(number() | drawn.getrandbits(6))) for _ in range(150)] + ["10.0.0.1"] * 20
    ips += [f"2001:db8:{drawn.getrandbits(4):x}::{drawn.getrandbits(4):x}" for _ in range(60)] + ["9.9.9.9", "::ffff:10.0.0.1", "none", "", None, None]
    parsed = []
    for i, text in nets:
        try:
            parsed.append((i, text, ipaddress.ip_network(text, strict=False)))
        except (ValueError, AttributeError):
            pass

    def best(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        held = [(-net.prefixlen, i, t) for i, t, net in parsed if net.version == ip.version and ip in net]
        return min(held)[1:] if held else None

    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "range_id int, ip string")  # a name that clashes
    ranges = spark.createDataFrame(nets, "range_id int, cidr string")
    got = narrowest_ranges(rows, ranges, "ip", ["range_id"]).collect()
    assert sorted((r.range_id, r.ip, r.range and tuple(r.range)) for r in got) == [(i, ip, best(ip) if ip else None) for i, ip in enumerate(ips)]


def test_no_ranges_and_no_addresses(spark):
    rows, ranges = spark.createDataFrame([("1.1.1.1",)], "ip string"), spark.createDataFrame([], "range_id int, cidr string")
    assert [r.range for r in narrowest_ranges(rows, ranges, "ip", ["ip"]).collect()] == [None]
    assert narrowest_ranges(rows.limit(0), ranges, "ip", ["ip"]).count() == 0


def test_an_unchanged_body_makes_no_version_and_clears_the_error(spark):
    bodies = spark.createDataFrame([("same", "a.com\n"), ("new", "a.com\n"), ("none", "#\n")], "blocklist_id string, body string")
    rules = spark.createDataFrame([("same", "a.com"), ("new", "a.com")], "blocklist_id string, normalized_value string")
    sums = {r.blocklist_id: r.checksum for r in pol.list_checksums(bodies).collect()}
    active = spark.createDataFrame([("same", 90, sums["same"]), ("new", 1, "other"), ("none", 1, None)],
                                   "blocklist_id string, previous_count bigint, active_checksum string")
    got = pol.import_decision(bodies, rules, active)
    assert {r.blocklist_id: (r.decision, r.error) for r in got.collect()} == {
        "same": ("unchanged", None), "new": ("activate", None), "none": ("reject", pol.NO_ENTRIES)}
    lists = spark.createDataFrame([("same", "late", "failed", 5, 100)],
                                  "blocklist_id string, last_error string, refresh_status string, next_refresh_at bigint, refresh_interval_s bigint")
    after = pol.finish_refresh(lists, got, 1_000).first()
    assert (after.last_error, after.refresh_status, after.next_refresh_at) == (None, "ok", 1_100)


def test_each_host_of_a_chain_is_explained(spark):
    hop = "hops array<struct<hostname: string>>"
    chains = spark.createDataFrame([("u1", [("a.x.com",), ("b.org",), ("a.x.com",), ("",)]), ("u2", [("c.net",)]), ("u3", [])], f"normalized_url string, {hop}")
    lists = spark.createDataFrame([("x.com", [("spam", "l2"), ("adult", "l1")]), ("b.org", [("adult", "l1")])],
                                  "domain string, lists array<struct<category_slug: string, list_name: string>>")
    got = {r.normalized_url: r for r in st.explain_chain(chains, lists).collect()}
    assert [(e.host, e.domain, [tuple(x) for x in e.lists]) for e in got["u1"].explained] == [
        ("a.x.com", "x.com", [("adult", "l1"), ("spam", "l2")]), ("b.org", "b.org", [("adult", "l1")])]
    assert [tuple(x) for x in got["u1"].lists] == [("adult", "l1"), ("spam", "l2")]
    assert [(e.host, e.lists) for e in got["u2"].explained] == [("c.net", [])] and got["u2"].lists is None
    assert got["u3"].explained is None and got["u3"].hosts == []


def test_all_scans_of_an_event_are_nested(spark):
    events = spark.createDataFrame([("e1",), ("e2",)], "event_id string")
    relays = spark.createDataFrame([("e1", "wss://b"), ("e1", "wss://a")], "event_id string, relay_url string")
    details = spark.createDataFrame([("e1", "s2", 9, ["c1"]), ("e1", "s1", 3, None)],
                                    "event_id string, scan_id string, inserted_at bigint, categories array<string>")
    got = {r.event_id: r for r in st.event_detail(events, relays, details).collect()}
    assert [(s.scan_id, s.categories) for s in got["e1"].scans] == [("s1", None), ("s2", ["c1"])] and got["e1"].relays == ["wss://a", "wss://b"]
    assert got["e2"].scans == [] and got["e2"].relays is None


def test_a_right_side_is_worked_out_once(spark):
    plain = spark.range(5).withColumnRenamed("id", "k")
    assert joins.written(plain, "t") is plain
    assert joins.written(plain.groupBy("k").count(), "t").inputFiles()
