"""Hosts, URLs, addresses and finds against fixed cases."""

import pytest
from pyspark.sql import functions as F

from hedgemark.config import Limits
from hedgemark.functions.addresses import address_classes
from hedgemark.functions.encode import encode_host
from hedgemark.functions.hosts import registrable_domain
from hedgemark.functions.urls import absolute_location, with_normal_url
from hedgemark.operators import urls as jobs


def one(spark, rows, schema, fn):
    return [tuple(r) for r in fn(spark.createDataFrame(rows, schema)).collect()]


HOSTS = [
    ("Harbour.TEST.", "harbour.test"),
    ("_Srv.Harbour.test", "_srv.harbour.test"),
    ("q----7---q.harbour.test", "q----7---q.harbour.test"),
    ("qué_host.harbour.test", "qué_host.harbour.test"),
    ("köln.harbour.test", "xn--kln-sna.harbour.test"),
    ("KÖLN.harbour.test", "xn--kln-sna.harbour.test"),
    ("weiß.harbour.test", "xn--wei-7ka.harbour.test"),
    (" \tquay.harbour.test ", "quay.harbour.test"),
    ("[2001:db8::7]", "2001:db8::7"),
    ("[FE80::00ab%en1]", "fe80::ab"),
    ("127.1", "127.0.0.1"),
    ("0x7f.0.0.1", "127.0.0.1"),
    ("9.8.7.6", "9.8.7.6"),
    (".", None), ("", None), ("two words", None),
]


def test_hosts(spark):
    got = one(spark, [(h,) for h, _ in HOSTS], "h string", lambda d: jobs.with_normal_host(d, "h"))
    assert dict(got) == dict(HOSTS)


@pytest.mark.parametrize("host", ["ſ.example", "a..b.ü", "-ü.example", "ü-.example"])
def test_encoding_never_fails(host):
    assert encode_host(host)


URLS = [
    ("HTTPS://Example.com/path", "https://example.com/path"),
    ("http://Example.com:8080/x", "http://example.com:8080/x"),
    ("https://cdn.example.com/a.webp\\", "https://cdn.example.com/a.webp"),
    ("javascript:alert(1)", None), ("file:///etc/passwd", None), ("http://", None), ("http:///x", None),
    ("http://a.com:80", "http://a.com/"), ("https://a.com:0443?q#f", "https://a.com/?q"),
    ("https://a.com:80/x", "https://a.com:80/x"), ("http://a.com:/x", "http://a.com/x"),
    ("http://u:p@a@b.com/x).", "http://b.com/x"), ("http://ad_track.evil.com", "http://ad_track.evil.com/"),
    ("http://foo bar/", None), (" http://a.com/x　", "http://a.com/x"),
    ("http://münchen.example/ä", "http://xn--mnchen-3ya.example/ä"),
    ("http://a.com/b c?d=e f", "http://a.com/b c?d=e f"), ("http://a%20b.com/x", "http://a/x"),
]


def test_urls(spark):
    got = one(spark, [(u,) for u, _ in URLS], "u string", lambda d: with_normal_url(d, "u").select("u", "normalized_url"))
    assert dict(got) == dict(URLS)


def test_normal_form_is_stable(spark):
    forms = [(u,) for _, u in URLS if u]
    got = one(spark, forms, "u string", lambda d: with_normal_url(d, "u").select("u", "normalized_url"))
    assert all(a == b for a, b in got)


DOMAINS = [
    ("a.b.example.com", "example.com"), ("example.co.uk", "example.co.uk"), ("a.b.example.co.uk", "example.co.uk"),
    ("co.uk", "co.uk"), ("localhost", "localhost"), ("10.1.2.3", "10.1.2.3"), ("::1", "::1"),
    ("x.github.io", "x.github.io"), ("a..b.com", "b.com"), ("a..com", "a.com"), (".com", ".com"),
    ("evil.com:8080", "evil.com:8080"),
]


def test_domains(spark):
    got = one(spark, [(d,) for d, _ in DOMAINS], "d string", lambda x: x.select("d", registrable_domain(F.col("d"))))
    assert dict(got) == dict(DOMAINS)


LOCATIONS = [
    ("http://a.com/x/y/z?q", "../w", "http://a.com/x/w"), ("http://a.com/x", "/a/./b/..", "http://a.com/a/"),
    ("https://a.com/x", "//h.com/p", "https://h.com/p"), ("http://a.com/x?z", "?y=1", "http://a.com/x?y=1"),
    ("http://a.com/x?z", "w?y#f", "http://a.com/w?y"), ("http://a.com/x?z", "#f", "http://a.com/x?z"),
    ("http://a.com/", "../../w", "http://a.com/w"), ("http://a.com/x/", "y", "http://a.com/x/y"),
]


def test_locations(spark):
    got = one(spark, [(c, l) for c, l, _ in LOCATIONS], "c string, l string",
              lambda d: d.select("c", "l", absolute_location(F.col("c"), F.col("l"))))
    assert got == LOCATIONS


ADDRESSES = {
    "127.0.0.1": "loopback", "10.0.0.1": "private", "192.168.1.1": "private", "172.16.0.1": "private",
    "172.32.0.1": "public", "100.64.0.1": "private", "169.254.1.1": "link_local", "::1": "loopback",
    "fc00::1": "unique_local", "fe80::1": "link_local", "fe81::1": "public", "::ffff:127.0.0.1": "loopback",
    "::ffff:8.8.8.8": "public", "1.1.1.1": "public", "2001:db8::5": "documentation", "ff02::1": "multicast",
    "::": "unspecified", "0.0.0.0": "unspecified", "0.1.2.3": "reserved", "240.1.2.3": "reserved", "241.1.2.3": "public",
    "255.255.255.255": "reserved", "198.18.0.9": "benchmarking", "203.0.113.7": "documentation", "zzz": "invalid",
}


def test_addresses(spark):
    got = one(spark, [([a],) for a in ADDRESSES], "a array<string>",
              lambda d: d.select(F.col("a")[0], address_classes(F.col("a"))[0]))
    assert dict(got) == ADDRESSES
    allowed = one(spark, [(["127.0.0.1"],)], "a array<string>", lambda d: d.select(address_classes(F.col("a"), True)[0]))
    assert allowed == [("public",)]


ARTICLE = (
    "A map ![of the harbour](https://maps.port.test/north/7.svg) and [its legend](http://port.test/legend?lang=en), "
    "mirrored at <https://mirror.port.test/>.\n\n"
    '<p><img alt="" src="https://photo.port.test/quay.jpeg"></p>\n'
    "Tides are listed under https://tides.port.test/today without a link.\n"
)


def finds(spark, content, tags=(), limits=None, kind=30023, **kw):
    df = spark.createDataFrame([("e", kind, [list(t) for t in tags], content)],
                               "event_id string, kind int, tags array<array<string>>, content string")
    return [(r.source_type, r.normalized_url) for r in jobs.extract_urls(df, limits, **kw).orderBy("position").collect()]


def test_extract_each_form(spark):
    got = finds(spark, ARTICLE, [("image", "https://cover.port.test/1.avif"), ("imeta", "alt A quay", "url https://meta.port.test/2", "url"), ("image",)])
    inside = ["https://maps.port.test/north/7.svg", "http://port.test/legend?lang=en", "https://mirror.port.test/",
              "https://photo.port.test/quay.jpeg"]
    kinds = ["markdown_image", "markdown_link", "autolink", "html_attr"]
    tagged = [("image_tag", "https://cover.port.test/1.avif"), ("imeta_tag", "https://meta.port.test/2")]
    bare = [("bare_url", u) for u in [*inside, "https://tides.port.test/today"]]
    assert got == tagged + list(zip(kinds, inside)) + bare


def test_extract_strips_backslashes(spark):
    got = finds(spark, "Boats: ![sloop](http://port.test/sloop.gif\\) or http://port.test/ketch.gif\\ and more")
    assert {u for _, u in got} == {"http://port.test/sloop.gif", "http://port.test/ketch.gif"}


def test_cap_counts_valid_finds_only(spark):
    text = "<http://bad host/> " + " ".join(f"https://h{i}.example/" for i in range(60))
    got = finds(spark, text, limits=Limits())
    assert len(got) == 50 and got[0] == ("bare_url", "http://bad/")


def test_unknown_kind_fails_and_hook_adds_one(spark):
    with pytest.raises(Exception, match="no extractor for kind 1"):
        finds(spark, "https://a.example/", kind=1)
    registry = jobs.register_extractor(1, jobs.article_finds)
    assert finds(spark, "https://a.example/", kind=1, registry=registry) == [("bare_url", "https://a.example/")]


def test_long_text_is_read_whole(spark):
    text = "x" * 300_000 + " https://end.example/last"
    assert finds(spark, text) == [("bare_url", "https://end.example/last")]


def test_targets(spark):
    rows = [("",), ("evil.com",), ("evil.com/x",), ("https://evil.com",), ("a" * 5_000,)]
    got = one(spark, rows, "q string", lambda d: jobs.classify_targets(d, "q").select("target_kind", "target", "target_error"))
    assert got == [("error", None, "empty"), ("domain", "evil.com", None), ("url", "https://evil.com/x", None),
                   ("url", "https://evil.com", None),
                   ("error", None, "url_too_long")]
