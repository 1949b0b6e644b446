"""Moderation inputs derived from the driver tables by plain column rules.

Each function reads whole tables; rows differ by rules on their keys so that every
case of the jobs occurs. Tables several jobs share are staged once per session.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedgemark.config import DEFAULT_CATEGORIES, DEFAULTS, Limits
from hedgemark.operators import events as ev
from hedgemark.operators import policy as pol
from hedgemark.operators import redirects as red
from hedgemark.operators import scan as sc
from hedgemark.functions.hosts import registrable_domain
from hedgemark.functions.urls import with_normal_url
from hedgemark.session import prepare
from hedgemark.sources import feeds
from hedgemark.sources.tables import run_dir, stage

SPREAD = 2_654_435_761  # deals numbers out over the space of version 4 addresses
BASE = 1_704_067_200
NOW = BASE + 86_520
SCANNED = BASE + 132_800
GENERATION = 3
#: Low limits, for the queries whose subject is the limit itself.
GUARD = Limits(
    max_content_bytes=20_000, max_list_bytes=1_500, max_list_rules=22, lookup_batch=400,
    feed_limit=100, rate_window_s=86_400, rate_limit=20,
)
#: What all other inputs are made with: texts and lists up to the default limits.
LIMITS = replace(GUARD, max_content_bytes=DEFAULTS.max_content_bytes, max_list_bytes=DEFAULTS.max_list_bytes,
                 max_list_rules=DEFAULTS.max_list_rules)
NAMESPACE = "content.example"
FEED_FILES = 16

# id, category, name, source type, format, enabled, active version
LISTS = (
    ("L1", "c-adult", "adult-primary", "domains", True, "v1"),
    ("L2", "c-adult", "adult-mirror", "domains", True, "v2"),
    ("L3", "c-malware", "malware-hosts", "hosts", True, "v3"),
    ("L4", "c-scam", "scam-urls", "urls", True, "v4"),
    ("L5", "c-spam", "spam-domains", "domains", True, "v5"),
    ("L6", "c-adult", "adult-disabled", "domains", False, "v6"),
    ("L7", "c-legacy", "legacy-domains", "domains", True, "v7"),
)

_built: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame],
           keep: bool = True) -> DataFrame:
    """Build a shared input once per application and table folder."""
    key = (run_dir(spark), sf, name)  # a new folder after drop_staged, so nothing deleted is read again
    if key not in _built:
        prepare(spark)
        _built[key] = stage(build(), f"input-{name}") if keep else build()
    return _built[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- URLs -----------------------------------------------------------------------

def raw_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs in the untidy forms they have in articles: ``page_id, url, raw_url``."""
    n = F.col("page_id")
    scheme = F.regexp_extract("url", r"^(https?)", 1)
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    rest = F.regexp_extract("url", r"^https?://[^/]+(.*)$", 1)
    own = F.when(n % 2 == 0, F.lit("-example.")).otherwise(F.concat(F.lit("-p"), n.cast("string"), F.lit(".")))
    named = F.replace(host, F.lit(".example."), own)
    h = F.when((n % 10 == 4) & named.endswith(".org"), F.regexp_replace(named, r"\.org$", ".co.uk")).otherwise(named)
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    raw = (
        F.when(n % 50 == 21, at("ftp://", h, rest))
        .when(n % 50 == 33, at(scheme, "://bad host/", n.cast("string")))
        .when(n % 50 == 17, at(scheme, "://93.184.", (n % 250).cast("string"), ".7", rest))
        .when(n % 10 == 2, at(scheme, "://", h, ".", rest))
        .when(n % 10 == 3, at(scheme, "://user:pw@", h, rest))
        .when(n % 10 == 5, at(F.upper(scheme), "://", F.upper(h), rest))
        .when(n % 10 == 6, at(scheme, "://", h, rest, ")."))
        .when(n % 10 == 7, at(scheme, "://", h, F.when(n % 20 == 7, ":443").otherwise(":8443"), rest))
        .otherwise(at(scheme, "://", h, rest))
    )
    return table(spark, sf, "pages").select("page_id", "url", raw.alias("raw_url"))


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs with their normal form and host; null where there is none."""
    return with_normal_url(raw_urls(spark, sf), "raw_url")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each page with the raw URLs of its neighbours within blocks of 100 pages."""
    block = Window.partitionBy(F.floor(F.col("page_id") / 100)).orderBy("page_id")
    links = {f"u{i}": F.lead("raw_url", i).over(block) for i in range(1, 5)}
    return raw_urls(spark, sf).withColumns({**links, "back3": F.lag("raw_url", 3).over(block)})


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """What a visit of each page would see; addresses also in forms that are none, or missing."""
    def build() -> DataFrame:
        n = F.col("page_id")
        seen = with_normal_url(page_links(spark, sf), "raw_url").filter(F.col("normalized_url").isNotNull())
        onward = (n % 100).between(60, 79)
        moved = onward | (n % 20).isin(7, 11, 15, 19) | (n % 4 < 3)
        location = (
            F.when(onward, F.col("u1")).when(n % 20 == 7, F.col("back3"))
            .when(n % 20 == 11, F.lit(None).cast("string")).when(n % 20 == 15, "/moved?x=1")
            .when(n % 20 == 19, "ftp://x/").when(n % 4 < 3, F.col("u1"))
        )
        ips = (
            F.when(n % 50 == 3, F.array(F.lit("10.0.0.1")))
            .when(n % 50 == 13, F.array(F.lit("93.184.1.1"), F.lit("::ffff:192.168.1.1")))
            .when(n % 50 == 23, F.array(F.lit("127.1"))).when(n % 50 == 29, F.array(F.lit("999.1.1.1")))
            .when(n % 50 == 39, F.array(F.lit(None).cast("string"))).when(n % 50 == 43, F.array().cast("array<string>"))
            .when(n % 50 == 47, F.lit(None).cast("array<string>"))
            .otherwise(F.array(F.concat(F.lit("93.184.0."), (n % 250).cast("string"))))
        )
        return seen.select(
            F.col("normalized_url").alias("url"), n.alias("observed_at"), F.col("url").contains("/es/").alias("unvisited"),
            F.when(moved, F.when(n % 20 == 7, 302).otherwise(301)).otherwise(200).alias("http_status"),
            location.alias("location"), ips.alias("ips"),
            F.when(n % 50 == 9, "timeout").alias("error"),
            (n % 7 * 20).alias("dns_ms"), (n % 11 * 30).alias("connect_ms"), (n % 13 * 40).alias("head_ms"),
        )
    return shared(spark, sf, "observations", build)


def hop_log(spark: SparkSession, sf: str) -> DataFrame:
    """Observed hops; pages with ``/es/`` in their URL were never visited."""
    return observations(spark, sf).filter(~F.col("unvisited")).drop("unvisited")


def skip_hosts(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return page_urls(spark, sf).filter(F.col("hostname").startswith("m.")).select(
            F.col("hostname").alias("host")).distinct()
    return shared(spark, sf, "skip_hosts", build)


def _quad(n: Column) -> Column:
    byte = lambda place: (F.floor(n / place) % 256).cast("string")
    return F.concat_ws(".", byte(1 << 24), byte(1 << 16), byte(1 << 8), byte(1))


def _six(a: Column, b: Column) -> Column:
    return F.concat(F.lit("2001:db8:"), F.lower(F.hex(a)), F.lit(":"), F.lower(F.hex(b)), F.lit("::"))


def address_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """One range per order: two of three of version 4 (/8 to /32, host bits set), one of version 6 (/32 to /64)."""
    k = F.col("o_orderkey")
    four = F.concat(_quad(k * SPREAD % (1 << 32)), F.lit("/"), (8 + k % 25).cast("string"))
    six = F.concat(_six(k * 40_503 % 65_536, k * 30_011 % 65_536), F.lit("/"), (32 + k % 33).cast("string"))
    return table(spark, sf, "orders").select(k.alias("range_id"), F.when(k % 3 == 0, six).otherwise(four).alias("cidr"))


def range_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """One address per order line, near the range of its order; some wrapped, missing or none."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    four = _quad((k * SPREAD + n * n * n * 97) % (1 << 32))
    six = F.concat(F.upper(_six(k * 40_503 % 65_536, (k * 30_011 + n) % 65_536)), n.cast("string"))
    ip = F.when(k % 50 == 7, F.lit(None).cast("string")).when(k % 50 == 8, "999.1.1.1").when(n % 3 == 0, six) \
        .when(k % 50 == 9, F.concat(F.lit("::ffff:"), four)).otherwise(four)
    return table(spark, sf, "lineitem").select(k.alias("orderkey"), n.alias("linenumber"), ip.alias("ip"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "edges", lambda: red.hop_edges(hop_log(spark, sf), skip_hosts(spark, sf)))


# -- policy -----------------------------------------------------------------------

def categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(f"c-{slug}", slug, name, enabled, blocks) for slug, name, _, enabled, blocks in DEFAULT_CATEGORIES]
    return spark.createDataFrame(
        rows + [("c-legacy", "legacy", "Legacy", False, True)],
        "category_id string, slug string, name string, enabled boolean, blocks_serving boolean",
    )


def blocklists(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(
        list(LISTS),
        "blocklist_id string, category_id string, name string, format string, enabled boolean, active_version_id string",
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Rules made from the page hosts, with cases spread by the first page of a host."""
    def build() -> DataFrame:
        hosts = page_urls(spark, sf).filter("hostname is not null").groupBy("hostname").agg(F.min("page_id").alias("k"))
        k, host = F.col("k"), F.col("hostname")
        domain = registrable_domain(host)
        rule = lambda version, kind: F.struct(F.lit(version).alias("version"), F.lit(kind).alias("kind"))
        rules = (
            F.when(k % 7 == 0, F.array(rule("v1", "domain"), rule("v2", "domain")))
            .when(k % 7 == 1, F.array(rule("v3", "host"))).when(k % 7 == 2, F.array(rule("v5", "domain")))
            .when(k % 7 == 3, F.array(rule("v6", "domain"))).when(k % 7 == 4, F.array(rule("v4", "url_prefix")))
            .when(k % 7 == 5, F.array(rule("v1old", "domain"))).otherwise(F.array(rule("v7", "domain")))
        )
        rows = hosts.withColumn("r", F.explode(rules))
        is_url, blank = F.col("r.kind") == "url_prefix", F.col("k") % 5 == 0
        value = F.when(is_url, F.concat(F.lit("http://"), host, F.lit("/"))).when(blank, domain).otherwise(host)
        return rows.select(
            F.concat_ws(":", F.col("r.version"), F.col("k").cast("string")).alias("entry_id"),
            F.col("r.version").alias("blocklist_version_id"), F.col("r.kind").alias("rule_type"),
            value.alias("normalized_value"), F.when(~is_url & ~blank, domain).alias("registrable_domain"),
        )
    return shared(spark, sf, "entries", build)


def versions(spark: SparkSession, sf: str) -> DataFrame:
    counts = entries(spark, sf).groupBy("blocklist_version_id").agg(F.count(F.lit(1)).alias("entry_count"))
    old = F.col("blocklist_version_id") == "v1old"
    return counts.select(
        F.col("blocklist_version_id").alias("version_id"),
        F.when(old, "L1").otherwise(F.concat(F.lit("L"), F.substring("blocklist_version_id", 2, 9))).alias("blocklist_id"),
        F.when(old, "superseded").otherwise("active").alias("status"), "entry_count",
    )


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "snapshot", lambda: pol.policy_snapshot(
        entries(spark, sf), versions(spark, sf), blocklists(spark, sf), categories(spark, sf)))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "hits", lambda: pol.one_hit_per_category(snapshot(spark, sf)))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """A large list registry with one list per page, clashes and gaps included."""
    n = F.col("page_id")
    slug = F.array(*[F.lit(f"c-{row[0]}") for row in DEFAULT_CATEGORIES])
    return page_urls(spark, sf).select(
        F.concat(F.lit("b"), n.cast("string")).alias("blocklist_id"),
        F.get(slug, (n % 4).cast("int")).alias("category_id"),
        F.coalesce("hostname", F.lit("")).alias("name"),
        F.when(n % 9 == 8, "ftp").when(n % 3 == 0, "manual").otherwise("remote").alias("source_type"),
        F.when(n % 3 > 0, F.concat(F.lit("https://"), F.coalesce(registrable_domain(F.col("hostname")), F.lit("none")), F.lit("/list")))
        .when(n % 2 == 0, "").alias("source_url"),
        F.when(n % 11 == 10, "rpz").when(n % 2 == 0, "domains").otherwise("hosts").alias("format"),
        (n % 5 != 0).alias("enabled"),
        F.when(n % 6 == 4, "failed").when(n % 6 == 5, "rejected").otherwise("ok").alias("refresh_status"),
        F.when(n % 6 == 4, "timeout").when(n % 6 == 5, "too many entries").when(n % 13 == 1, "late").alias("last_error"),
        F.when(n % 4 != 0, F.lit(BASE) + n * 60).alias("next_refresh_at"),
        F.when(n % 17 == 3, 0).otherwise(86_400).cast("bigint").alias("refresh_interval_s"),
        (F.lit(BASE) + n * 37 % 1_000).alias("inserted_at"),
    )


def version_log(spark: SparkSession, sf: str) -> DataFrame:
    """Four versions per registered list, good and bad ones mixed."""
    n = F.col("doc_id")
    status = F.get(F.array(*[F.lit(s) for s in ("failed", "validated", "active", "superseded", "pending")]), (n % 5).cast("int"))
    error = F.get(F.array(F.lit("too many entries"), F.lit("download too large (9 MB, limit 8 MB)"), F.lit("timeout")), (n % 3).cast("int"))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("b"), F.floor(n / 4).cast("string")).alias("blocklist_id"),
        F.concat(F.lit("v"), n.cast("string")).alias("version_id"), status.alias("status"),
        F.when(n % 5 == 0, error).alias("error"),
        F.when(n % 5 != 4, F.lit(BASE) + n * 7919 % 100_000).alias("activated_at"),
        (F.lit(BASE) + n).alias("inserted_at"), F.col("n_chars").alias("entry_count"),
    )


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """List bodies of 25 pages each, with comments, doubles and carriage returns."""
    n, block = F.col("page_id"), F.floor(F.col("page_id") / 25)
    host = F.coalesce("hostname", F.lit("not/a/host:"))
    kind = F.get(F.array(F.lit("domains"), F.lit("hosts"), F.lit("urls")), (block % 3).cast("int"))
    url_line = F.when(n % 6 == 3, F.concat(F.lit("! "), "raw_url")).otherwise(F.concat(F.col("raw_url"), F.lit(" note")))
    host_line = (
        F.when(n % 6 == 1, F.concat(F.lit("0.0.0.0 "), host)).when(n % 6 == 2, F.concat(F.upper(host), F.lit(".")))
        .when(n % 6 == 3, F.concat(F.lit("# "), host)).when(n % 6 == 4, F.concat(F.lit("  "), host, F.lit(" # note")))
        .when(n % 6 == 5, F.concat(host, F.lit("\r"))).otherwise(host)
    )
    line = F.when(kind == "urls", url_line).otherwise(host_line)
    twice = F.when(n % 4 == 0, F.concat(line, F.lit("\n"), line)).otherwise(line)
    blank = F.when(block % 8 == 7, F.concat(F.lit("# "), F.replace(twice, F.lit("\n"), F.lit("\n# ")))).otherwise(twice)
    rows = page_urls(spark, sf).select(block.alias("block"), kind.alias("format"), "page_id", blank.alias("line"))
    return rows.groupBy("block", "format").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "line"))), lambda s: s["line"]), "\n").alias("body")
    ).select(F.concat(F.lit("b"), F.col("block").cast("string")).alias("blocklist_id"), "format", "body")


def previous_counts(spark: SparkSession, sf: str) -> DataFrame:
    block = F.floor(F.col("page_id") / 25)
    return table(spark, sf, "pages").select(block.alias("block")).distinct().filter("block % 4 > 0").select(
        F.concat(F.lit("b"), F.col("block").cast("string")).alias("blocklist_id"),
        F.when(F.col("block") % 4 == 1, 10).when(F.col("block") % 4 == 2, 100).otherwise(0).cast("bigint").alias("previous_count"),
    )


def checksums_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """``previous_counts`` with the content in force; every fifth list still offers the same body."""
    block = F.substring("blocklist_id", 2, 20).cast("bigint")
    same = bodies(spark, sf).select("blocklist_id", F.when(block % 5 == 2, F.sha2("body", 256)).otherwise("other").alias("active_checksum"))
    return same.join(previous_counts(spark, sf), "blocklist_id", "left")


# -- events -----------------------------------------------------------------------

def _json_text(c: Column) -> Column:
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON event per document, with every kind of fault.

    Texts are dealt out once, to as many tasks as the feed has files, and never sorted: the links are what is hashed.
    """
    m, n = F.col("doc_id") % 50, F.col("doc_id")
    links = page_links(spark, sf).select(F.col("page_id").alias("p"), F.col("raw_url").alias("u0"), "u1", "u2", "u3", "u4")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", F.floor(n / 4).alias("p"))
    docs = docs.repartition(FEED_FILES, "p").join(links.repartition(FEED_FILES, "p").hint("shuffle_hash"), "p", "left")
    u = {i: F.coalesce(f"u{i}", F.lit("")) for i in range(5)}
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    author = F.sha2("source", 256)
    pubkey = F.when(m == 7, F.upper(author)).when(m == 13, "zz").otherwise(author)
    d = at("slug-", F.floor(n / 60).cast("string"))
    second = (F.lit(BASE) + 60 * F.floor(n / 40)).cast("bigint")
    created = F.when(m == 6, at('"', second.cast("string"), '"')).when(m == 12, at(second.cast("string"), ".0")).otherwise(second.cast("string"))
    kind = F.when(m == 2, "1").otherwise("30023")
    text = at(
        F.col("text"), "\n![pic](", u[0], ") [more](", u[1], ") <", u[2], '> <img src="', u[3], '"> see ', u[4], " end",
    )
    common = at('["image","', u[1], '"],["imeta","url ', u[2], '","m image/png"],["title","', F.col("lang"), '"]')
    tags = (
        F.when(m == 3, at('[["d","', d, '"],', common, F.repeat(F.lit(',["t","x"]'), 200), "]"))
        .when(m == 8, at("[", common, "]")).when(m == 9, '"none"')
        .when(m == 11, at('[["d","', d, '"],', common, ',["t","', F.repeat(F.lit("é"), 1100), '"]]'))
        .when(m == 14, at('[["d","', d, '"],', common, ',["n",5],"x"]'))
        .when(m == 16, at('[["d",5],["d","', d, '"],', common, "]")).when(m == 18, at('[["d",null],["d","', d, '"],', common, "]"))
        .when(m == 22, at('[["d",5],', common, "]"))
        .otherwise(at('[["d","', d, '"],', common, "]"))
    )
    step = docs.select(
        "doc_id", pubkey.alias("pubkey"), second.alias("second"), created.alias("created"), kind.alias("kind"),
        tags.alias("tags"), F.when(m == 10, "7").otherwise(_json_text(text)).alias("content"),
    )
    body = at('[0,"', F.col("pubkey"), '",', F.col("created"), ",", F.col("kind"), ",", F.col("tags"), ",", F.col("content"), "]")
    m = F.col("doc_id") % 50
    step = step.withColumn("id", F.when(m == 1, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise(F.sha2(body, 256)))
    sig = F.when(m == 5, F.col("id")).otherwise(F.repeat("id", 2))
    return step.select(
        "doc_id", "second",
        at('{"id":"', F.col("id"), '","pubkey":"', F.col("pubkey"), '","created_at":', F.col("created"), ',"kind":', F.col("kind"),
           ',"tags":', F.col("tags"), ',"content":', F.col("content"), ',"sig":"', sig, '"}').alias("event"),
    )


def feed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as they land: one to three relays each, and some broken lines."""
    rows = event_rows(spark, sf).withColumn("r", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
    line = F.concat(
        F.lit('{"relay":"wss://r'), F.col("r").cast("string"), F.lit('.example","received_at":'),
        (F.col("second") + 10 * (F.col("r") + 1)).cast("string"), F.lit(',"event":'), "event", F.lit("}"),
    )
    broken = F.concat(F.lit("not json "), F.col("doc_id").cast("string"))
    return rows.select(F.when(F.col("doc_id") % 50 == 15, broken).otherwise(line).alias("value"))


_feeds: dict[tuple[str, str], str] = {}


def feed_path(spark: SparkSession, sf: str) -> str:
    """Folder of the landed feed, written once per application."""
    key = (run_dir(spark), sf)
    if key not in _feeds:
        prepare(spark)
        path = f"{run_dir(spark)}/feed-{len(_feeds)}"
        feeds.write_feed(feed_lines(spark, sf), path, files=FEED_FILES)
        _feeds[key] = path
    return _feeds[key]


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.read_events(spark, feed_path(spark, sf))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "valid", lambda: ev.validate_events(feed(spark, sf), LIMITS)[0])


def stored(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "stored", lambda: ev.dedup_events(valid(spark, sf)))


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "addresses", lambda: ev.current_revisions(stored(spark, sf)))


def relays(spark: SparkSession, sf: str) -> DataFrame:
    """Relays of the feed and one per document source."""
    fed = valid(spark, sf).select(F.col("relay").alias("url")).distinct()
    more = table(spark, sf, "documents").select("source").distinct().select(
        F.concat(F.when(F.substring("source", -1, 1) == "9", "http://").otherwise("wss://"), "source", F.lit(".example")).alias("url"))
    last = F.substring(F.regexp_replace("url", r"\.example$", ""), -1, 1)
    return fed.unionByName(more).select(
        "url", (~last.isin("3", "4")).alias("enabled"), (last != "1").alias("read_enabled"), last.isin("0", "1", "5").alias("write_enabled"))


# -- scans ------------------------------------------------------------------------

_scans: dict[tuple[str, str], sc.ScanTables] = {}


def scan(spark: SparkSession, sf: str) -> sc.ScanTables:
    """The scan of all stored events, run once per application."""
    key = (run_dir(spark), sf)
    if key not in _scans:
        prepare(spark)
        _scans[key] = sc.scan_articles(
            stored(spark, sf), edges(spark, sf), hits(spark, sf), skip_hosts(spark, sf), GENERATION, SCANNED, LIMITS)
    return _scans[key]


def scan_log(spark: SparkSession, sf: str) -> DataFrame:
    """Scans of several generations: the finished one, older, tied and running ones."""
    def build() -> DataFrame:
        done = scan(spark, sf).scans.select(
            "scan_id", "event_id", "policy_generation", "status", "completed_at", "inserted_at", "scanner_version")
        first = F.substring("event_id", 1, 1)
        def attempt(generation: int, status: Column, inserted: Column, finished: bool) -> Column:
            return F.struct(
                F.lit(generation).cast("bigint").alias("policy_generation"), status.alias("status"),
                inserted.cast("bigint").alias("inserted_at"),
                (inserted if finished else F.lit(None)).cast("bigint").alias("completed_at"))
        older = attempt(1, F.when(first < "4", "failed").otherwise("clean"), F.col("created_at"), True)
        tied = F.when(first == "d", attempt(2, F.lit("matched"), F.lit(SCANNED), True))
        newer = F.when(first.isin("e", "f"), attempt(4, F.lit("running"), F.lit(SCANNED + 10), False))
        failed = F.when(first == "c", attempt(5, F.lit("failed"), F.lit(SCANNED + 20), True))
        more = stored(spark, sf).select("event_id", F.explode(F.array_compact(F.array(older, tied, newer, failed))).alias("a")).select(
            F.concat_ws(":", "event_id", F.col("a.policy_generation").cast("string")).alias("scan_id"), "event_id", "a.*",
            F.lit("1.0.0").alias("scanner_version"))
        return done.unionByName(more)
    return shared(spark, sf, "scan_log", build)


def classification_log(spark: SparkSession, sf: str) -> DataFrame:
    """Classifications of the finished scan, and some of older scans and a disabled category."""
    def build() -> DataFrame:
        done = scan(spark, sf).classifications
        extra = stored(spark, sf).filter(F.substring("event_id", 1, 1).isin("d", "c")).select(
            "event_id", F.explode(F.array(
                F.struct(F.lit("2").alias("g"), F.lit("c-spam").alias("c")), F.struct(F.lit("3").alias("g"), F.lit("c-legacy").alias("c")),
            )).alias("x")).select(
            F.concat_ws(":", "event_id", "x.g").alias("scan_id"), "event_id", F.col("x.c").alias("category_id"), F.lit("current").alias("status"))
        return done.unionByName(extra)
    return shared(spark, sf, "classification_log", build)


def states(spark: SparkSession, sf: str) -> DataFrame:
    from hedgemark.operators.state import article_states
    return shared(spark, sf, "states", lambda: article_states(
        addresses(spark, sf), scan_log(spark, sf), classification_log(spark, sf), categories(spark, sf)))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels already published for some classified events."""
    known = classification_log(spark, sf).filter(F.substring("event_id", -1, 1) < "4").select("event_id", "category_id").distinct()
    return known.select(F.concat_ws(":", F.lit("l"), "event_id", "category_id").alias("label_id"), "event_id", "category_id", F.lit("active").alias("status"))


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.substring("event_id", 2, 1)
    return labels(spark, sf).withColumn("r", F.explode(F.array(F.lit("wss://r0.example"), F.lit("wss://r1.example")))).select(
        "label_id", F.col("r").alias("relay_url"),
        F.when((mark < "6") | ((mark < "a") & F.col("r").contains("r1")), "ok").otherwise("error").alias("status"))


def lookup_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Article look-ups in batches; one batch takes a fifth of all and is too large."""
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.when(n % 5 == 3, "big").otherwise(F.concat(F.lit("q"), F.floor(n / 400).cast("string"))).alias("batch"),
        n.alias("pos"), F.when(n % 25 == 0, 1).otherwise(30023).alias("kind"), F.sha2("source", 256).alias("pubkey"),
        F.when(n % 10 == 7, F.concat(F.lit("missing-"), n.cast("string"))).otherwise(
            F.concat(F.lit("slug-"), F.floor(n / 60).cast("string"))).alias("d_tag"),
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """API requests; every tenth event repeats the id of the one before it."""
    n = F.col("event_id")
    return table(spark, sf, "events").select(
        F.when(n % 10 == 9, n - 1).otherwise(n).alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        (n % 5 + 1).alias("cost"), (F.unix_timestamp("ts") - n % 140 + 10).alias("created_at"),
        F.unix_timestamp("ts").alias("arrived_at"),
    )
