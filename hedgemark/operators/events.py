"""Event jobs: validation, ids, addresses, deduplication, revisions, feed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgemark.config import ARTICLE_KIND, DEFAULTS, Limits
from hedgemark.functions.hosts import trimmed
from hedgemark.operators.joins import spread_join

_HEX64 = "^[0-9a-f]{64}$"
_HEX128 = "^[0-9a-f]{128}$"


_FIELDS = ("id", "pubkey", "created_at", "kind", "tags", "content", "sig")


def _opened(feed: DataFrame) -> DataFrame:
    """Each field of the JSON event as its own VARIANT, with its JSON type.

    Later steps read these columns, so no field is parsed out twice.
    """
    step = feed.withColumns({
        f"v_{f}": F.try_variant_get(F.col("event"), f"$.{f}", "variant") for f in _FIELDS
    })
    step = step.withColumns({f"t_{f}": F.schema_of_variant(f"v_{f}") for f in _FIELDS})
    text = {f"s_{f}": F.when(F.col(f"t_{f}") == "STRING", F.try_variant_get(F.col(f"v_{f}"), "$", "string"))
            for f in ("id", "pubkey", "content", "sig")}
    number = {f"n_{f}": F.when(F.col(f"t_{f}") == "BIGINT", F.try_variant_get(F.col(f"v_{f}"), "$", "bigint"))
              for f in ("created_at", "kind")}
    step = step.withColumns({
        **text, **number,
        "a_tags": F.when(F.col("t_tags").startswith("ARRAY"), F.try_variant_get(F.col("v_tags"), "$", "array<variant>")),
    })
    return step


def _closed(step: DataFrame) -> DataFrame:
    return step.drop(*[f"{p}_{f}" for f in _FIELDS for p in "vtsna"])


def _id_text() -> Column:
    """The JSON array whose SHA-256 is the event id."""
    def part(field: str, missing: str) -> Column:
        return F.when(F.coalesce(F.col(f"t_{field}"), F.lit("VOID")) == "VOID", missing).otherwise(F.to_json(f"v_{field}"))

    return F.concat(
        F.lit("[0,"), part("pubkey", "null"), F.lit(","), part("created_at", "null"), F.lit(","),
        part("kind", "null"), F.lit(","), part("tags", "[]"), F.lit(","), part("content", '""'), F.lit("]"),
    )


def recompute_event_ids(feed: DataFrame) -> DataFrame:
    """Add the claimed and the recomputed id and whether they agree.

    Only an event with whole numbers for time and kind has an id.
    """
    whole = F.col("n_created_at").isNotNull() & F.col("n_kind").isNotNull()
    step = _opened(feed).withColumns({
        "event_id": F.lower("s_id"), "computed_id": F.when(whole, F.sha2(_id_text(), 256)),
    })
    return _closed(step).withColumn(
        "id_matches", F.coalesce(F.col("event_id") == F.col("computed_id"), F.lit(False)))


def first_d_tag(tags: Column) -> Column:
    """The first text that follows a ``d``; elements that are no text are null in ``tags`` and passed over."""
    hits = F.filter(tags, lambda t: (F.get(t, F.lit(0)) == "d") & F.get(t, F.lit(1)).isNotNull())
    return F.get(F.get(hits, F.lit(0)), F.lit(1))


def article_address(kind: Column, pubkey: Column, d_tag: Column) -> Column:
    return F.when(d_tag.isNotNull(), F.concat_ws(":", kind.cast("string"), F.lower(pubkey), d_tag))


def derive_addresses(events: DataFrame) -> DataFrame:
    """Add ``d_tag`` and ``article_address`` from kind, pubkey and tags."""
    step = events.withColumn("d_tag", first_d_tag(F.col("tags")))
    return step.withColumn(
        "article_address", article_address(F.col("kind"), F.col("pubkey"), F.col("d_tag"))
    )


def _is_hex(field: str, pattern: str) -> Column:
    return F.coalesce(F.lower(f"s_{field}").rlike(pattern), F.lit(False))


def _reason(limits: Limits, signed: Column) -> Column:
    strings = F.transform(
        "a_tags", lambda t: F.coalesce(F.try_variant_get(t, "$", "array<variant>"), F.array().cast("array<variant>"))
    )
    too_long = F.exists(strings, lambda tag: F.exists(
        tag, lambda x: F.coalesce(
            (F.schema_of_variant(x) == "STRING")
            & (F.octet_length(F.try_variant_get(x, "$", "string")) > limits.max_tag_bytes), F.lit(False)),
    ))
    return (
        F.when(~F.coalesce(F.schema_of_variant("event").startswith("OBJECT"), F.lit(False)), "invalid_event")
        .when(~_is_hex("id", _HEX64), "invalid_id")
        .when(~_is_hex("pubkey", _HEX64), "invalid_pubkey")
        .when(F.col("n_created_at").isNull(), "invalid_created_at")
        .when(~F.coalesce(F.col("n_kind").isin(*limits.allowed_kinds), F.lit(False)), "unsupported_kind")
        .when(F.col("s_content").isNull(), "invalid_content")
        .when(F.octet_length("s_content") > limits.max_content_bytes, "content_too_large")
        .when(F.col("a_tags").isNull(), "invalid_tags")
        .when(F.size("a_tags") > limits.max_tags, "too_many_tags")
        .when(too_long, "tag_too_long")
        .when(~_is_hex("sig", _HEX128), "invalid_signature")
        .when(F.sha2(_id_text(), 256) != F.lower("s_id"), "id_mismatch")
        .when(~signed, "invalid_signature")
    )


def _judged(feed: DataFrame, limits: Limits) -> DataFrame:
    signed = F.coalesce(F.col("sig_ok"), F.lit(False)) if "sig_ok" in feed.columns else F.lit(True)
    return _opened(feed).withColumn("reason", _reason(limits, signed))


def check_events(feed: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Add ``reason``: the first rule an event breaks, null if it breaks none.

    Signatures are judged by their form, and by a boolean column ``sig_ok`` if
    the feed has one.
    """
    return _closed(_judged(feed, limits))


def _kept(df: DataFrame, test) -> DataFrame:
    """Rows that pass ``test``, checked where they are made.

    A plain filter would be moved below the columns it tests and every field of
    the event would be worked out a second time.
    """
    return df.select(F.inline(F.filter(F.array(F.struct(*df.columns)), test)))


def accepted_events(feed: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Typed columns of the events that break no rule."""
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    tags = F.transform("a_tags", lambda t: F.transform(
        F.coalesce(F.try_variant_get(t, "$", "array<variant>"), F.array().cast("array<variant>")), text))
    typed = _judged(feed, limits).select(
        "reason", F.lower("s_id").alias("event_id"), F.lower("s_pubkey").alias("pubkey"),
        F.col("n_created_at").alias("created_at"), F.col("n_kind").cast("int").alias("kind"),
        tags.alias("tags"), F.col("s_content").alias("content"), "relay", "received_at",
    )
    return derive_addresses(_kept(typed, lambda r: r["reason"].isNull()).drop("reason"))


def rejected_events(feed: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Id, reason and origin of the events that break a rule."""
    checked = _judged(feed, limits).select(F.col("s_id").alias("event_id"), "reason", "relay", "received_at")
    return _kept(checked, lambda r: r["reason"].isNotNull())


def validate_events(feed: DataFrame, limits: Limits = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Accepted events with typed columns, and rejected rows with their reason."""
    return accepted_events(feed, limits), rejected_events(feed, limits)


def dedup_events(valid: DataFrame) -> DataFrame:
    """One row per event id with first and last sight and all relays.

    Partial aggregation reduces repeated ids before the shuffle.
    """
    body = ["pubkey", "created_at", "kind", "tags", "content", "d_tag", "article_address"]
    seen = valid.groupBy("event_id").agg(
        F.first(F.struct(*body)).alias("body"),
        F.min("received_at").alias("first_seen_at"),
        F.max("received_at").alias("last_seen_at"),
        F.array_sort(F.collect_set("relay")).alias("relays"),
    )
    return seen.select("event_id", "body.*", "first_seen_at", "last_seen_at", "relays")


def event_relays(valid: DataFrame) -> DataFrame:
    return valid.filter(F.col("relay").isNotNull()).select("event_id", F.col("relay").alias("relay_url")).distinct()


def current_revisions(events: DataFrame) -> DataFrame:
    """The newest event of each article: larger created_at, then larger id."""
    articles = events.filter((F.col("kind") == ARTICLE_KIND) & F.col("d_tag").isNotNull())
    newest = articles.groupBy("kind", "pubkey", "d_tag").agg(
        F.max(F.struct("created_at", "event_id")).alias("newest")
    )
    return newest.select(
        "kind", "pubkey", "d_tag",
        article_address(F.col("kind"), F.col("pubkey"), F.col("d_tag")).alias("article_address"),
        F.col("newest.event_id").alias("current_event_id"),
        F.col("newest.created_at").alias("current_event_created_at"),
    )


def ingest_filter(events: DataFrame, now: int, limits: Limits = DEFAULTS) -> DataFrame:
    """What a feed request returns: allowed kinds, recent, newest N per relay.

    Spark keeps only N rows per relay and task before it shuffles.
    """
    newest = Window.partitionBy("relay").orderBy(F.desc("created_at"), "event_id")
    recent = events.filter(
        F.col("kind").isin(*limits.allowed_kinds) & (F.col("created_at") >= now - limits.feed_window_s)
    )
    return recent.withColumn("rank", F.row_number().over(newest)).filter(
        F.col("rank") <= limits.feed_limit
    )


def ingest_counters(checked: DataFrame) -> DataFrame:
    """Received rows per relay and rejected rows per reason."""
    pairs = checked.groupBy("relay", "reason").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.select(
        F.explode(F.array(
            F.struct(F.lit("received").alias("counter"), F.col("relay").alias("label"), "n"),
            F.struct(F.lit("rejected").alias("counter"), F.col("reason").alias("label"), "n"),
        )).alias("c")
    ).select("c.*")
    return counts.filter(F.col("label").isNotNull()).groupBy("counter", "label").agg(F.sum("n").alias("n"))


def fetch_newest_match(requests: DataFrame, events: DataFrame) -> DataFrame:
    """For each requested article the newest fetched event, any case of pubkey.

    Events are reduced to one row per article before the join.
    """
    article = F.concat_ws(":", F.col("kind").cast("string"), F.lower("pubkey"), "d_tag")
    newest = events.filter("d_tag is not null").groupBy(article.alias("article")).agg(
        F.max(F.struct("created_at", "event_id")).alias("newest")
    )
    asked = requests.withColumn("article", F.when(F.col("d_tag").isNotNull(), article))
    joined = spread_join(asked, newest, "article", "inner", tie=requests.columns)
    return joined.select(
        *requests.columns,
        F.col("newest.event_id").alias("event_id"),
        F.col("newest.created_at").alias("created_at"),
    )


def relay_union(hints: DataFrame, relays: DataFrame) -> DataFrame:
    """Hinted relays and enabled read relays, trimmed, without blanks or repeats."""
    read = relays.filter(F.col("enabled") & F.col("read_enabled"))
    both = hints.select("url").unionByName(read.select("url"))
    return both.select(trimmed(F.col("url")).alias("url")).filter(F.col("url") != "").distinct()


def freshness_classes(events: DataFrame, now: str, limits: Limits = DEFAULTS) -> DataFrame:
    """Judge ``created_at`` against the arrival time in column ``now``."""
    created, arrived = F.col("created_at"), F.col(now)
    oldest = arrived - limits.freshness_window_s - limits.clock_skew_s
    return events.withColumn(
        "freshness",
        F.when(created.isNull(), "invalid_created_at")
        .when(created < oldest, "stale")
        .when(created > arrived + limits.clock_skew_s, "future")
        .otherwise("ok"),
    ).withColumn("in_feed_window", created >= arrived - limits.feed_window_s)
