"""Label jobs: drafts, withdrawal, delivery status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.config import LABEL_KIND
from hedgemark.operators.joins import spread_join
from hedgemark.operators.state import latest_scans


def label_tags(event_id: Column, slug: Column, relay_hint: Column, namespace: str) -> Column:
    return F.array(
        F.array(F.lit("L"), F.lit(namespace)),
        F.array(F.lit("l"), slug, F.lit(namespace)),
        F.array(F.lit("e"), event_id, F.coalesce(relay_hint, F.lit(""))),
    )


def label_plan(classifications: DataFrame, categories: DataFrame, relays: DataFrame,
               existing: DataFrame) -> DataFrame:
    """Each classified event and category: reuse its label or draft a new one.

    The relay hint is the smallest relay URL of the event, so that runs repeat.
    """
    wanted = classifications.select("event_id", "category_id").distinct()
    hint = relays.groupBy("event_id").agg(F.min("relay_url").alias("source_relay"))
    known = existing.select("event_id", "category_id", F.lit("reuse").alias("action"))
    named = spread_join(wanted, categories.select("category_id", "slug"), "category_id", "inner", tie=["event_id"])
    return (
        named.join(hint, "event_id", "left")
        .join(known, ["event_id", "category_id"], "left")
        .withColumn("action", F.coalesce("action", F.lit("draft")))
    )


def label_drafts(plan: DataFrame, namespace: str) -> DataFrame:
    """Unsigned label events for the new labels of a plan."""
    return plan.filter(F.col("action") == "draft").select(
        "event_id", "category_id", F.lit(LABEL_KIND).alias("kind"), F.lit("").alias("content"),
        label_tags(F.col("event_id"), F.col("slug"), F.col("source_relay"), namespace).alias("tags"),
    )


def write_label_drafts(drafts: DataFrame, path: str) -> None:
    drafts.select("kind", "content", "tags").write.mode("append").json(path)


def delivery_targets(relays: DataFrame) -> DataFrame:
    return relays.filter(F.col("enabled") & F.col("write_enabled")).select("url")


def label_delivery_status(labels: DataFrame, deliveries: DataFrame, relays: DataFrame) -> DataFrame:
    """A label is active once a write relay exists and any delivery succeeded."""
    ok = deliveries.groupBy("label_id").agg(F.bool_or(F.col("status") == "ok").alias("any_ok"))
    writable = delivery_targets(relays).agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    joined = labels.drop("status").join(ok, "label_id", "left")
    active = writable & F.coalesce("any_ok", F.lit(False))
    return joined.withColumn("status", F.when(active, "active").otherwise("pending")).drop("any_ok")


def stale_labels(labels: DataFrame, scans: DataFrame, classifications: DataFrame,
                 rescanned: DataFrame) -> DataFrame:
    """Labels resting on the latest scan of an event about to be scanned again."""
    chosen = scans.select("event_id", "scan_id", "inserted_at").join(
        rescanned.select("event_id").distinct(), "event_id", "left_semi")
    latest = latest_scans(chosen).select("scan_id")
    stale = classifications.join(latest, "scan_id", "left_semi").select("event_id", "category_id").distinct()
    return labels.join(stale, ["event_id", "category_id"], "left_semi").withColumn("status", F.lit("withdrawn"))
