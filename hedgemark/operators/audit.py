"""Request audits: rate windows and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgemark.config import DEFAULTS, Limits


def rate_window_audit(requests: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Units used per key and tumbling window, and whether that is over the limit."""
    span = F.window("ts", f"{limits.rate_window_s} seconds")
    used = requests.groupBy(span.alias("span"), "key").agg(F.sum("cost").alias("used"))
    return used.select(
        "key", F.unix_timestamp("span.start").alias("window_start"), "used",
        (F.col("used") > limits.rate_limit).alias("limited"),
    )


def replay_detection(requests: DataFrame, key: str = "id") -> DataFrame:
    """Ids seen more than once, with how often and when first and last."""
    return requests.groupBy(key).agg(
        F.count(F.lit(1)).alias("times"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).filter(F.col("times") > 1)


def replay_outcomes(requests: DataFrame, limits: Limits = DEFAULTS, seen: DataFrame | None = None) -> DataFrame:
    """``id, us, outcome``: ``replay`` if the same id was there within the replay window before, else ``fresh``.

    ``requests`` and ``seen`` (earlier ones, which get no outcome) have id and us (microseconds).
    Every sighting holds the id anew. Rows are compared within an id and one length of the
    window; the last sighting of the length before is carried into it. So an id that is in
    very many rows is spread over its times.
    """
    length = limits.replay_window_s * 1_000_000
    rows = requests.select("id", "us", F.lit(1).alias("kind"))
    if seen is not None:
        rows = rows.unionByName(seen.select("id", "us", F.lit(0).alias("kind")))
    rows = rows.withColumn("span", F.floor(F.col("us") / length))
    carried = rows.groupBy("id", (F.col("span") + 1).alias("span")).agg(F.max("us").alias("us")).withColumn("kind", F.lit(0))
    order = Window.partitionBy("id", "span").orderBy("us", "kind")
    judged = rows.unionByName(carried).withColumn("gap", F.col("us") - F.lag("us").over(order))
    return judged.where("kind = 1").select("id", "us", F.when(F.col("gap") < length, "replay").otherwise("fresh").alias("outcome"))
