"""Reading landed event feeds and list bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgemark.config import DEFAULTS, Limits


#: Ends a landed body; a text file needs something between its rows, and no list holds a zero byte.
END_MARK = "\0"


def parse_feed(lines: DataFrame) -> DataFrame:
    """Landed lines ``{"relay": .., "received_at": .., "event": {..}}`` as columns.

    The event stays a VARIANT so that its JSON types can still be told apart. A
    line that is no JSON keeps a null event and is rejected later. Store events as
    text: a VARIANT written to Parquet may come back with other number types.
    """
    parsed = lines.select(F.try_parse_json("value").alias("line"))
    return parsed.select(
        F.try_variant_get("line", "$.event", "variant").alias("event"),
        F.try_variant_get("line", "$.relay", "string").alias("relay"),
        F.try_variant_get("line", "$.received_at", "bigint").alias("received_at"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_feed(spark.read.text(path))


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    return parse_feed(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def write_feed(feed: DataFrame, path: str, files: int) -> None:
    """Land a feed as text lines (column ``value``), in at most ``files`` files; lines stay in the tasks that make them."""
    feed.select("value").coalesce(files).write.text(path)


def read_list_bodies(spark: SparkSession, path: str, limits: Limits = DEFAULTS) -> DataFrame:
    """List bodies landed as ``blocklist_id=<id>/<file>``, one file per list.

    The size limit is tested on the file length, so the content of larger files
    is never read; they keep a null body. Bytes that are no UTF-8 become replacement
    characters, so they spoil their own line and no other list. The end mark that
    ``write_list_bodies`` sets is not part of a body.
    """
    files = spark.read.format("binaryFile").load(path)
    within = F.col("length") <= limits.max_list_bytes + 1
    name = F.col("blocklist_id").cast("string").alias("blocklist_id")
    marked = F.expr("substring(content, -1, 1) = X'00'")
    raw = F.when(marked, F.expr("substring(content, 1, length - 1)")).otherwise(F.col("content"))
    small = files.filter(within).select(name, raw.alias("raw")).select(
        "blocklist_id", F.octet_length("raw").cast("bigint").alias("bytes"),
        F.when(F.octet_length("raw") <= limits.max_list_bytes, F.make_valid_utf8(F.col("raw").cast("string"))).alias("body"))
    large = files.filter(~within).select(name, (F.col("length") - 1).alias("bytes"), F.lit(None).cast("string").alias("body"))
    return small.unionByName(large)


def write_list_bodies(bodies: DataFrame, path: str) -> None:
    """Land typed-in bodies, one file per list, each as it is with a zero byte as end mark."""
    bodies.select("blocklist_id", F.col("body").alias("value")).write.partitionBy("blocklist_id").option(
        "maxRecordsPerFile", 1).option("lineSep", END_MARK).text(path)
