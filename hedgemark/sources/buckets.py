"""Snapshots in key buckets with a digest each, so that two of them are compared bucket by bucket.

A snapshot is written in folders by a hash of its keys, followed by one digest row per
bucket: the number of rows and two sums of row hashes, which do not depend on order or on
the number of tasks. Two snapshots whose digests agree for a bucket hold the same rows
there, so a change feed reads only the buckets that differ: its cost follows the changes
(up to one bucket for each), not the table. The digest table has as many rows as buckets,
a fixed number chosen by the writer; nothing else reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgemark.sources.tables import exists

BUCKET = "key_bucket"
DEFAULT_BUCKETS = 1_024


def _text(columns: Sequence[str]) -> Column:
    """A row as one text in which a missing value differs from every other."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def _key_text(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = DEFAULT_BUCKETS) -> None:
    """Write a snapshot with one row per key; it can be read once its digests are there.

    More buckets make a change cheaper to find and the files smaller. ``buckets`` must be
    the same for snapshots that are to be compared.
    """
    if BUCKET in df.columns:
        raise ValueError(f"column name is taken: {BUCKET}")
    placed = df.withColumn(BUCKET, F.pmod(F.xxhash64(_key_text(keys)), F.lit(buckets)).cast("int"))
    df.limit(0).write.parquet(f"{path}/schema")
    placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    spark, row = df.sparkSession, _text(df.columns)
    written = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(20,0)"))
    written.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), total(1).alias("sum_1"), total(2).alias("sum_2")) \
        .withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/digests")


def _digests(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, f"{path}/digests/_SUCCESS"):
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, before: str, after: str) -> list[int]:
    """The buckets whose rows differ; at most as many as the snapshots have."""
    old, new = _digests(spark, before), _digests(spark, after)
    counts = {r.buckets for r in old.select("buckets").union(new.select("buckets")).distinct().collect()}
    if len(counts) > 1:
        raise ValueError(f"snapshots of different numbers of buckets: {sorted(counts)}")
    mark = F.struct("n", "sum_1", "sum_2")
    both = old.select(BUCKET, mark.alias("old")).join(new.select(BUCKET, mark.alias("new")), BUCKET, "full")
    return sorted(r[0] for r in both.where(~F.col("old").eqNullSafe(F.col("new"))).select(BUCKET).collect())


def change_feed(spark: SparkSession, before: str, after: str, keys: Sequence[str]) -> DataFrame:
    """What changed from one snapshot to the next: keys, ``kind`` and the whole rows ``before`` and ``after``.

    ``kind`` is insert, delete or update; the row that is not there is null. A missing key
    part is a value like any other. Both snapshots must have the same columns and types.
    """
    chosen = changed_buckets(spark, before, after)
    sides = {}
    for name, path in (("before", before), ("after", after)):
        schema = spark.read.parquet(f"{path}/schema").schema
        columns = list(schema.names)
        rows = spark.read.schema(schema.add(BUCKET, T.IntegerType())).parquet(f"{path}/rows")
        sides[name] = rows.where(F.col(BUCKET).isin(chosen)).select(
            F.col(BUCKET), _key_text(keys).alias("__key"), F.struct(*columns).alias(name), _text(columns).alias(f"__{name}"))
    old, new = sides["before"], sides["after"]
    if dict(old.select("before.*").dtypes) != dict(new.select("after.*").dtypes):
        raise ValueError("snapshots of different columns")
    joined = old.join(new, [BUCKET, "__key"], "full").where(~F.col("__before").eqNullSafe(F.col("__after")))
    kind = F.when(F.col("__before").isNull(), "insert").when(F.col("__after").isNull(), "delete").otherwise("update")
    known = F.when(F.col("__after").isNull(), F.col("before")).otherwise(F.col("after"))
    return joined.select(*[known[k].alias(k) for k in keys], kind.alias("kind"), "before", "after")
