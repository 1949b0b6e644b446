"""Equi-joins that stay balanced when one key holds much of the left side."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgemark.sources.tables import stage

# A right side of at most so many rows and bytes is broadcast; both bounds are checked.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
# Only keys above this many left rows are spread, and at most HOT_KEYS of them:
# any key outside the top HOT_KEYS holds less than one part in HOT_KEYS of the rows.
HOT_ROWS = 2_000_000
HOT_KEYS = 1_000
SPREAD = 64


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """True if the table has at most ``rows`` rows, which as text take at most ``BROADCAST_BYTES``; reads no more than that."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, used = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= rows and used <= BROADCAST_BYTES


def small_side(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is small enough."""
    return F.broadcast(df) if fits_broadcast(df) else df


def hot_keys(df: DataFrame, key: str, hot_rows: int | None = None, nulls: bool = False) -> list:
    """The keys with more than ``hot_rows`` rows, at most ``HOT_KEYS`` of them.

    With ``nulls`` a missing key counts as a key too. Counts are combined before the shuffle, and only the top keys reach the driver.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    rows = df.select(key) if nulls else df.select(key).filter(F.col(key).isNotNull())
    top = (
        rows.groupBy(key).count()
        .filter(F.col("count") > hot_rows).orderBy(F.desc("count"), key).limit(HOT_KEYS)
    )
    return [row[key] for row in top.collect()]


_WORK = re.compile(r"^[\s:|+-]*(Join|Aggregate|Window|Generate|Distinct|Deduplicate|Union|Sort|MapInPandas|\w*EvalPython)\b", re.M)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, staged first unless it only reads, selects and filters a table: who looks at it twice must not work it out twice."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return stage(df, name) if _WORK.search(plan) else df


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str, tie: Sequence[str],
                hot_rows: int | None = None, broadcast_rows: int | None = None,
                spread: int = SPREAD) -> DataFrame:
    """Join a possibly skewed left side to a right side with few rows per key.

    The size of ``right`` is checked first, so it is staged unless it is a plain table: up to ``broadcast_rows`` rows are broadcast. Otherwise rows of hot keys are dealt
    out over ``spread`` sub-keys by a hash of ``tie``, and only the right rows of those
    keys are repeated; without hot keys it is a plain join.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join type not supported: {how}")
    right = written(right, "right")
    if fits_broadcast(right, broadcast_rows):
        return left.join(F.broadcast(right), key, how)
    # a left join keeps rows without a key, which would all meet in one task
    hot = hot_keys(left, key, hot_rows, nulls=how == "left")
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(None in hot))
    dealt = left.withColumn(
        "__part", F.when(is_hot, F.pmod(F.xxhash64(*tie), F.lit(spread)).cast("int")).otherwise(0))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("__part", F.explode(parts))
    return dealt.join(repeated, [key, "__part"], how).drop("__part")


def narrowed(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of ``right`` whose key occurs in ``left``, staged.

    Worth it where ``left`` is staged and few keys meet: only distinct keys are
    shuffled, and what remains is often small enough to broadcast.
    """
    used = left.select(key).filter(F.col(key).isNotNull()).distinct()
    return stage(right.join(used, key, "left_semi"), name)
