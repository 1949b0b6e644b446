"""Address ranges of any number: the narrowest range that holds an address, by one sweep.

A range in prefix form is a node of the binary tree of addresses: its bits lie right before
all that it holds in the order of their bits, and ranges are nested or apart. So ranges and
different addresses are sorted together, slice by slice, and a stack of open ranges gives
the narrowest. A range is repeated only for the slices it reaches into; over a border reach
at most as many as there are prefix lengths. Each address is one row, whatever the lengths.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgemark.functions.addresses import address_bits, once
from hedgemark.operators.joins import spread_join
from hedgemark.sources.tables import stage

#: Addresses and ranges of a slice, borders a slice is drawn from, and most slices.
SLICE_ROWS = 250_000
BORDERS = 40
MOST_SLICES = 4_000
#: Leading bits of a version 6 address that wraps a version 4 one.
WRAPPED = "0" * 80 + "1" * 16


def prefix_key(cidr: Column) -> Column:
    """The family and the fixed bits of a range, null for text that is none.

    Bits behind the prefix are ignored; an address without a length is a range of one. A
    range of wrapped version 4 addresses is one of version 4.
    """
    base = F.substring_index(cidr, "/", 1)
    stated = F.regexp_extract(cidr, r"^[^/]*/([0-9]{1,3})$", 1)

    def cut(bits: Column) -> Column:
        wrapped = base.contains(":") & bits.startswith("4")
        size = F.when(~cidr.contains("/"), F.length(bits) - 1) \
            .when(stated != "", stated.cast("int") - F.when(wrapped, 96).otherwise(0))
        outer = F.concat(F.lit("6"), F.substring(F.lit(WRAPPED), F.lit(1), size + 96))
        return F.when(size.between(0, F.length(bits) - 1), F.substring(bits, F.lit(1), size + 1)) \
            .when(wrapped & size.between(-96, -1), outer)

    return once(address_bits(base), cut)


def _borders(bits: DataFrame, slice_rows: int) -> list[str]:
    """Where slices of about ``slice_rows`` rows begin, from a sample: it decides which task does what, not the result."""
    rows = bits.count()
    slices = min(MOST_SLICES, -(-rows // slice_rows))
    if slices < 2:
        return []
    drawn = sorted(r[0] for r in bits.sample(min(1.0, slices * BORDERS / rows), 42).collect())
    return sorted({drawn[len(drawn) * k // slices] for k in range(1, slices)}) if drawn else []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The innermost range open at each address; rows come in the order of their slices and bits."""
    open_: list[tuple[str, dict]] = []
    for batch in batches:
        ranges, addresses, found = batch.column("__range"), [], []
        for k, (bits, address) in enumerate(zip(batch.column("__bits").to_pylist(), batch.column("__address").to_pylist())):
            while open_ and not bits.startswith(open_[-1][0]):
                open_.pop()
            if address is None:
                open_.append((bits, ranges[k].as_py()))
            elif open_:
                addresses.append(address)
                found.append(open_[-1][1])
        yield pa.RecordBatch.from_arrays([pa.array(addresses, pa.string()), pa.array(found, ranges.type)], names=["__address", "__range"])


def narrowest_ranges(addresses: DataFrame, ranges: DataFrame, address: str, tie: list[str], out: str = "range",
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``addresses`` with ``out``: the ``range_id, cidr`` of the longest prefix that holds ``address``, else null.

    ``ranges`` has ``range_id, cidr``; of equal ranges the smallest id counts, malformed ones
    hold nothing. Null or malformed addresses lie in no range, and no row is dropped or
    repeated. ``tie`` are columns by which rows of a frequent address are dealt out.
    """
    keyed = ranges.select(prefix_key(F.col("cidr")).alias("__bits"), F.struct("range_id", "cidr").alias("__range"))
    keyed = stage(keyed.groupBy("__bits").agg(F.min("__range").alias("__range")), "range-keys").where("__bits IS NOT NULL")
    known = addresses.select(F.col(address).alias("__address")).where("__address IS NOT NULL").distinct()
    known = stage(known.withColumn("__bits", address_bits(F.col("__address"))), "addresses").where("__bits IS NOT NULL")
    borders = _borders(known.select("__bits").unionAll(keyed.select("__bits")), slice_rows)

    @F.pandas_udf("int")
    def slice_of(bits: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, b) for b in bits], dtype="int32")

    # no address or range begins with a 2: what a range holds lies between its bits and those with a 2 behind
    reach = F.sequence(slice_of("__bits"), slice_of(F.concat("__bits", F.lit("2"))))
    placed = known.withColumn("__slice", slice_of("__bits")).unionByName(
        keyed.withColumn("__slice", F.explode(reach)), allowMissingColumns=True)
    swept = placed.repartition(len(borders) + 1, "__slice").sortWithinPartitions(
        "__slice", "__bits", F.col("__address").isNotNull())
    shape = keyed.schema["__range"].dataType.simpleString()
    best = swept.mapInArrow(_sweep, f"__address string, __range {shape}")
    best = best.select(F.col("__address").alias(address), F.col("__range").alias(out))
    return spread_join(addresses, stage(best, "ranges-found"), address, "left", tie)
