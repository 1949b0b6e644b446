"""Whitening of embeddings by the principal components of their distributed covariance.

Entries become whole numbers, so sums and products are exact: each task adds up its rows
centred at the whole number next to the mean, the tasks' parts are added by Spark, and the
remaining half at most is taken off without rounding. Only sums of the size of a covariance
matrix reach the driver.

The eigenvectors start in float32 and are corrected in long double by the matrix products
of Ogita and Aishima, which double the right digits each time. Pairs of eigenvalues too
close for that are a cluster: it is solved again by itself, shifted to its own middle and
scaled to its own width, in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgemark.llm.common import bounded_batches
from hedgemark.sources.tables import stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Scaled entries beyond this are taken as this, so that sums of products stay within three limbs.
MOST = 1 << 40
LIMB = 40
#: Correction rounds; from float32 three or four are enough, more only where rounding is reached.
ROUNDS = 12
#: Largest correction of a pair, which then shrinks to its square; closer pairs form clusters, solved again at most so deep.
SMALL = 1e-3
DEEPEST = 8


@dataclass(frozen=True)
class Whitening:
    """What was learnt: ``n`` vectors, ``centre`` + ``rest`` / n their mean, and the components as rows, by falling eigenvalue."""

    n: int
    centre: np.ndarray
    rest: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float]

    @property
    def projection(self) -> np.ndarray:
        return (self.components.T / np.sqrt(self.eigenvalues)).astype(np.float64)


def whole_vectors(vectors: DataFrame, keep: Sequence[str], vector: str) -> DataFrame:
    """``doc`` (a struct of ``keep``) and ``x``, the scaled entries, of the rows that can be used."""
    slim = vectors.select(F.struct(*keep).alias("doc"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = slim.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    bound = F.lit(float(MOST))
    x = F.transform("v", lambda c: F.floor(F.greatest(-bound, F.least(bound, c * SCALE))).cast("long") + SHIFT)
    return usable.select("doc", x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _limbs(values: Sequence[int]) -> list[list[int]]:
    """Whole numbers in three parts whose sums over many tasks still fit in 64 bits."""
    mask = (1 << LIMB) - 1
    return [[v & mask for v in values], [(v >> LIMB) & mask for v in values], [v >> 2 * LIMB for v in values]]


_PARTS = "at int, rows bigint, low array<bigint>, mid array<bigint>, high array<bigint>"
_FIELDS = pa.schema([("at", pa.int32()), ("rows", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("low", "mid", "high")]])


def _part(lines: list[list[int]], rows: int) -> pa.RecordBatch:
    limbs = [_limbs(line) for line in lines]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(lines)), pa.int32()), pa.array([rows] * len(lines), pa.int64()),
         *[pa.array([part[k] for part in limbs], pa.list_(pa.int64())) for k in range(3)]], schema=_FIELDS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = None, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            high, low = (x >> 20).sum(0), (x & 0xFFFFF).sum(0)
            found = [(int(a) << 20) + int(b) for a, b in zip(high, low)]
            total = found if total is None else [a + b for a, b in zip(total, found)]
            rows += batch.num_rows
    if rows:
        yield _part([total], rows)


def _gram(y: np.ndarray) -> list[list[int]]:
    """Exact sums of products: in float64 while every partial sum is a whole number below 2^53, else in Python's own numbers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 1 << 53:
        values = y.astype(np.float64)
        return (values.T @ values).astype(np.int64).tolist()
    whole = y.astype(object)
    return (whole.T @ whole).tolist()


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    total, rows = None, 0
    for batch in batches:
        if batch.num_rows:
            found = np.array(_gram(_matrix(batch) - centre), object)
            total = found if total is None else total + found
            rows += batch.num_rows
    if rows:
        yield _part(total.tolist(), rows)


def _added(parts: DataFrame) -> tuple[int, dict[tuple[int, int], int]]:
    """The parts of all tasks, added up by Spark: rows, and a number for each place."""
    each = parts.repartition("at").select("at", "rows", F.posexplode(F.arrays_zip("low", "mid", "high")).alias("j", "v"))
    found = each.groupBy("at", "j").agg(F.sum("rows").alias("rows"), *[F.sum(f"v.{c}").alias(c) for c in ("low", "mid", "high")])
    sums = found.toPandas()
    if sums.empty:
        return 0, {}
    values = {(int(i), int(j)): int(a) + (int(b) << LIMB) + (int(c) << 2 * LIMB) for i, j, a, b, c in
              zip(sums["at"], sums["j"], sums["low"], sums["mid"], sums["high"])}
    return int(sums["rows"].iloc[0]), values


def _ratio(above: int, below: int) -> np.longdouble:
    """A fraction to the precision of a long double."""
    first = above / below
    rest = Fraction(above, below) - Fraction(first)
    return np.longdouble(first) + np.longdouble(float(rest))


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvectors after Ogita-Aishima rounds, their eigenvalues, both by falling eigenvalue, and which pairs were told apart.

    A pair is corrected once its correction is small, as the rounds need; other pairs are only kept at right angles.
    """
    eye, last = np.eye(len(a), dtype=a.dtype), np.inf
    for count in range(ROUNDS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        above = s + values[None, :] * r
        np.fill_diagonal(above, 0)
        gap = values[None, :] - values[:, None]
        apart = np.maximum(np.abs(above), np.abs(above.T)) < SMALL * np.abs(gap)
        e = np.where(apart, above / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        size = np.abs(e).max()
        if size <= 4 * np.finfo(a.dtype).eps or count > 2 and size > last / 2:
            break
        last = size
    for _ in range(3):  # what is left of large corrections, and of pairs that rounding hides
        x = x + x @ ((eye - x.T @ x) / 2)
    values = (x * (a @ x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    return x[:, order], values[order], apart[np.ix_(order, order)]


def _clusters(apart: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (first, end) of neighbouring eigenvalues in which some pair was not told apart."""
    size, found, end = len(apart), [], 0
    for first in range(size):
        if first >= end:
            end = first + 1
            k = first
            while k < end:
                near = np.flatnonzero(~apart[k])
                end = max(end, int(near.max(initial=k)) + 1)
                k += 1
            if end - first > 1:
                found.append((first, end))
    return found


def eigenvectors(a: np.ndarray, deepest: int = DEEPEST) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of a symmetric long double matrix."""
    size = len(a)
    scale = np.abs(a).max(initial=0)
    if size < 2 or not scale:
        return np.diag(a).copy(), np.eye(size, dtype=a.dtype)
    unit = a / scale
    _, start = np.linalg.eigh(unit.astype(np.float32))
    x, values, apart = _corrected(unit, start.astype(a.dtype))
    noise, solved = 8 * size * np.finfo(a.dtype).eps, False
    for first, end in _clusters(apart) if deepest else []:
        part = x[:, first:end]
        inner = part.T @ (unit @ part - values[first:end].mean() * part)
        inner = (inner + inner.T) / 2
        if np.abs(inner).max() > noise:  # below, the eigenvalues are one number as far as can be told
            x[:, first:end] = part @ eigenvectors(inner, deepest - 1)[1]
            solved = True
    if solved:
        x, values, _ = _corrected(unit, x)
    return values * scale, x / np.sqrt((x * x).sum(0))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from all rows of ``x``; None if there are none or they are all equal.

    Components whose eigenvalue is zero as far as can be told are left out, since nothing can be divided by it.
    """
    n, sums = _added(vectors.select("x").mapInArrow(_sums, _PARTS))
    if not n:
        return None
    total = [sums[0, j] for j in range(len(sums))]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    _, products = _added(vectors.select("x").mapInArrow(lambda batches: _products(batches, centre), _PARTS))
    d = len(total)
    covariance = np.zeros((d, d), np.longdouble)
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = _ratio(n * products[i, j] - rest[i] * rest[j], n * n)
    trace = sum(n * products[i, i] - rest[i] * rest[i] for i in range(d))
    if not trace:
        return None
    values, x = eigenvectors(covariance)
    used = min(components, int((values > d * np.finfo(np.float64).eps * values[0]).sum()))
    values, x = values[:used], x[:, :used]
    x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(0)[None, :], 0)[0] < 0, -1, 1)
    whole = _ratio(trace, n * n)
    return Whitening(n, centre, rest, x.T.copy(), values, [float(v / whole) for v in values])


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    mean = np.array([r / model.n for r in model.rest])
    return ((x - model.centre).astype(np.float64) - mean) @ model.projection


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    y = x - model.centre
    most = model.n * int(np.abs(y).max(initial=0)) + max(map(abs, model.rest))
    if most * most * y.shape[1] < 1 << 63:
        z = model.n * y - np.array(model.rest, np.int64)
        return (z * z).sum(1).tolist()
    z = model.n * y.astype(object) - np.array(model.rest, object)
    return [v if v < 1 << 63 else None for v in (z * z).sum(1).tolist()]


def transformed(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``doc``, ``deviation`` (null where it needs more than 64 bits) and ``w``, the whitened vector, of each row."""
    schema = T.StructType([vectors.schema["doc"], T.StructField("deviation", T.LongType()),
                           T.StructField("w", T.ArrayType(T.DoubleType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(_deviations(x, model), pa.int64()),
                     pa.array(list(_projected(x, model)), pa.list_(pa.float64()))], ["doc", "deviation", "w"])

    return vectors.select("doc", "x").mapInArrow(rows, schema)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    size = len(model.eigenvalues)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            if batch.num_rows:
                w = _projected(_matrix(batch), model)
                total[:size] += w.T @ w
                total[size] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["at", "v"])

    each = vectors.select("x").mapInArrow(parts, "at int, v array<double>").repartition("at") \
        .select("at", F.posexplode("v").alias("j", "v"))
    found = each.groupBy("at", "j").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((size + 1, size))
    sums[found["at"], found["j"]] = found["v"]
    mean = sums[size] / model.n
    return float(np.abs(sums[:size] / model.n - np.outer(mean, mean) - np.eye(size)).max())


def whiten(vectors: DataFrame, keep: Sequence[str] = ("vec_id",), vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``keep``, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds a null or an entry that is not finite, are dropped.
    Where lengths differ, those of the most frequent length are used (of equally frequent
    ones the longest) and all others are dropped; so are vectors without entries. Entries
    beyond 2^34 are taken as 2^34. Repeated rows and ids count and are returned each for
    itself. Components of equal eigenvalue are some basis of their space, the same for all
    rows. Where all vectors are equal, or none is left, there are no components and so no
    rows. Columns of the table that are not in ``keep`` are not read, so names cannot clash.
    """
    bounded_batches(vectors.sparkSession)
    rows = stage(whole_vectors(vectors, keep, vector), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0))
    model = fit(rows, components) if lengths else None
    empty = F.array().cast("array<double>")
    if model is None:
        n, error, explained = 0, 0.0, empty
        found = rows.where(F.lit(False)).select("doc", F.lit(0).cast("long").alias("deviation"), empty.alias("w"))
    else:
        n, error = model.n, identity_error(rows, model)
        explained = F.array(*[F.lit(v) for v in model.explained])
        found = transformed(rows, model)
    each = found.select("doc", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("doc.*", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
