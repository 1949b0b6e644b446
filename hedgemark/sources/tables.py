"""Parquet tables: staged intermediates, snapshots, upserts and change logs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgemark.session import shared_dir

_runs: dict[str, str] = {}
#: What open ``scratch`` blocks have staged, the innermost last.
_scratch: list[list[str]] = []


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/hedgemark-{app}-{uuid.uuid4().hex[:8]}"
    return _runs[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the written copy.

    Cuts the lineage, survives lost executors, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside the block at its end, so that a long run does not fill the folder.

    Results must be written elsewhere before the block ends.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _, hpath, fs = _fs(spark, path)
            fs.delete(hpath, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application staged, once its results have been read."""
    app = spark.sparkContext.applicationId
    if app in _runs:
        _, hpath, fs = _fs(spark, _runs.pop(app))
        fs.delete(hpath, True)


def merge_rows(current: DataFrame, changes: DataFrame, keys: Sequence[str],
               on_clash: str = "replace", replace: Sequence[str] | None = None) -> DataFrame:
    """Insert rows; on a key clash keep the old row or take over named columns.

    ``changes`` holds one row per key. The anti-join shuffles each side once and
    needs no window over the union.
    """
    keys = list(keys)
    if on_clash == "ignore":
        return current.unionByName(changes.join(current.select(*keys), keys, "left_anti"))
    if on_clash != "replace":
        raise ValueError(f"unknown clash rule: {on_clash}")
    taken = [c for c in current.columns if c not in keys] if replace is None else list(replace)
    if set(taken) == set(current.columns) - set(keys):
        return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
    new = changes.select(*keys, F.struct(*changes.columns).alias("__new"))
    merged = current.withColumn("__old", F.lit(True)).join(new, keys, "full")
    return merged.select(*[
        F.col(c) if c in keys else
        F.when(F.col("__new").isNotNull() & (F.lit(c in taken) | F.col("__old").isNull()),
               F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
        for c in current.columns
    ])


def write_entries(entries: DataFrame, path: str) -> None:
    """Append rule rows, one folder per list version.

    Rows are spread by version and value, so one huge version is written by many tasks.
    """
    (
        entries.repartition("blocklist_version_id", F.pmod(F.xxhash64("normalized_value"), F.lit(32)))
        .write.mode("append").partitionBy("blocklist_version_id").parquet(path)
    )


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders below ``path``; none if it is not there."""
    _, root, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already. Of several who try at once only one gets it."""
    jvm, hpath, fs = _fs(spark, path)
    fs.mkdirs(hpath.getParent())
    if fs.getScheme() == "file":
        return jvm.java.io.File(hpath.toUri().getPath()).createNewFile()
    try:
        return fs.createNewFile(hpath)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            return False
        raise


def publish_snapshot(df: DataFrame, path: str) -> int:
    """Write a complete table under the next free version number of ``path``.

    The number is claimed first, so writers at the same time get different versions; a
    version whose writer dies is never read, and its number is not used again.
    """
    spark = df.sparkSession
    while True:
        taken = [int(n[2:12]) for n in listing(spark, path) if re.fullmatch(r"(v=|c-)\d{10}", n)]
        version = max(taken, default=0) + 1
        if claim(spark, f"{path}/c-{version:010d}"):
            break
    df.write.parquet(f"{path}/v={version:010d}")
    return version


def latest_snapshot(spark: SparkSession, path: str) -> int | None:
    """The newest version that was written to its end."""
    jvm, root, fs = _fs(spark, path)
    if not fs.exists(root):
        return None
    done = [
        int(s.getPath().getName()[2:])
        for s in fs.listStatus(root)
        if s.getPath().getName().startswith("v=")
        and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max(done, default=None)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    version = latest_snapshot(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v={version:010d}")


def append_changes(changes: DataFrame, path: str, batch_id: int) -> None:
    """Add one micro-batch to a change log; a repeated batch replaces itself."""
    changes.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_state(state: DataFrame, path: str, batch_id: int) -> None:
    """Keep what a stream carries from one micro-batch to the next; that of the batch before stays, for a repeat."""
    state.write.mode("overwrite").parquet(f"{path}/state-{batch_id}")
    spark = state.sparkSession
    for name in listing(spark, path):
        if name.startswith("state-") and int(name[6:]) < batch_id - 1:
            _, hpath, fs = _fs(spark, f"{path}/{name}")
            fs.delete(hpath, True)


def read_state(spark: SparkSession, path: str, before: int | None, schema: str) -> DataFrame:
    """The state that the batch ``before`` this one left (none before the first); without it, that of the last batch."""
    if before is None:
        before = 1 + max((int(n[6:]) for n in listing(spark, path) if n.startswith("state-")), default=-1)
    if before == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/state-{before - 1}")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_rows(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The winning row of each key of a change log (merge on read)."""
    keys = list(keys)
    best = log.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in log.columns if c not in keys]), F.struct(*order)).alias("__row")
    )
    return best.select(*keys, "__row.*")


def exists(spark: SparkSession, path: str) -> bool:
    _, hpath, fs = _fs(spark, path)
    return fs.exists(hpath)
