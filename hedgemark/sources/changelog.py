"""Keyed tables that grow by change folders and are compacted behind a manifest.

A table is a base (one row per key) and the change folders that came after it, one per
micro-batch. Reading merges them: the newest row of a key wins, and a key whose newest row
is a tombstone is gone. ``compact`` writes a new base and then names it, together with the
last batch in it, in the next manifest. Whoever planned by an older manifest still finds
its folders: they are deleted one compaction later. So folders stay bounded, and a reader
sees the table either before or after a compaction, never in between.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgemark.sources.tables import _fs, claim, exists, latest_rows, listing

_GONE = "__gone"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    base: str | None = None
    through: int = -1


class ChangeLog:
    """The table below ``path``: ``keys`` name a row, of several the greatest by ``order`` wins."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]):
        self.spark, self.path, self.keys, self.order = spark, path, list(keys), list(order)

    def manifest(self) -> Manifest:
        done = [int(n[1:-5]) for n in listing(self.spark, f"{self.path}/manifests") if re.fullmatch(r"v\d+\.json", n)]
        if not done:
            return Manifest()
        version = max(done)
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/v{version:010d}.json").collect())
        return Manifest(version, **json.loads(text))

    def _batches(self) -> list[int]:
        """Batches that were written to their end."""
        found = [int(n[6:]) for n in listing(self.spark, f"{self.path}/changes") if re.fullmatch(r"batch-\d+", n)]
        return sorted(n for n in found if exists(self.spark, f"{self.path}/changes/batch-{n}/_SUCCESS"))

    def append(self, changes: DataFrame, batch_id: int, gone: DataFrame | None = None) -> None:
        """Add one micro-batch; ``gone`` (keys and order columns) marks rows as deleted.

        A repeated batch replaces itself, or is skipped if it is in the base already.
        """
        if batch_id <= self.manifest().through:
            return
        rows = changes.withColumn(_GONE, F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(*dict.fromkeys([*self.keys, *self.order])).withColumn(_GONE, F.lit(True)),
                                    allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch-{batch_id}")

    def _merged(self, manifest: Manifest, upto: int | None = None) -> DataFrame | None:
        paths = [f"{self.path}/changes/batch-{n}" for n in self._batches()
                 if n > manifest.through and (upto is None or n <= upto)]
        if manifest.base is not None:
            paths.append(f"{self.path}/{manifest.base}")
        if not paths:
            return None
        schema = self.spark.read.parquet(paths[-1]).schema
        return latest_rows(self.spark.read.schema(schema).parquet(*paths), self.keys, self.order)

    def rows(self) -> DataFrame:
        """The rows that are there now."""
        merged = self._merged(self.manifest())
        if merged is None:
            raise FileNotFoundError(self.path)
        return merged.where(~F.col(_GONE)).drop(_GONE)

    def compact(self) -> bool:
        """Merge all finished batches into a new base; False if another compaction was faster.

        Tombstones stay in the base, so a change that comes late cannot bring a deleted row back.
        """
        now, batches = self.manifest(), self._batches()
        later = [n for n in batches if n > now.through]
        if not later:
            return True
        base = f"base-{uuid.uuid4().hex}"
        self._merged(now, later[-1]).write.parquet(f"{self.path}/{base}")
        if not claim(self.spark, f"{self.path}/manifests/v{now.version + 1:010d}.claim"):
            self._delete(base)
            return False
        text = json.dumps({"base": base, "through": later[-1]})
        self._publish(f"manifests/v{now.version + 1:010d}.json", text)
        # the folders of the manifest before last: no plan that is still running names them
        for name in listing(self.spark, self.path):
            if name.startswith("base-") and name not in (base, now.base):
                self._delete(name)
        for n in batches:
            if n <= now.through:
                self._delete(f"changes/batch-{n}")
        return True

    def _publish(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        jvm, target, fs = _fs(self.spark, f"{self.path}/{name}")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(draft, target):
            raise FileExistsError(f"{self.path}/{name}")

    def _delete(self, name: str) -> None:
        _, hpath, fs = _fs(self.spark, f"{self.path}/{name}")
        fs.delete(hpath, True)
