"""Snapshots compared by the digests of their buckets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hedgemark.sources import buckets

SCHEMA = "a string, b long, value string, size double, tags array<string>, kind string"


def snapshot(spark, rows, path, n=16):
    buckets.write_bucketed(spark.createDataFrame(rows, SCHEMA), str(path), ["a", "b"], n)
    return str(path)


def made(rng, n):
    keys = rng.sample([(a, b) for a in ("x", "y", "", None) for b in (None, *range(40))], n)
    return {k: (rng.choice(["u", "", None]), rng.choice([0.0, 1.5, float("nan"), None]), rng.choice([[], ["p", None], None]), "k") for k in keys}


@pytest.mark.parametrize("seed", range(3))
def test_feed_like_dictionaries(spark, tmp_path, seed):
    rng = random.Random(seed)
    old = made(rng, 90)
    new = {k: v for k, v in old.items() if rng.random() < .8} | made(rng, 30)
    for k in rng.sample(sorted(new, key=str), 10):
        new[k] = ("v", *new[k][1:])
    paths = [snapshot(spark, [(*k, *v) for k, v in rows.items()], tmp_path / name) for name, rows in (("old", old), ("new", new))]
    got = buckets.change_feed(spark, *paths, ["a", "b"]).collect()
    kinds = {(r.a, r.b): r.kind for r in got}
    want = {k: "delete" for k in old.keys() - new.keys()} | {k: "insert" for k in new.keys() - old.keys()}
    want |= {k: "update" for k in old.keys() & new.keys() if repr(old[k]) != repr(new[k])}
    assert kinds == want and len(got) == len(want)
    for r in got:
        for side, rows in ((r.before, old), (r.after, new)):
            assert (side is None) == ((r.a, r.b) not in rows)
            assert side is None or repr(tuple(side)) == repr(((r.a, r.b) + rows[r.a, r.b]))


def test_one_changed_row_reads_one_bucket(spark, tmp_path):
    rows = [(f"k{i}", i, "v", 1.0, None, None) for i in range(400)]
    old = snapshot(spark, rows, tmp_path / "old", 64)
    new = snapshot(spark, [*rows[:7], (*rows[7][:2], None, 1.0, None, None), *rows[8:]], tmp_path / "new", 64)
    chosen = buckets.changed_buckets(spark, old, new)
    assert len(chosen) == 1
    feed = buckets.change_feed(spark, old, new, ["a", "b"])
    assert [(r.a, r.kind, r.before.value, r.after.value) for r in feed.collect()] == [("k7", "update", "v", None)]
    text = spark._jvm.PythonSQLUtils.explainString(feed._jdf.queryExecution(), "formatted")
    assert len(re.findall(rf"PartitionFilters: \[[^\]]*key_bucket#\d+L? = {chosen[0]}\)", text)) == 2


def test_digests_do_not_depend_on_order_or_tasks(spark, tmp_path):
    rows = [(f"k{i}", i, str(i % 7), 1.0, None, None) for i in range(200)]
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    buckets.write_bucketed(one, str(tmp_path / "one"), ["a", "b"], 8)
    buckets.write_bucketed(one.orderBy(F.desc("b")).repartition(5), str(tmp_path / "two"), ["a", "b"], 8)
    assert buckets.changed_buckets(spark, str(tmp_path / "one"), str(tmp_path / "two")) == []
    assert buckets.change_feed(spark, str(tmp_path / "one"), str(tmp_path / "two"), ["a", "b"]).count() == 0


def test_a_moved_null_is_a_change(spark, tmp_path):
    old = snapshot(spark, [("k", 1, "v", None, None, None)], tmp_path / "old")
    new = snapshot(spark, [("k", 1, None, None, None, "v")], tmp_path / "new")
    assert [r.kind for r in buckets.change_feed(spark, old, new, ["a", "b"]).collect()] == ["update"]


def test_empty_and_unfit_snapshots(spark, tmp_path):
    none, some = snapshot(spark, [], tmp_path / "none"), snapshot(spark, [("k", 1, "v", 1.0, [], "k")], tmp_path / "some")
    assert [r.kind for r in buckets.change_feed(spark, none, some, ["a", "b"]).collect()] == ["insert"]
    assert [r.kind for r in buckets.change_feed(spark, some, none, ["a", "b"]).collect()] == ["delete"]
    with pytest.raises(ValueError, match="numbers of buckets"):
        buckets.changed_buckets(spark, some, snapshot(spark, [("k", 1, "v", 1.0, [], "k")], tmp_path / "more", 32))
    with pytest.raises(FileNotFoundError):
        buckets.changed_buckets(spark, some, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="taken"):
        buckets.write_bucketed(spark.range(1).withColumn(buckets.BUCKET, F.lit(1)), str(tmp_path / "bad"), ["id"])
