"""Stream windows that expire, change logs that are compacted, and snapshots with several writers."""

import os
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hedgemark.config import Limits
from hedgemark.operators import audit
from hedgemark.sources import tables as tb
from hedgemark.sources.changelog import ChangeLog
from hedgemark.streaming import jobs as live

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "id string, key string, ts timestamp, cost bigint"


def land(spark, path, *batches):
    """One file per batch, in this order; requests as (id, key, seconds, cost)."""
    for batch in batches:
        rows = [(i, k, None if s is None else START + timedelta(seconds=s), c) for i, k, s, c in batch]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def seconds(us):
    return None if us is None else us // 1_000_000 - int(START.timestamp())


def outcomes(df):
    return sorted((r.id or "", seconds(r.us) or 0, r.outcome) for r in df.collect())


FOUR = [
    [("a", "k", 0, 1), ("b", "k", 10, 1), ("c", "k", 20, 1), ("d", "k", 20, 1), ("e", "k", 30, 1)],
    [("a", "k", 121, 1), ("b", "k", 129, 1), ("f", "k", 131, 1), (None, "k", 131, 1), ("g", "k", None, 1)],
    [("b", "k", 200, 1), ("c", "k", 140, 1), ("f", "k", 251, 1), ("f", "k", 251, 1), ("x", "k", 300, 1)],
    [("b", "k", 330, 1), ("x", "k", 400, 1), ("e", "k", 401, 1)],
    [("late", "k", 5, 1), ("x", "k", 521, 1)],
]
JUDGED = sorted([
    ("a", 0, "fresh"), ("b", 10, "fresh"), ("c", 20, "fresh"), ("d", 20, "fresh"), ("e", 30, "fresh"),
    ("a", 121, "fresh"), ("b", 129, "replay"), ("f", 131, "fresh"), ("", 131, "invalid"), ("g", 0, "invalid"),
    ("b", 200, "replay"), ("c", 140, "fresh"), ("f", 251, "fresh"), ("f", 251, "replay"), ("x", 300, "fresh"),
    ("b", 330, "fresh"), ("x", 400, "replay"), ("e", 401, "fresh"), ("late", 5, "late"), ("x", 521, "fresh")])


def test_ids_expire(spark, tmp_path):
    """119 seconds after the last sighting an id is a replay, 120 and 121 seconds after it is not."""
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, path, *FOUR)
    assert outcomes(live.run_replays(spark, path, root, files_per_batch=1)) == JUDGED
    left = tb.read_state(spark, f"{root}/seen", None, "id string, us bigint").collect()
    assert sorted((r.id, seconds(r.us)) for r in left) == [("e", 401), ("x", 521)]  # what lies 120 seconds back has expired
    assert len(tb.listing(spark, f"{root}/seen")) == 2


def test_replays_after_a_restart(spark, tmp_path):
    """A run that stops goes on where it was, and a batch that was not committed is judged again with the same result."""
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, path, *FOUR[:3])
    live.run_replays(spark, path, root, files_per_batch=1)
    commits = f"{root}/checkpoint-replays/commits"
    os.remove(f"{commits}/2")
    if os.path.exists(f"{commits}/.2.crc"):
        os.remove(f"{commits}/.2.crc")
    land(spark, path, *FOUR[3:])
    assert outcomes(live.run_replays(spark, path, root, files_per_batch=1)) == JUDGED


def test_replays_against_pairs(spark):
    """An id in very many rows, and all pairs of rows compared."""
    rows = [("hot" if k % 3 else f"i{k % 7}", 1_000_000 * (k * k % 5_003)) for k in range(900)]
    got = audit.replay_outcomes(spark.createDataFrame(rows, "id string, us bigint"), Limits(replay_window_s=5))
    want, ranked = [], sorted(rows)
    for at, (i, us) in enumerate(ranked):
        before = at and ranked[at - 1][0] == i and us - ranked[at - 1][1] < 5_000_000
        want.append((i, us, "replay" if before else "fresh"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_closed_windows_never_change(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    limits = Limits(rate_limit=5)
    batches = [
        [("a", "k", 0, 2), ("b", "k", 59, 3), ("c", "m", 61, 9)],
        [("d", "k", 10, 1), ("e", "k", 130, 4)],         # 10 is late, but its window is still open
        [("f", "k", 20, 7), ("g", None, 131, 2), ("h", "m", None, 5)],  # 20 comes after its window closed
        [("i", "m", 110, 1), ("j", "k", 400, 1)],
    ]
    seen = {}
    for n, batch in enumerate(batches):
        land(spark, path, batch)
        got = {(r.key, seconds(r.window_start * 1_000_000)): (r.used, r.limited, r.closed)
               for r in live.run_rate_windows(spark, path, root, limits, late_s=30, files_per_batch=1).collect()}
        assert all(got[k] == v for k, v in seen.items() if v[2]), n
        seen = got
    assert seen == {("k", 0): (6, True, True), ("m", 60): (10, True, True), ("k", 120): (4, False, True),
                    (None, 120): (2, False, True), ("k", 360): (1, False, False)}
    late = live.late_requests(spark, root).collect()
    assert sorted(r.id for r in late) == ["f", "h"]
    total = sum(c for batch in batches for *_, c in batch)
    assert sum(v[0] for v in seen.values()) + sum(r.cost for r in late) == total


def test_history_does_not_grow_the_cost(spark, sf, tmp_path):
    """The scan stream reads no earlier table: what it knows of earlier events is keyed state."""
    from hedgemark.plans import inputs as inp
    from hedgemark.sources import feeds
    from tests.test_jobs import small_policy
    path, root = str(tmp_path / "feed"), str(tmp_path / "out")
    feeds.write_feed(inp.feed_lines(spark, sf), path, 6)
    policy, categories = small_policy(spark, [("v1", "domain", "evil.com", "evil.com")])
    skip = spark.createDataFrame([], "host string")
    live.run_scans(spark, path, root, lambda: policy, inp.edges(spark, sf), skip, categories, 1, files_per_batch=1)
    scans = live.scanned(spark, root)
    assert scans.count() == scans.select("event_id").distinct().count() == inp.stored(spark, sf).count()
    assert scans.select("batch").distinct().count() > 3
    assert sorted(n for n in tb.listing(spark, root)) == ["checkpoint-scan", "scans", "states"]


def row(spark, *rows):
    return spark.createDataFrame(rows, "k string, n int, v string")


def state(log):
    return sorted((r.k, r.n, r.v) for r in log.rows().collect())


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    log = ChangeLog(spark, path, ["k"], ["n"])
    with pytest.raises(FileNotFoundError):
        log.rows()
    assert log.compact()
    want = {}
    for n in range(12):
        log.append(row(spark, (f"k{n % 5}", n, f"v{n}"), (f"x{n}", 0, "x")), n,
                   gone=row(spark, (f"x{n - 1}", 1, "")) if n else None)
        want[f"k{n % 5}"] = (n, f"v{n}")
        before = state(log)
        assert [r for r in before if r[0][0] == "k"] == sorted((k, *v) for k, v in want.items())
        assert [r[0] for r in before if r[0][0] == "x"] == [f"x{n}"]
        if n % 3 == 2:
            reader = log.rows()  # planned before the compaction, read after it
            assert log.compact() and state(log) == before
            assert sorted((r.k, r.n, r.v) for r in reader.collect()) == before
    names = tb.listing(spark, path)
    assert len([n for n in names if n.startswith("base-")]) == 2
    assert sorted(tb.listing(spark, f"{path}/changes")) == ["batch-10", "batch-11", "batch-9"]
    log.append(row(spark, ("k0", 99, "again")), 11)  # a batch that is in the base already
    assert state(log) == before
    log.append(row(spark, ("x3", 0, "older than its tombstone")), 12)
    assert state(log) == before and log.compact() and state(log) == before


def test_one_compaction_wins(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["k"], ["n"])
    log.append(row(spark, ("a", 1, "x")), 0)
    assert tb.claim(spark, f"{log.path}/manifests/v0000000001.claim")  # another one is at it
    assert not log.compact()
    assert state(log) == [("a", 1, "x")] and not [n for n in tb.listing(spark, log.path) if n.startswith("base-")]


def test_unfinished_batch_is_not_read(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), ["k"], ["n"])
    log.append(row(spark, ("a", 1, "x")), 0)
    log.append(row(spark, ("a", 2, "y")), 1)
    os.remove(f"{log.path}/changes/batch-1/_SUCCESS")
    assert state(log) == [("a", 1, "x")]


def test_dedup_with_compaction(spark, sf, tmp_path):
    from hedgemark.plans import inputs as inp
    from hedgemark.sources import feeds
    path = str(tmp_path / "feed")
    feeds.write_feed(inp.feed_lines(spark, sf), path, 6)
    plain = live.run_revisions(spark, path, str(tmp_path / "a"), files_per_batch=1)
    often = live.run_revisions(spark, path, str(tmp_path / "b"), files_per_batch=1, compact_every=2)
    assert sorted(plain.collect()) == sorted(often.collect()) and plain.count() > 0
    assert len(tb.listing(spark, str(tmp_path / "b/log/changes"))) <= 4


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    path, got = str(tmp_path / "t"), []
    writers = [threading.Thread(target=lambda n=n: got.append((tb.publish_snapshot(spark.range(n), path), n))) for n in range(1, 5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(v for v, _ in got) == [1, 2, 3, 4]
    for version, n in got:
        assert spark.read.parquet(f"{path}/v={version:010d}").count() == n
    assert tb.read_snapshot(spark, path).count() == dict(got)[4]
    assert not tb.claim(spark, f"{path}/c-0000000004")
