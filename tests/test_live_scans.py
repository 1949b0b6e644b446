"""A micro-batch of the scan stream has each event once, and its texts are not shuffled a second time."""

from hedgemark.operators import events as ev
from hedgemark.plans import inputs as inp
from hedgemark.plans.moderation import Policy
from hedgemark.sources import feeds
from hedgemark.streaming import jobs as live


def test_each_event_is_scanned_once_without_a_second_shuffle(spark, sf, tmp_path, monkeypatch):
    path = str(tmp_path / "feed")
    lines = inp.feed_lines(spark, sf)
    feeds.write_feed(lines.unionByName(lines), path, 2)  # every line twice, in one batch and over two
    policy = Policy.of(inp.snapshot(spark, sf), inp.hits(spark, sf), inp.GENERATION)
    wanted = {r.event_id for r in inp.stored(spark, sf).select("event_id").collect()}
    edges, hosts = inp.edges(spark, sf), inp.skip_hosts(spark, sf)
    again = []
    monkeypatch.setattr(ev, "dedup_events", lambda valid, f=ev.dedup_events: again.append(1) or f(valid))
    root = live.run_scans(spark, path, str(tmp_path / "live"), lambda: policy, edges, hosts,
                          inp.categories(spark, sf), inp.SCANNED, inp.LIMITS, 1)
    got = [r.event_id for r in live.scanned(spark, root).select("event_id").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert not again
