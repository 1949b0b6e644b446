"""Shapes the plans must keep, and the hot-key ways against the plain ones."""

import pytest
from pyspark.sql import functions as F

from hedgemark.operators import events as ev, joins, policy as pol, scan as sc, state as st
from hedgemark.operators import urls as url_jobs
from hedgemark.plans import catalog, inputs as inp
from hedgemark.sources import tables as tb
from hedgemark.streaming import jobs as live


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def full(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_page_verdicts_read_two_columns(spark, sf):
    text = full(catalog.flagship(spark, sf))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text and "html" not in text


def test_extraction_needs_no_shuffle_and_runs_once(spark, sf):
    text = plan(url_jobs.extract_urls(inp.stored(spark, sf), inp.LIMITS))
    assert "Exchange" not in text
    assert text.count("regexp_extract_all") == 5, "each pattern appears once, so no filter repeats the extraction"


def test_validation_runs_once_per_row(spark, sf):
    text = plan(ev.accepted_events(inp.feed(spark, sf)))
    assert "Exchange" not in text and " Filter " not in text


def test_plain_hosts_stay_out_of_python(spark, sf):
    df = inp.page_urls(spark, sf)
    special = df.filter("hostname is not null and not hostname rlike '^[a-z0-9._-]+$'")
    assert special.count() == 0
    assert plan(df).count("ArrowEvalPython") == 1


def test_newest_per_relay_is_cut_before_the_shuffle(spark, sf):
    text = plan(ev.ingest_filter(inp.valid(spark, sf), inp.NOW, inp.LIMITS))
    assert text.count("WindowGroupLimit") == 2


def test_top_lists_are_heaps(spark, sf):
    assert plan(catalog.QUERIES["policy_listing"](spark, sf)).count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(inp.stored(spark, sf).orderBy(F.desc("last_seen_at"), "event_id").limit(100))


def test_aggregates_combine_before_the_shuffle(spark, sf):
    for df in (ev.current_revisions(inp.stored(spark, sf)), st.latest_scans(inp.scan_log(spark, sf)),
               pol.one_hit_per_category(inp.snapshot(spark, sf)), ev.dedup_events(inp.valid(spark, sf))):
        assert "partial_" in plan(df)


def test_entries_filter_reaches_the_scan(spark, sf):
    text = full(inp.entries(spark, sf).filter(F.col("rule_type").isin("host", "domain")).select("entry_id"))
    assert "PushedFilters: [In(rule_type" in text or "PushedFilters: [IsNotNull(rule_type)" in text


def test_hot_ways_give_the_same_scan(spark, sf, monkeypatch):
    plain = inp.scan(spark, sf)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    hot = sc.scan_articles(
        inp.stored(spark, sf), inp.edges(spark, sf), inp.hits(spark, sf), inp.skip_hosts(spark, sf),
        inp.GENERATION, inp.SCANNED, inp.LIMITS)
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for name in ("scans", "matches", "resolutions", "classifications", "chains"):
        assert rows(getattr(plain, name)) == rows(getattr(hot, name)), name
    assert "__part" in plan(hot.matches)


def test_late_old_revision_never_wins(spark, tmp_path):
    from tests.test_jobs import event, feed_of
    import json

    def land(folder, *events):
        lines = [json.dumps({"relay": "wss://r0.example", "received_at": 10 + i, "event": e}) for i, e in enumerate(events)]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)

    feed, root = str(tmp_path / "feed"), str(tmp_path / "root")
    new, old = event(created_at=50, content="new"), event(created_at=10, content="old")
    land(feed, new)
    assert live.run_revisions(spark, feed, root).first().current_event_id == new["id"]
    land(feed, old)
    after = live.run_revisions(spark, feed, root).collect()
    assert [(r.current_event_id, r.current_event_created_at) for r in after] == [(new["id"], 50)]


def test_stream_resumes_without_repeats(spark, tmp_path):
    from tests.test_jobs import event
    import json

    feed, root = str(tmp_path / "feed"), str(tmp_path / "root")
    for n in range(2):
        line = json.dumps({"relay": "wss://r0.example", "received_at": 1, "event": event(content=f"c{n}")})
        spark.createDataFrame([(line,), ("broken",)], "value string").coalesce(1).write.mode("append").text(feed)
        accepted, rejected = live.run_ingest(spark, feed, root)
        assert (accepted.count(), rejected.count()) == (n + 1, n + 1)


def test_staged_tables_go_to_the_named_folder(spark, sf):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert named and tb.run_dir(spark).startswith(named)
    assert named in tb.stage(spark.range(3), "x").inputFiles()[0]
