"""Nothing is lost: late and untimed rows, long texts, damaged lists, look-ups that cannot be answered."""


from pyspark.sql import functions as F

from hedgemark.config import DEFAULTS, Limits
from hedgemark.functions.addresses import has_blocked_address
from hedgemark.operators import events as ev
from hedgemark.plans import inputs as inp, moderation as mod
from hedgemark.sources import feeds
from hedgemark.sources.tables import run_dir, scratch, stage
from hedgemark.streaming import jobs as live
from tests.test_jobs import event, feed_of, small_policy

SHORT = Limits(feed_window_s=300)


def landed(spark, sf, files=24):
    path = f"{run_dir(spark)}/late-feed"
    if not feeds_exist(spark, path):
        feeds.write_feed(inp.feed_lines(spark, sf), path, files)
    return path


def feeds_exist(spark, path):
    from hedgemark.sources.tables import exists
    return exists(spark, path)


def test_first_sight_keeps_late_events(spark, sf, tmp_path):
    path = landed(spark, sf)
    whole = ev.accepted_events(feeds.read_events(spark, path), SHORT).select("event_id").distinct()
    got = live.run_first_sight(spark, path, str(tmp_path), SHORT, files_per_batch=3)
    assert got.count() == whole.count() and got.join(whole, "event_id", "left_anti").count() == 0


def test_counters_keep_late_and_untimed_rows(spark, sf, tmp_path):
    path = landed(spark, sf)
    got = live.run_counters(spark, path, str(tmp_path), SHORT, files_per_batch=3)
    assert got.agg(F.sum("n")).first()[0] == spark.read.text(path).count()
    assert got.where("window_start is null").agg(F.sum("n")).first()[0] > 0


def test_a_restart_counts_nothing_twice(spark, sf, tmp_path):
    path = landed(spark, sf)
    first = live.run_counters(spark, path, str(tmp_path), SHORT, files_per_batch=5).agg(F.sum("n")).first()[0]
    again = live.run_counters(spark, path, str(tmp_path), SHORT, files_per_batch=5).agg(F.sum("n")).first()[0]
    assert first == again


def test_long_texts_are_stored(spark, sf):
    lost = ev.check_events(inp.feed(spark, sf), inp.LIMITS).where("reason = 'content_too_large'")
    assert inp.LIMITS.max_content_bytes == DEFAULTS.max_content_bytes and lost.count() == 0


def test_one_bad_byte_spoils_no_other_list(spark, tmp_path):
    for name, body in (("good", b"a.test\nb.test\n"), ("bad", b"c.test\n\xff\xfe\nd.test")):
        (tmp_path / f"blocklist_id={name}").mkdir()
        (tmp_path / f"blocklist_id={name}" / "body.txt").write_bytes(body)
    got = {r.blocklist_id: (r.bytes, r.body) for r in feeds.read_list_bodies(spark, str(tmp_path)).collect()}
    assert got["good"] == (14, "a.test\nb.test\n") and got["bad"][0] == 16
    assert got["bad"][1].split("\n")[::2] == ["c.test", "d.test"]


def test_a_landed_body_is_the_same_body(spark, tmp_path):
    path = str(tmp_path / "landed")
    rows = spark.createDataFrame([("x", "a.test\n\nb.test"), ("y", "c.test\n"), ("z", "")], "blocklist_id string, body string")
    feeds.write_list_bodies(rows, path)
    got = feeds.read_list_bodies(spark, path, Limits(max_list_bytes=14))
    assert {(r.blocklist_id, r.body) for r in got.collect()} == {tuple(r) for r in rows.collect()}


def test_d_tags_by_their_json_type(spark):
    tags = [[["d", 5]], [["d", 5], ["d", "x"]], [["d", None], ["d", "y"]], [["d"], ["d", "z", 1]], [["d", ["q"]]]]
    got = ev.accepted_events(feed_of(spark, *[event(tags=t) for t in tags])).select("d_tag").collect()
    assert sorted(str(r.d_tag) for r in got) == ["None", "None", "x", "y", "z"]


def test_look_ups_that_cannot_be_answered_are_not_clean(spark):
    policy, _ = small_policy(spark, [("v1", "domain", "evil.com", "evil.com")])
    asked = spark.createDataFrame([(0, "two words"), (1, ""), (2, None), (3, "fine.test")], "i int, host string")
    got = mod.domain_answers(asked, "host", policy, ["i"]).orderBy("i").collect()
    assert [(r.target_error, r.status, r.blacklisted) for r in got] == [("invalid_domain", None, None)] * 3 + [(None, "clean", False)]
    urls = spark.createDataFrame([(0, "https://fine.test/" + "x" * 5000), (1, "no url"), (2, "https://fine.test/")], "i int, url string")
    got = mod.target_verdicts(urls, "url", policy.hits, ["i"]).orderBy("i").collect()
    assert [(r.target_error, r.status, r.verdict) for r in got] == [
        ("url_too_long", None, "invalid"), ("invalid_url", None, "invalid"), (None, "clean", "clean")]


def test_addresses_that_are_none_are_blocked(spark):
    rows = [(["999.1.1.1"],), (["junk"],), (["127.1"],), (["0x7f.1"],), ([None],), ([],), (None,), (["93.184.1.1", None],), (["93.184.1.1"],)]
    got = spark.createDataFrame(rows, "ips array<string>").select(has_blocked_address(F.col("ips"))).collect()
    assert [r[0] for r in got] == [True] * 8 + [False]


def test_a_long_run_does_not_fill_the_folder(spark, sf, tmp_path):
    policy, categories = small_policy(spark, [("v1", "domain", "evil.com", "evil.com")])
    skip = spark.createDataFrame([], "host string")
    edges = inp.edges(spark, sf)
    path = landed(spark, sf)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = {str(s.getPath()) for s in files.listStatus(root)}
    live.run_scans(spark, path, str(tmp_path), lambda: policy, edges, skip, categories, 1, files_per_batch=12)
    assert live.scanned(spark, str(tmp_path)).count() == inp.stored(spark, sf).count()
    left = {str(s.getPath()) for s in files.listStatus(root)} - before
    assert not [p for p in left if "live-" in p or "finds" in p or "chains" in p], left


def test_scratch_deletes_what_was_staged_inside(spark):
    outside = stage(spark.range(3), "outside")
    with scratch(spark):
        inside = stage(spark.range(3), "inside")
        path = inside.inputFiles()[0].rsplit("/", 1)[0]
        assert feeds_exist(spark, path)
    assert not feeds_exist(spark, path) and outside.count() == 3
