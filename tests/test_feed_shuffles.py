"""Texts of the feed are dealt out once and never sorted on their way to the landed files."""

from hedgemark.plans import inputs as inp
from hedgemark.sources import feeds


def test_links_are_hashed_and_texts_not_sorted(spark, sf):
    plan = inp.feed_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert inp.feed_lines(spark, sf).rdd.getNumPartitions() == inp.FEED_FILES


def test_lines_are_written_where_they_are_made(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).selectExpr("lpad(id, 3, '0') AS value")
    for files, made in ((8, 4), (2, 2)):
        path = str(tmp_path / f"feed-{files}")
        feeds.write_feed(rows, path, files)
        landed = sorted([r.value for r in spark.read.text(str(f)).collect()] for f in (tmp_path / f"feed-{files}").glob("part-*"))
        assert len(landed) == made
        assert [value for lines in landed for value in lines] == [f"{n:03d}" for n in range(400)]
