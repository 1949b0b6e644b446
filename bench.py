"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "article_verdicts", "page_verdicts", "read_events", "validate_events", "recompute_event_ids", "dedup_events", "current_revisions",
    "ingest_filter", "extract_urls", "cap_urls", "normalize_urls", "registrable_domains", "parse_blocklists",
    "import_decision", "policy_snapshot", "match_targets", "explain_lists", "domain_tree_match", "ip_ranges",
    "resolve_redirects", "scan", "match_hops", "scan_summary", "classify_events", "latest_scans", "article_states",
    "target_verdict", "batch_lookup", "event_detail", "recent_events", "recent_matches", "label_plan",
    "check_constraints", "rate_window_audit", "replay_detection", "stream_ingest", "stream_current_revision",
)


def main() -> None:
    from hedgemark.plans import inputs
    from hedgemark.plans.catalog import QUERIES
    from hedgemark.session import build_session
    from hedgemark.sources.tables import drop_staged

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # inputs the queries share are made first; they count in the total and are reported apart, too
    start = time.time()
    inputs.feed_path(spark, sf)
    for build in (inputs.stored, inputs.addresses, inputs.hits, inputs.edges):
        build(spark, sf)
    setup = time.time() - start
    seconds: dict[str, float] = {}
    only = sys.argv[1:] or HEADLINE
    for name in only:
        start = time.time()
        if name == "scan":
            inputs.scan(spark, sf)
        else:
            run(QUERIES[name](spark, sf))
        seconds[name] = round(time.time() - start, 3)
    drop_staged(spark)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(setup + sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "setup_sec": round(setup, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
