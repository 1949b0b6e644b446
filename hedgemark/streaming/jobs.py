"""Structured Streaming versions of the event jobs.

Each ``run_*`` function drains what has landed (``availableNow``) and gives back the
table its sink holds. The plans inside are the batch operators. Sinks are change
logs, one folder per micro-batch that a repeated batch replaces, read back as the
newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgemark.config import DEFAULTS, Limits
from hedgemark.operators import audit, events as ev, scan as sc, state as st
from hedgemark.sources.changelog import ChangeLog
from hedgemark.sources.feeds import stream_events
from hedgemark.sources.tables import append_changes, read_changes, read_state, scratch, stage, write_state

#: Files of one micro-batch, unless the caller paces it otherwise.
FILES_PER_BATCH = 1_000
#: Micro-batches after which the folders of a change log are merged.
COMPACT_EVERY = 16


def _drain(df: DataFrame, root: str, name: str, on_batch: Callable[[DataFrame, int], None],
           mode: str = "append") -> None:
    query = (
        df.writeStream.outputMode(mode).foreachBatch(on_batch)
        .option("checkpointLocation", f"{root}/checkpoint-{name}")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _log_to(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: append_changes(batch.withColumn("seq", F.lit(batch_id)), path, batch_id)


def run_ingest(spark: SparkSession, feed: str, root: str, limits: Limits = DEFAULTS,
               files_per_batch: int = FILES_PER_BATCH) -> tuple[DataFrame, DataFrame]:
    """Validate as events land; accepted and rejected rows go to two tables."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            append_changes(ev.accepted_events(batch, limits), f"{root}/accepted", batch_id)
            append_changes(ev.rejected_events(batch, limits), f"{root}/rejected", batch_id)
        finally:
            batch.unpersist()

    _drain(stream_events(spark, feed, files_per_batch), root, "ingest", on_batch)
    return read_changes(spark, f"{root}/accepted"), read_changes(spark, f"{root}/rejected")


def _keep_in(log: ChangeLog, compact_every: int) -> Callable[[DataFrame, int], None]:
    """A sink that adds each micro-batch to a log and merges its folders every so many batches."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        log.append(batch.withColumn("seq", F.lit(batch_id)), batch_id)
        if batch_id % compact_every == compact_every - 1:
            log.compact()
    return on_batch


def run_dedup(spark: SparkSession, feed: str, root: str, limits: Limits = DEFAULTS,
              files_per_batch: int = FILES_PER_BATCH, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """One row per event id: first and last sight and relays, kept up to date.

    The state holds an id, two times and its relays, not the event.
    """
    seen = ev.accepted_events(stream_events(spark, feed, files_per_batch), limits).groupBy("event_id").agg(
        F.min("received_at").alias("first_seen_at"), F.max("received_at").alias("last_seen_at"),
        F.array_sort(F.collect_set("relay")).alias("relays"),
    )
    log = ChangeLog(spark, f"{root}/log", ["event_id"], ["seq"])
    _drain(seen, root, "dedup", _keep_in(log, compact_every), "update")
    return log.rows().drop("seq")


def run_first_sight(spark: SparkSession, feed: str, root: str, limits: Limits = DEFAULTS,
                    files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The first row of each event id, however late it lands.

    Every event is kept, so the state holds all ids seen; it has nothing else.
    """
    fresh = ev.accepted_events(stream_events(spark, feed, files_per_batch), limits) \
        .dropDuplicates(["event_id"]).select("event_id", "article_address", "created_at")
    _drain(fresh, root, "sight", _log_to(f"{root}/log"))
    return read_changes(spark, f"{root}/log").drop("seq", "batch")


def run_revisions(spark: SparkSession, feed: str, root: str, limits: Limits = DEFAULTS,
                  files_per_batch: int = FILES_PER_BATCH, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The newest revision of each article, whatever the order of arrival."""
    newest = ev.current_revisions(ev.accepted_events(stream_events(spark, feed, files_per_batch), limits))
    log = ChangeLog(spark, f"{root}/log", ["article_address"], ["current_event_created_at", "current_event_id"])
    _drain(newest, root, "revisions", _keep_in(log, compact_every), "update")
    return log.rows().select("article_address", "current_event_id", "current_event_created_at")


def run_scans(spark: SparkSession, feed: str, root: str, load_policy: Callable[[], object], edges: DataFrame,
              skip_hosts: DataFrame, categories: DataFrame, now: int, limits: Limits = DEFAULTS,
              files_per_batch: int = FILES_PER_BATCH) -> str:
    """Scan new events and refresh the states of the articles they belong to.

    ``load_policy`` runs for every micro-batch, so a new policy generation counts at
    once. An event seen in an earlier batch is not scanned again: the ids seen are the
    stream's keyed state, so a batch costs what it brings, however long the run is.
    Returns ``root``; read the tables with ``scanned`` and ``article_states``.
    """
    states = _states(spark, root)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        policy = load_policy()
        with scratch(spark):
            fresh = stage(batch, "live-events")  # the stream has each id once: the texts need no second shuffle
            tables = sc.scan_articles(fresh, edges, policy.hits, skip_hosts, policy.generation, now, limits)
            current = ev.current_revisions(fresh)
            append_changes(tables.scans, f"{root}/scans", batch_id)
            states.append(st.article_states(current, tables.scans, tables.classifications, categories), batch_id)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            states.compact()

    fresh = ev.accepted_events(stream_events(spark, feed, files_per_batch), limits).dropDuplicates(["event_id"])
    _drain(fresh, root, "scan", on_batch)
    return root


def _states(spark: SparkSession, root: str) -> ChangeLog:
    return ChangeLog(spark, f"{root}/states", ["article_address"], ["event_created_at", "event_id"])


def scanned(spark: SparkSession, root: str) -> DataFrame:
    return read_changes(spark, f"{root}/scans")


def article_states(spark: SparkSession, root: str) -> DataFrame:
    """The state of each article by its newest event; late old revisions never win."""
    return _states(spark, root).rows()


def run_counters(spark: SparkSession, feed: str, root: str, limits: Limits = DEFAULTS,
                 window_s: int = 300, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Received and rejected rows per tumbling window of arrival time; rows without a time have a null window.

    Each micro-batch logs its own counts, and reading adds them up: there is no state, and no row is too late.
    """
    seen = F.col("received_at")
    counted = lambda batch: ev.check_events(batch, limits).groupBy(
        (seen - F.pmod(seen, F.lit(window_s))).alias("window_start"), "relay",
        F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    _drain(stream_events(spark, feed, files_per_batch), root, "counters",
           lambda batch, batch_id: append_changes(counted(batch), f"{root}/log", batch_id))
    return read_changes(spark, f"{root}/log").groupBy("window_start", "relay", "outcome").agg(F.sum("n").alias("n"))


def _request_stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """A landed request log, read where it lies."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _clock(spark: SparkSession, root: str, before: int | None) -> int | None:
    """How far event time was sure to have come when a micro-batch began, in microseconds."""
    row = read_state(spark, f"{root}/clock", before, "us bigint").first()
    return None if row is None else row["us"]


def _advance(spark: SparkSession, root: str, batch_id: int, clock: int | None, newest: int | None, late_s: int) -> int | None:
    reached = [t for t in (clock, None if newest is None else newest - late_s * 1_000_000) if t is not None]
    after = max(reached, default=None)
    write_state(spark.createDataFrame([(after,)] if reached else [], "us bigint"), f"{root}/clock", batch_id)
    return after


_SUMS = "key {key}, window_start bigint, used bigint"


def run_rate_windows(spark: SparkSession, path: str, root: str, limits: Limits = DEFAULTS,
                     late_s: int = 3600, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The rate audit over a landed request log (``path``): key, window_start, used, limited, closed.

    A window closes once a request ``late_s`` after its end was seen in an earlier batch, and
    never changes again. Requests that come too late for their window, or have no time, go
    to ``late_requests`` as they are; so every row of the log is in one of the two. Sums of
    open windows are carried from batch to batch, nothing else.
    """
    log = _request_stream(spark, path, files_per_batch)
    sums = _SUMS.format(key=log.schema["key"].dataType.simpleString())
    length = limits.rate_window_s

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        clock = _clock(spark, root, batch_id)
        with scratch(spark):
            us = F.unix_micros(F.col("ts").cast("timestamp"))
            rows = stage(batch.select(*log.columns).withColumn("__us", us), "live-requests")
            start = F.floor(F.col("__us") / (length * 1_000_000)).cast("long") * length
            over = F.col("__us").isNull() | (F.lit(clock is not None) & ((start + length) * 1_000_000 <= F.lit(clock or 0)))
            append_changes(rows.where(over).drop("__us"), f"{root}/late", batch_id)
            used = rows.where(~over).groupBy("key", start.alias("window_start")).agg(F.sum("cost").cast("long").alias("used"))
            used = read_state(spark, f"{root}/open", batch_id, sums).unionByName(used) \
                .groupBy("key", "window_start").agg(F.sum("used").cast("long").alias("used"))
            used = stage(used, "live-windows")
            clock = _advance(spark, root, batch_id, clock, rows.agg(F.max("__us")).first()[0], late_s)
            done = F.lit(clock is not None) & ((F.col("window_start") + length) * 1_000_000 <= F.lit(clock or 0))
            append_changes(used.where(done), f"{root}/closed", batch_id)
            write_state(used.where(~done), f"{root}/open", batch_id)

    _drain(log, root, "rates", on_batch)
    closed = read_changes(spark, f"{root}/closed").drop("batch").withColumn("closed", F.lit(True))
    still = read_state(spark, f"{root}/open", None, sums).withColumn("closed", F.lit(False))
    return closed.unionByName(still).select(
        "key", "window_start", "used", (F.col("used") > limits.rate_limit).alias("limited"), "closed")


def late_requests(spark: SparkSession, root: str) -> DataFrame:
    """The requests that came after their window had closed."""
    return read_changes(spark, f"{root}/late").drop("batch")


def run_replays(spark: SparkSession, path: str, root: str, limits: Limits = DEFAULTS,
                late_s: int = 0, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """What becomes of each request of a landed log (``path``): id, us (its time), outcome.

    ``replay``: the id was there within the replay window before it; ``fresh``: it was not;
    ``late``: it lies more than ``late_s`` behind what earlier batches had seen, so that
    cannot be told any more; ``invalid``: it has no id or no time. What is carried from batch
    to batch are the sightings that can still matter, so ids expire and the cost of a batch
    does not grow with the run. A batch that is repeated starts from the same sightings.
    """
    log = _request_stream(spark, path, files_per_batch)
    sighting = f"id {log.schema['id'].dataType.simpleString()}, us bigint"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        clock = _clock(spark, root, batch_id)
        with scratch(spark):
            rows = stage(batch.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "live-requests")
            bad = F.col("id").isNull() | F.col("us").isNull()
            late = ~bad & F.lit(clock is not None) & (F.col("us") < F.lit(clock or 0))
            seen = read_state(spark, f"{root}/seen", batch_id, sighting)
            judged = audit.replay_outcomes(rows.where(~bad & ~late), limits, seen)
            others = rows.where(bad | late).withColumn("outcome", F.when(bad, "invalid").otherwise("late"))
            append_changes(judged.unionByName(others), f"{root}/log", batch_id)
            clock = _advance(spark, root, batch_id, clock, rows.where(~bad).agg(F.max("us")).first()[0], late_s)
            since = (clock or 0) - limits.replay_window_s * 1_000_000
            write_state(seen.unionByName(rows.where(~bad & ~late)).where(F.col("us") >= since).distinct(), f"{root}/seen", batch_id)

    _drain(log, root, "replays", on_batch)
    return read_changes(spark, f"{root}/log").select("id", "us", "outcome")
