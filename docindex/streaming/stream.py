"""Structured Streaming (T1-T4): the batch operators in continuous form. The checkpoint stands for the feed's cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import Ledger
from ..operators.routing import events_to_jobs
from . import store

WINDOW, SLIDE, LATE = "10 minutes", "1 minute", "10 minutes"


def stream_events_to_jobs(events: DataFrame, exts: DataFrame, rules: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Events become jobs below out. Each batch writes to a folder of its own number, so a batch that is run again after a
    failure replaces what it had written: at least once becomes exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        events_to_jobs(batch, exts, rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cursor_gap_transition(cursors: DataFrame, horizons: DataFrame, gaps: DataFrame, now_ms: int) -> DataFrame:
    """The gaps after a poll: feed, detected_at, since_ms, last_seq, archive_cutoff_ms, triggered, fire.

    cursors: feed, since_ms, last_seq. horizons: feed, archive_cutoff_ms, has_archived. A cursor that was never set is no gap.
    A new gap is recorded with fire; one whose verify hasn't started yet fires again; one that the cursor has left goes; one of a
    feed whose horizon isn't told stays as it is. set_triggered() notes what started."""
    g = gaps.select("feed", *[F.col(c).alias(f"_{c}") for c in ("detected_at", "since_ms", "last_seq", "archive_cutoff_ms", "triggered")], F.lit(True).alias("_gap"))
    rows = cursors.join(horizons, "feed", "full_outer").join(g, "feed", "full_outer")
    told = F.coalesce(F.col("has_archived"), F.lit(False)) & F.col("archive_cutoff_ms").isNotNull()
    behind = F.coalesce((F.col("since_ms") > 0) & (F.col("since_ms") < F.col("archive_cutoff_ms")), F.lit(False))
    rows = rows.withColumn("_told", told).withColumn("_behind", behind).filter(F.when(F.col("_told"), F.col("_behind")).otherwise(F.coalesce("_gap", F.lit(False))))
    kept = lambda c, new: F.when(F.col("_gap"), F.col(f"_{c}")).otherwise(new)
    return rows.select(
        "feed", kept("detected_at", F.lit(now_ms).cast("long")).alias("detected_at"), kept("since_ms", F.col("since_ms")).alias("since_ms"), kept("last_seq", F.col("last_seq")).alias("last_seq"),
        kept("archive_cutoff_ms", F.col("archive_cutoff_ms")).alias("archive_cutoff_ms"), kept("triggered", F.lit(False)).alias("triggered"), (F.col("_told") & ~F.coalesce("_triggered", F.lit(False))).alias("fire"),
    )


def set_triggered(gaps: DataFrame, started: DataFrame) -> DataFrame:
    """gaps after the verify of some feeds (feed) has started; refused or failed ones fire at the next poll."""
    s = started.select("feed").distinct().withColumn("_started", F.lit(True))
    return gaps.join(s, "feed", "left").withColumn("triggered", F.col("triggered") | F.coalesce("_started", F.lit(False))).drop("_started", "fire")


#: What a feed's state holds, and what a transition tells.
GAP = "detected_at long, since_ms long, last_seq long, archive_cutoff_ms long, triggered boolean"
TRANSITION = f"feed string, at long, step string, {GAP}, fire boolean"
Gap = tuple[int, int, int, int, bool]


def gap_step(gap: Gap | None, poll: dict) -> tuple[Gap | None, str | None, bool]:
    """(gap, step, fire) after one row of a feed, as cursor_gap_transition() has it: a poll, or the word that a verify has started."""
    if poll["started"]:
        return ((*gap[:4], True), "started", False) if gap and not gap[4] else (gap, None, False)
    cutoff, since = poll["archive_cutoff_ms"], poll["since_ms"]
    if cutoff is None or not poll["has_archived"]:
        return gap, None, False
    if not (since is not None and 0 < since < cutoff):
        return None, "cleared" if gap else None, False
    if gap is None:
        return (poll["at"], since, poll["last_seq"], cutoff, False), "recorded", True
    return (gap, None, False) if gap[4] else (gap, "retried", True)


def stream_gaps(polls: DataFrame) -> DataFrame:
    """T2 as a stream: the transitions of each feed's gap, whose state stays in the stream between polls.

    polls: feed, at, since_ms, last_seq, archive_cutoff_ms, has_archived, started (true: no poll, but the word that the verify of the
    recorded gap has started). Rows of a feed count by (at, started), in one micro-batch and from one to the next. steps: recorded,
    retried (no verify has started yet), started, cleared. What a task holds is one micro-batch's rows of one feed."""

    def moved(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gap, out = tuple(state.get) if state.exists else None, []
        polls = pd.concat(list(rows)).astype(object)
        for poll in polls.where(polls.notna(), None).sort_values(["at", "started"], kind="stable").to_dict("records"):
            was = gap
            gap, step, fire = gap_step(gap, poll)
            if step:
                out.append((key[0], poll["at"], step, *(gap or was), fire))
        if gap is not None:
            state.update(gap)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["feed", "at", "step", "detected_at", "since_ms", "last_seq", "archive_cutoff_ms", "triggered", "fire"])

    rows = polls.select("feed", "at", "since_ms", "last_seq", "archive_cutoff_ms", "has_archived", F.coalesce("started", F.lit(False)).alias("started"))
    return rows.groupBy("feed").applyInPandasWithState(moved, TRANSITION, GAP, "append", GroupStateTimeout.NoTimeout)


def stream_throughput(jobs: DataFrame) -> DataFrame:
    """Completions per ten-minute window, from done_at (ms); late completions count for LATE."""
    done = jobs.filter("done_at is not null").select(F.timestamp_millis("done_at").alias("done_ts"))
    by = done.withWatermark("done_ts", LATE).groupBy(F.window("done_ts", WINDOW, SLIDE).alias("w")).count()
    return by.select(F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), F.col("count").alias("completed"), F.round(F.col("count") / 10, 2).alias("rate_per_min"))


def latest_per_path(jobs: DataFrame) -> DataFrame:
    """T4: the last job of each (root_id, path) of a batch; a retired root drops its other jobs, whatever their order."""
    retired = jobs.filter("op = 'retire_root'").select("root_id").distinct().withColumn("_retired", F.lit(True))
    kept = jobs.join(retired, "root_id", "left").filter("op = 'retire_root' or _retired is null")
    own = F.when(F.col("op") == "retire_root", "").otherwise(F.col("path"))
    return kept.groupBy("root_id", own.alias("path")).agg(F.max_by(F.struct("op", "priority", "detected_at", "seq"), F.struct("detected_at", "seq")).alias("j")).select("root_id", "path", "j.*")


def stream_apply(jobs: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """T4: each micro-batch of jobs, compacted, goes to apply(batch, number), which writes new snapshots under that number."""

    def one(batch: DataFrame, number: int) -> None:
        apply(latest_per_path(batch), number)

    return jobs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ledger(jobs: DataFrame, start: Ledger, fetch: Callable[[DataFrame], DataFrame], change: Callable[[Ledger, DataFrame, DataFrame], Ledger], folder: str, checkpoint: str, buckets: int = store.BUCKETS) -> StreamingQuery:
    """T4: the ledger follows the stream of jobs, from `start` on. Each micro-batch, compacted, reads and writes the buckets of the
    files and paths that it touches (store.apply_batch tells what fetch and change do) and is committed by a mark under its number;
    one that is run again after a failure starts from the state before it. store.read() gives the ledger as it was committed last."""
    spark = start.records.sparkSession  # not the stream's own: the changes are plans that adapt to what they meet
    store.create(start, folder, buckets)

    def one(batch: DataFrame, number: int) -> None:
        path = f"{folder}/jobs-{number:012d}"
        latest_per_path(batch).write.mode("overwrite").parquet(path)
        store.apply_batch(spark, folder, number, spark.read.parquet(path), fetch, change)
        store.forget(spark, folder)

    return jobs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
