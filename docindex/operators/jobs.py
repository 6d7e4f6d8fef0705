"""The job table as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_gated, normalize_path
from ..functions.scalars import parse_modalities

LEASE_S, MAX_ATTEMPTS = 300, 5
VISUAL = 200
#: Jobs of a batch or listing at most.
BATCH = 10_000


def runnable(jobs: DataFrame, now_ms: int) -> DataFrame:
    return jobs.filter(F.col("done_at").isNull() & (F.col("locked_until").isNull() | (F.col("locked_until") < now_ms)))


def next_batch(jobs: DataFrame, now_ms: int, n: int, lease_s: int = LEASE_S) -> DataFrame:
    """The n runnable jobs of least (priority, id), leased: a TakeOrdered, no global sort."""
    if not 1 <= n <= BATCH:
        raise ValueError(f"n 1..{BATCH}")
    batch = runnable(jobs, now_ms).orderBy("priority", "id").limit(n)
    return batch.withColumns({"locked_until": F.lit(now_ms + lease_s * 1000).cast("long"), "picked_at": F.coalesce("picked_at", F.lit(now_ms).cast("long")), "attempts": F.col("attempts") + 1})


def with_leases(jobs: DataFrame, batch: DataFrame) -> DataFrame:
    """The job table after a batch was leased."""
    return jobs.join(batch.select("id"), "id", "left_anti").unionByName(batch.select(jobs.columns))


def split_gated(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs to run, jobs that the path gate skips although they were queued)."""
    gated = F.col("op").isin("index", "reindex") & is_gated(F.col("path"))
    return batch.filter(~gated), batch.filter(gated)


def list_jobs(jobs: DataFrame, status: str, limit: int) -> DataFrame:
    """The newest jobs that are pending, running (leased, expired or not) or failed."""
    open_, locked = F.col("done_at").isNull(), F.col("locked_until").isNotNull()
    by = {"pending": open_ & ~locked, "running": open_ & locked, "failed": ~open_ & F.col("last_error").isNotNull()}
    if status not in by or not 1 <= limit <= BATCH:
        raise ValueError("status pending, running or failed; limit 1..10000")
    return jobs.filter(by[status]).orderBy(F.desc("id")).limit(limit)


def apply_errors(records: DataFrame, paths: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Records with last_error of the latest outcome (root_id, path, at, error; null: success) at any of their paths."""
    last = outcomes.join(paths.select("root_id", "path", "file_id"), ["root_id", "path"]).groupBy("file_id").agg(F.max(F.struct("at", "root_id", "path", "error")).alias("_o"))
    out = records.join(last, "file_id", "left")
    return out.withColumn("last_error", F.when(F.col("_o").isNotNull(), F.col("_o.error")).otherwise(F.col("last_error"))).select(records.columns)


def receipts(jobs: DataFrame, paths: DataFrame, records: DataFrame) -> DataFrame:
    """Path, status, modalities of done jobs (skipped: boolean) that a receipt is due for."""
    due = jobs.filter(~F.startswith("op", F.lit("visual")) & (F.col("op") != "retire_root") & (F.col("last_error").isNotNull() | ~F.col("skipped")))
    status = F.when(F.col("last_error").isNotNull(), "failed").when(F.col("op") == "delete", "deleted").otherwise("indexed")
    files = paths.select("root_id", "path", "file_id").join(records.select("file_id", "modalities_done"), "file_id")
    out = due.join(files, ["root_id", "path"], "left").withColumn("status", status)
    modalities = F.when((F.col("status") == "indexed") & F.col("file_id").isNotNull(), parse_modalities(F.col("modalities_done")))
    return out.select("id", "path", "status", modalities.alias("modalities"), F.col("last_error").alias("error"))


def _with_error(jobs: DataFrame) -> Column:
    return F.col("done_at").isNotNull() & F.col("last_error").isNotNull()


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now_ms: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Outcomes (id, error; null: success). A failure counts once more, and ends the job at max_attempts. Of several outcomes of
    a job in one batch a success counts before failures, and of these the last by its text, once."""
    one = outcomes.groupBy("id").agg(F.when(F.count_if(F.col("error").isNull()) == 0, F.max("error")).alias("_error"), F.lit(True).alias("_told"))
    out = jobs.join(one, "id", "left")
    failed = F.col("_told") & F.col("_error").isNotNull()
    ends = F.col("_told") & (F.col("_error").isNull() | (F.col("attempts") + 1 >= max_attempts))
    return out.withColumns({
        "done_at": F.when(ends, F.lit(now_ms).cast("long")).otherwise(F.col("done_at")),
        "locked_until": F.when(F.col("_told"), None).otherwise(F.col("locked_until")),
        "last_error": F.when(failed, F.col("_error")).otherwise(F.col("last_error")),
        "attempts": F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
    }).select(jobs.columns)


def retry_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs are open again, as if new."""
    again = _with_error(jobs)
    null = F.lit(None).cast("long")
    return jobs.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in {"done_at": null, "attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "locked_until": null, "picked_at": null}.items()})


def clear_failed(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~_with_error(jobs))


def delete_jobs(jobs: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(jobs without the ids, id and reason of those that stay: not_found, running)."""
    state = ids.select("id").distinct().join(jobs.select("id", "locked_until", F.lit(True).alias("_known")), "id", "left")
    running = F.coalesce(F.col("locked_until") > now_ms, F.lit(False))
    gone = state.filter(F.col("_known") & ~running)
    refused = state.filter(F.col("_known").isNull() | running).select("id", F.when(F.col("_known").isNull(), "not_found").otherwise("running").alias("reason"))
    return jobs.join(gone.select("id"), "id", "left_anti"), refused


def visual_jobs(assets: DataFrame, allowed_dirs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(jobs, refused assets with reason). assets: source, asset_id, image_path, mime, meta (JSON text)."""
    path = normalize_path(F.col("image_path"))
    below = F.lit(False)
    for d in allowed_dirs:
        below = below | (F.col("_path") == d.rstrip("/")) | F.startswith("_path", F.lit(d.rstrip("/") + "/"))
    rows = assets.withColumn("_path", path)
    reason = F.when(~F.coalesce(F.col("source").rlike(r"\A[a-z0-9_-]+\z"), F.lit(False)), "bad source").when(~F.coalesce(F.char_length(F.col("asset_id").cast("string")).between(1, 128), F.lit(False)), "bad asset_id").when(~F.coalesce(below, F.lit(False)), "outside allowed directories")
    rows = rows.withColumn("reason", reason)
    payload = F.to_json(F.struct(F.col("asset_id").cast("string").alias("asset_id"), "mime", "meta"))
    jobs = rows.filter("reason is null").select(F.col("source").alias("root_id"), F.col("_path").alias("path"), F.lit("visual_ingest").alias("op"), payload.alias("sub_modality"), F.lit(VISUAL).alias("priority"))
    return jobs, rows.filter("reason is not null").select("source", "asset_id", "reason")
