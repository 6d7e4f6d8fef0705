"""Ledger maintenance (M1-M11) as set-based jobs over records, paths, chunks and jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import sha256_hex
from ..functions.paths import path_ext
from ..functions.scalars import parse_modalities
from ..session import stored
from .reports import earliest_mtime, filter_files, find_pollution, open_jobs, root_ids
from .routing import indexable
from .upserts import delete_keys, set_chunk_roots

GRACE_MS = 24 * 3_600_000
#: Priorities of the jobs that maintenance queues; bounds of a reindex request.
DRIFT, REINDEX, RESCAN = 2000, 1000, 500
BY_IDS, BY_FILTER = 500, 10_000


@dataclass
class Ledger:
    """One snapshot of the tables that maintenance changes."""

    records: DataFrame
    paths: DataFrame
    chunks: DataFrame
    jobs: DataFrame | None = None


def job_rows(paths: DataFrame, op: str, priority: int) -> DataFrame:
    return paths.select("root_id", "path", F.lit(op).alias("op"), F.lit(priority).alias("priority"))


def without_open_jobs(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows whose (root_id, path) has no open job."""
    return rows.join(open_jobs(jobs).select("root_id", "path").distinct(), ["root_id", "path"], "left_anti")


def identified(files: DataFrame) -> DataFrame:
    """files (content) with sha256_full and file_id; content itself needs no shuffle."""
    return files.withColumn("sha256_full", sha256_hex(F.col("content"))).withColumn("file_id", F.substring("sha256_full", 1, 32))


def dedup_files(batch: DataFrame) -> DataFrame:
    """M2: one row per file_id with its first path and all root_ids. Only hashes and paths are shuffled."""
    first = F.min(F.struct("path", "root_id", "size", "mtime_ms"))
    return batch.groupBy("file_id").agg(first.alias("f"), F.sort_array(F.collect_set("root_id")).alias("root_ids"), F.count("*").alias("n_paths")).select("file_id", "f.path", "f.root_id", "f.size", "f.mtime_ms", "root_ids", "n_paths")


def resolve_identity(batch: DataFrame, records: DataFrame, paths: DataFrame, version: str, models: dict[str, str]) -> DataFrame:
    """M1: what each (root_id, path) of a batch calls for. batch: root_id, path, sha256_full, file_id, priority, id; one row a path.

    action: FULL_INDEX for the first path of a new or outdated file (by priority, id), REVIVE for that of a tombstoned file that
    is up to date, APPEND_ROOT_ONLY for all others. old_file_id: the file that the path had before; orphaned: no path is left
    to it after the batch; root_lost: it has none left in this root (only told where it isn't orphaned)."""
    p = paths.select("root_id", "path", F.col("file_id").alias("was"))
    rows = batch.join(p, ["root_id", "path"], "left").withColumn("old_file_id", F.when(F.col("was") != F.col("file_id"), F.col("was"))).drop("was")
    after = paths.join(batch.select("root_id", "path"), ["root_id", "path"], "left_anti").select("root_id", "file_id").unionByName(batch.select("root_id", "file_id"))
    touched = rows.filter("old_file_id is not null").select(F.col("old_file_id").alias("file_id")).distinct()
    left = after.join(touched, "file_id", "left_semi").groupBy(F.col("file_id").alias("old_file_id")).agg(F.collect_set("root_id").alias("_left"))
    rows = rows.join(left, "old_file_id", "left")
    changed = F.col("old_file_id").isNotNull()
    rows = rows.withColumn("orphaned", changed & F.col("_left").isNull()).withColumn("root_lost", changed & F.col("_left").isNotNull() & ~F.coalesce(F.array_contains("_left", F.col("root_id")), F.lit(False)))
    done = parse_modalities(F.col("modalities_done"))
    current = F.col("parser_version") == version
    for name, model in models.items():
        current = current & done[name].eqNullSafe(model)
    known = records.select("file_id", F.lit(True).alias("_known"), F.coalesce(current, F.lit(False)).alias("_current"), F.col("tombstoned_at").isNotNull().alias("_dead"))
    first = batch.groupBy("file_id").agg(F.min(F.struct("priority", "id")).alias("_first"))
    rows = rows.join(known, "file_id", "left").join(first, "file_id")
    leads = F.struct("priority", "id") == F.col("_first")
    fresh = F.coalesce(F.col("_known") & F.col("_current"), F.lit(False))
    action = F.when(~leads, "APPEND_ROOT_ONLY").when(~fresh, "FULL_INDEX").when(F.col("_dead"), "REVIVE").otherwise("APPEND_ROOT_ONLY")
    return rows.withColumn("action", action).select("root_id", "path", "file_id", "action", "old_file_id", "orphaned", "root_lost")


def _after_paths(ledger: Ledger, left: DataFrame, touched: DataFrame, now_ms: int) -> Ledger:
    """The ledger with `left` as paths: touched files without a path are tombstoned, the others get the roots they have left.

    The roots left are a table of their own, one row a touched file: records, chunks and counts all read it."""
    touched = touched.select("file_id").distinct()
    roots = touched.join(root_ids(left.join(touched, "file_id", "left_semi")), "file_id", "left")
    roots = stored(roots.select("file_id", F.coalesce("root_ids", F.array().cast("array<string>")).alias("new_roots"), F.lit(now_ms).cast("long").alias("at")))
    dead = roots.filter(F.size("new_roots") == 0).select("file_id", F.lit(True).alias("_gone"))
    records = ledger.records.join(dead, "file_id", "left").withColumn("tombstoned_at", F.when(F.col("_gone"), F.lit(now_ms).cast("long")).otherwise(F.col("tombstoned_at"))).select(ledger.records.columns)
    return Ledger(records, left, set_chunk_roots(ledger.chunks, roots), ledger.jobs)


def delete_paths(ledger: Ledger, keys: DataFrame, now_ms: int) -> Ledger:
    """M3: paths go; a file without any is tombstoned with its chunks, others lose roots. Unknown paths change nothing."""
    gone = ledger.paths.join(keys.select("root_id", "path").distinct(), ["root_id", "path"], "left_semi")
    left = ledger.paths.join(keys.select("root_id", "path").distinct(), ["root_id", "path"], "left_anti")
    return _after_paths(ledger, left, gone, now_ms)


def retire_roots(ledger: Ledger, roots: DataFrame, now_ms: int, more: DataFrame | None = None) -> tuple[Ledger, DataFrame]:
    """M4: roots (root_id) go with their paths and open jobs (but retire_root itself). Also: root_id, files_seen, tombstoned,
    rehomed, jobs_dropped, as if the roots went one after the other in the order of their ids. more: paths (root_id, path) of other
    roots that go after them in the same pass (M3); the counts are those of the roots alone."""
    gone_roots = roots.select("root_id").distinct()
    gone = ledger.paths.join(gone_roots, "root_id", "left_semi")
    left = ledger.paths.join(gone_roots, "root_id", "left_anti")
    if more is None:
        out = _after_paths(ledger, left, gone, now_ms)
    else:
        keys = stored(more.select("root_id", "path").distinct())
        both = gone.unionByName(ledger.paths.join(keys, ["root_id", "path"], "left_semi"))
        out = _after_paths(ledger, stored(left.join(keys, ["root_id", "path"], "left_anti")), both, now_ms)
    dropped = None
    if ledger.jobs is not None:
        dropped = open_jobs(ledger.jobs).filter("op <> 'retire_root'").join(gone_roots, "root_id", "left_semi")
        out.jobs = ledger.jobs.join(dropped.select("id"), "id", "left_anti")
    kept = left.select("file_id").distinct().withColumn("_kept", F.lit(True))
    per = gone.select("root_id", "file_id").distinct().join(kept, "file_id", "left")
    last = per.groupBy("file_id").agg(F.max("root_id").alias("_last"))
    per = per.join(last, "file_id").withColumn("dies", F.col("_kept").isNull() & (F.col("root_id") == F.col("_last")))
    counts = per.groupBy("root_id").agg(F.count("*").alias("files_seen"), F.count_if("dies").alias("tombstoned"), F.count_if(~F.col("dies")).alias("rehomed"))
    jobs = dropped.groupBy("root_id").agg(F.count("*").alias("jobs_dropped")) if dropped is not None else gone_roots.select("root_id", F.lit(0).alias("jobs_dropped"))
    zero = {c: 0 for c in ("files_seen", "tombstoned", "rehomed", "jobs_dropped")}
    return out, gone_roots.join(counts, "root_id", "left").join(jobs, "root_id", "left").fillna(zero).select("root_id", *zero)


def sweep_tombstones(ledger: Ledger, now_ms: int, grace_ms: int = GRACE_MS) -> Ledger:
    """M5: files tombstoned before now - grace go from all tables."""
    old = ledger.records.filter(F.col("tombstoned_at") < now_ms - grace_ms).select("file_id")
    return Ledger(*(delete_keys(t, old, ["file_id"]) for t in (ledger.records, ledger.paths, ledger.chunks)), ledger.jobs)


def sweep_allowlist(ledger: Ledger, exts: DataFrame, rules: DataFrame, now_ms: int) -> Ledger:
    """M6: alive files of which no path is indexable (A8) are tombstoned; files without paths stay."""
    fine = indexable(ledger.paths, exts, rules).groupBy("file_id").agg(F.bool_or("indexable").alias("_fine"))
    dead = ledger.records.filter("tombstoned_at is null").join(fine.filter("not _fine"), "file_id").select("file_id")
    marked = dead.select("file_id", F.lit(True).alias("_gone"))
    records = ledger.records.join(marked, "file_id", "left").withColumn("tombstoned_at", F.when(F.col("_gone"), F.lit(now_ms).cast("long")).otherwise(F.col("tombstoned_at"))).select(ledger.records.columns)
    updates = dead.select("file_id", F.array().cast("array<string>").alias("new_roots"), F.lit(now_ms).cast("long").alias("at"))
    return Ledger(records, ledger.paths, set_chunk_roots(ledger.chunks, updates), ledger.jobs)


def cleanup_pollution(ledger: Ledger, exts: DataFrame) -> Ledger:
    """M7: polluted files (A9) go from all tables, and done jobs whose extension is there but not allowed."""
    bad = find_pollution(ledger.records, ledger.paths, exts).select("file_id")
    allowed = exts.filter("enabled").select(F.col("ext").alias("_ext")).distinct()
    jobs = ledger.jobs.withColumn("_e", path_ext(F.col("path"))).join(allowed, F.col("_e") == F.col("_ext"), "left")
    stale = F.col("done_at").isNotNull() & (F.col("_e") != "") & F.col("_ext").isNull()
    return Ledger(*(delete_keys(t, bad, ["file_id"]) for t in (ledger.records, ledger.paths, ledger.chunks)), jobs.filter(~stale).select(ledger.jobs.columns))


def backfill_mtime(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """M8: chunks without mtime get the earliest of their file's paths; those without a path stay."""
    m = earliest_mtime(paths).withColumnRenamed("mtime_ms", "_m")
    lacking = F.coalesce("mtime_ms", F.lit(0)) == 0
    return chunks.join(m, "file_id", "left").withColumn("mtime_ms", F.when(lacking, F.coalesce("_m", "mtime_ms")).otherwise(F.col("mtime_ms"))).select(chunks.columns)


def drift_jobs(records: DataFrame, paths: DataFrame, jobs: DataFrame, exts: DataFrame, rules: DataFrame, version: str) -> DataFrame:
    """M9: a reindex job for every indexable path without open job of an alive file from another parser version."""
    old = records.filter((F.col("parser_version") != version) & F.col("tombstoned_at").isNull()).select("file_id")
    rows = indexable(paths.join(old, "file_id", "left_semi"), exts, rules).filter("indexable")
    return job_rows(without_open_jobs(rows, jobs), "reindex", DRIFT)


def rescan_root(paths: DataFrame, exts: DataFrame, rules: DataFrame, root_id: str) -> DataFrame:
    """A reindex job for every indexable path of a root."""
    return job_rows(indexable(paths.filter(F.col("root_id") == root_id), exts, rules).filter("indexable"), "reindex", RESCAN)


def reindex(records: DataFrame, paths: DataFrame, now_ms: int, file_ids: list[str] | None = None, filter: dict | None = None, most: int | None = BY_FILTER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records after, jobs, skipped file_id and reason). Exactly one of file_ids (up to BY_IDS) and filter (up to `most`
    files, else an error; None for batches, where nothing is collected) is given; an id that comes again is already tombstoned by then."""
    if (file_ids is None) == (filter is None):
        raise ValueError("exactly one of file_ids and filter")
    spark = records.sparkSession
    if file_ids is not None:
        if not 1 <= len(file_ids) <= BY_IDS:
            raise ValueError(f"1..{BY_IDS} file_ids")
        asked = spark.createDataFrame(list(enumerate(file_ids)), "ordinal long, file_id string")
    else:
        fitting = filter_files(records, paths, **filter).select("file_id")
        if most is not None and fitting.limit(most + 1).count() > most:
            raise ValueError(f"the filter fits more than {most} files")
        asked = fitting.withColumn("ordinal", F.lit(0).cast("long"))
    state = records.select("file_id", F.lit(True).alias("_known"), F.col("tombstoned_at").isNotNull().alias("_dead"))
    first = asked.groupBy("file_id").agg(F.min("ordinal").alias("_first"))
    has = paths.select("file_id").distinct().withColumn("_has", F.lit(True))
    rows = asked.join(first, "file_id").join(state, "file_id", "left").join(has, "file_id", "left")
    again = F.col("ordinal") > F.col("_first")
    reason = F.when(F.col("_known").isNull(), "not_found").when(F.col("_dead") | (again & F.col("_has")), "already_tombstoned").when(F.col("_has").isNull(), "no_paths_orphan")
    rows = rows.withColumn("reason", reason)
    taken = rows.filter("reason is null").select("file_id")
    jobs = job_rows(paths.join(taken, "file_id", "left_semi"), "reindex", REINDEX)
    marked = taken.select("file_id", F.lit(True).alias("_hit"))
    after = records.join(marked, "file_id", "left").withColumn("tombstoned_at", F.when(F.col("_hit"), F.lit(now_ms).cast("long")).otherwise(F.col("tombstoned_at"))).select(records.columns)
    return after, jobs, rows.filter("reason is not null").select("ordinal", "file_id", "reason")
