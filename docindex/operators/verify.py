"""Reconciling the ledger with the upstream inventory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ledger import Ledger, job_rows, retire_roots, without_open_jobs
from .routing import indexable

TOLERANCE_MS = 1000
PRIORITY = 500
#: Rows of a root that a checksum stands for.
RANGE = 200


def diff_ledger(inventory: DataFrame, paths: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """root_id, path, wiki_mtime, local_mtime, class of every path of either side: missing (upstream only), extra (local
    only), stale (times further apart than the tolerance) or same. One join on (root_id, path); a root alone would be skewed."""
    up = inventory.select("root_id", "path", F.col("mtime_ms").alias("wiki_mtime"), F.lit(True).alias("_up"))
    here = paths.select("root_id", "path", F.col("mtime_ms").alias("local_mtime"), F.lit(True).alias("_here"))
    kind = F.when(F.col("_here").isNull(), "missing").when(F.col("_up").isNull(), "extra").when(F.abs(F.col("wiki_mtime") - F.col("local_mtime")) > tolerance_ms, "stale").otherwise("same")
    return up.join(here, ["root_id", "path"], "full_outer").select("root_id", "path", "wiki_mtime", "local_mtime", kind.alias("class"))


def checksums(rows: DataFrame, ranges: int) -> DataFrame:
    """root_id, range, n, total of rows (root_id, path, mtime_ms): how many there are in each range of hashes, and an order-free sum
    of their own hashes. Partial sums in every task; what is shuffled is a row a range."""
    at = F.pmod(F.xxhash64("root_id", "path"), F.lit(ranges)).cast("int")
    own = lambda seed: F.sum(F.xxhash64(F.lit(seed), "root_id", "path", "mtime_ms").cast("decimal(20,0)"))
    return rows.groupBy("root_id", at.alias("range")).agg(F.count("*").alias("n"), own(1).alias("total"), own(2).alias("total2"))


def unlike_ranges(inventory: DataFrame, paths: DataFrame, ranges: int) -> DataFrame:
    """root_id, range of the ranges in which both sides' checksums differ; two sums of 64-bit hashes tell them apart."""
    names = ["n", "total", "total2"]
    up = checksums(inventory, ranges).select("root_id", "range", F.struct(*names).alias("_up"))
    here = checksums(paths, ranges).select("root_id", "range", F.struct(*names).alias("_here"))
    return up.join(here, ["root_id", "range"], "full_outer").filter(~F.col("_up").eqNullSafe(F.col("_here"))).select("root_id", "range")


def diff_unlike(inventory: DataFrame, paths: DataFrame, tolerance_ms: int = TOLERANCE_MS, ranges: int | None = None) -> DataFrame:
    """diff_ledger() without the rows of ranges that are the same on both sides: checksums first, then one join of what is left.
    ranges: hash ranges of a root; None: about RANGE rows of the inventory's largest root in each."""
    if ranges is None:
        largest = inventory.groupBy("root_id").count().agg(F.max("count")).head()[0] or 0
        ranges = max(1, -(-largest // RANGE))
    differ = stored(unlike_ranges(inventory, paths, ranges))
    if differ.isEmpty():
        return diff_ledger(inventory.limit(0), paths.limit(0), tolerance_ms)
    left = lambda rows: rows.withColumn("range", F.pmod(F.xxhash64("root_id", "path"), F.lit(ranges)).cast("int")).join(differ, ["root_id", "range"], "left_semi").drop("range")
    return diff_ledger(left(inventory), left(paths), tolerance_ms)


def plan_roots(paths: DataFrame, roots: DataFrame, requested: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """O1: (roots to retire, requested roots that upstream doesn't know). Only a run over the whole ledger retires."""
    known = roots.select(F.col("id").alias("root_id")).distinct()
    spark = paths.sparkSession
    nothing = spark.createDataFrame([], "root_id string")
    if requested is None:
        return paths.select("root_id").distinct().join(known, "root_id", "left_anti"), nothing
    asked = spark.createDataFrame([(r,) for r in requested], "root_id string") if requested else nothing
    return nothing, asked.join(known, "root_id", "left_anti")


def verify_report(diff: DataFrame, roots: DataFrame, paths: DataFrame, served: DataFrame | None = None) -> DataFrame:
    """root_id, status, wiki_files, local_files, missing, stale, extra, extra_skipped of every upstream root.

    roots: id, enabled. served: roots whose inventory upstream gave (None: all). Disabled and not-found roots have only
    local_files; of a root with local files but no upstream ones, the extra ones are told as skipped."""
    up = diff.filter("class <> 'extra'").select("root_id")
    return report_of(diff, up, roots, paths, served)


def report_of(diff: DataFrame, inventory: DataFrame, roots: DataFrame, paths: DataFrame, served: DataFrame | None = None) -> DataFrame:
    """verify_report() of a diff that may lack rows that are the same: what upstream has is counted in its inventory (root_id, ...)."""
    of = lambda c: F.count_if(F.col("class") == c).alias(c)
    counts = diff.groupBy("root_id").agg(of("missing"), of("stale"), of("extra"))
    counts = inventory.groupBy("root_id").agg(F.count("*").alias("wiki_files")).join(counts, "root_id", "full_outer")
    local = paths.groupBy("root_id").agg(F.count("*").alias("local_files"))
    rows = roots.select(F.col("id").alias("root_id"), "enabled").join(counts, "root_id", "left").join(local, "root_id", "left")
    if served is not None:
        rows = rows.join(served.select("root_id").distinct().withColumn("_served", F.lit(True)), "root_id", "left")
    else:
        rows = rows.withColumn("_served", F.lit(True))
    rows = rows.fillna(0, ["wiki_files", "missing", "stale", "extra", "local_files"])
    status = F.when(~F.col("enabled"), "disabled").when(F.col("_served").isNull(), "not_found").otherwise("verified")
    rows = rows.withColumn("status", status)
    told = lambda c: F.when(F.col("status") == "verified", F.col(c)).otherwise(0)
    skipped = F.when((F.col("status") == "verified") & (F.col("wiki_files") == 0) & (F.col("local_files") > 0), F.col("extra")).otherwise(0)
    return rows.select("root_id", "status", told("wiki_files").alias("wiki_files"), "local_files", told("missing").alias("missing"), told("stale").alias("stale"), told("extra").alias("extra"), skipped.alias("extra_skipped"))


@dataclass
class Verified:
    """What a verify run leaves: the ledger after it, its new jobs, its report, retired and unknown roots, and an error or None."""

    ledger: Ledger
    jobs: DataFrame | None = None
    report: DataFrame | None = None
    retired: DataFrame | None = None
    unknown: DataFrame | None = None
    gated: DataFrame | None = None
    error: str | None = None


def verify(ledger: Ledger, inventory: DataFrame, roots: DataFrame, exts: DataFrame, rules: DataFrame, now_ms: int, requested: list[str] | None = None, served: DataFrame | None = None) -> Verified:
    """Retires unknown roots, compares the others, and queues or deletes what differs.

    Guards: without any upstream root nothing is touched; disabled and unserved roots are only reported; a root that upstream
    shows empty keeps its local files; if no root was served, the run is an error."""
    if roots.isEmpty():
        return Verified(ledger, error="upstream returned no roots")
    retire, unknown = plan_roots(ledger.paths, roots, requested)
    retire = stored(retire)
    targets = roots if requested is None else roots.filter(F.col("id").isin(requested))
    own = targets.select(F.col("id").alias("root_id"))
    local, upstream = ledger.paths.join(own, "root_id", "left_semi"), inventory.join(own, "root_id", "left_semi")
    # of ranges that are alike no row is joined; what the report, the guards and all that is applied read is written once
    diff = stored(diff_unlike(upstream, local))
    report = stored(report_of(diff.filter("class <> 'same'"), upstream, targets, local, served))
    compared = report.filter("status = 'verified'").select("root_id", (F.col("extra_skipped") == 0).alias("_deletes"))
    diff = diff.join(F.broadcast(compared), "root_id")  # a row a root of the inventory
    gone = diff.filter("class = 'extra' and _deletes").select("root_id", "path")
    # retired roots and extra paths are one set of paths that go: records and chunks are rewired once
    after, retired = retire_roots(ledger, retire, now_ms, gone)
    missing = indexable(diff.filter("class = 'missing'").select("root_id", "path"), exts, rules)
    gated = missing.filter("not indexable").groupBy("root_id").agg(F.count("*").alias("missing_gated"))
    to_index = without_open_jobs(missing.filter("indexable"), after.jobs)
    to_renew = without_open_jobs(diff.filter("class = 'stale'"), after.jobs)
    jobs = job_rows(to_index, "index", PRIORITY).unionByName(job_rows(to_renew, "reindex", PRIORITY))
    error = None
    if served is not None and not report.filter("status <> 'disabled'").isEmpty() and report.filter("status = 'verified'").isEmpty():
        error = "upstream files endpoint unavailable"
    return Verified(after, jobs, report, retired, unknown, gated, error)
