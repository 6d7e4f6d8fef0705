"""Listings, counts and reports over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import dirname, path_ext
from ..session import stored

#: Rows of a listing's page at most; counts of open jobs are told up to this.
PAGE, COUNT_CAP = 500, 10_000
#: Trailing time over which throughput is measured.
RATE_MS = 600_000


def root_ids(paths: DataFrame) -> DataFrame:
    """A1: file_id, root_ids (sorted, distinct)."""
    return paths.groupBy("file_id").agg(F.sort_array(F.collect_set("root_id")).alias("root_ids"))


def files_with_paths(records: DataFrame, paths: DataFrame) -> DataFrame:
    """Records with `paths`, sorted; empty for files without one."""
    nested = paths.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("root_id", "path", "mtime_ms"))).alias("paths"))
    empty = F.array().cast(nested.schema["paths"].dataType)
    return records.join(nested, "file_id", "left").withColumn("paths", F.coalesce("paths", empty))


def lookup_files(ids: DataFrame, records: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found records with paths, missing ids with their place). ids: ordinal, file_id."""
    found = files_with_paths(records.join(ids.select("file_id").distinct(), "file_id", "left_semi"), paths.join(ids.select("file_id").distinct(), "file_id", "left_semi"))
    return found, ids.join(records, "file_id", "left_anti").select("ordinal", "file_id")


def filter_files(records: DataFrame, paths: DataFrame, tombstoned: str = "alive", has_error: bool | None = None, mime_prefix: str | None = None, root_id: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """Records by state, error and mime; root and path prefix hold for one and the same path."""
    out = records
    if tombstoned != "all":
        out = out.filter(F.col("tombstoned_at").isNull() if tombstoned == "alive" else F.col("tombstoned_at").isNotNull())
    if has_error is not None:
        out = out.filter(F.col("last_error").isNotNull() if has_error else F.col("last_error").isNull())
    if mime_prefix is not None:
        out = out.filter(F.startswith("mime", F.lit(mime_prefix)))
    if root_id is not None or path_prefix is not None:
        p = paths
        if root_id is not None:
            p = p.filter(F.col("root_id") == root_id)
        if path_prefix is not None:
            p = p.filter(F.startswith("path", F.lit(path_prefix)))
        out = out.join(p.select("file_id"), "file_id", "left_semi")
    return out


def open_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter("done_at is null")


def with_status(records: DataFrame, paths: DataFrame, jobs: DataFrame) -> DataFrame:
    """Records with `status`: tombstoned, else indexing (an open job at one of its paths), else error, else ok."""
    busy = paths.join(open_jobs(jobs).select("root_id", "path"), ["root_id", "path"], "left_semi").select("file_id").distinct().withColumn("_busy", F.lit(True))
    status = F.when(F.col("tombstoned_at").isNotNull(), "tombstoned").when(F.col("_busy"), "indexing").when(F.col("last_error").isNotNull(), "error").otherwise("ok")
    return records.join(busy, "file_id", "left").withColumn("status", status).drop("_busy")


def behind(key: str, descending: bool, value, file_id: str) -> Column:
    """Rows that come after (value, file_id) in the order of (key, file_id); null values are least."""
    ids = F.col("file_id") < file_id if descending else F.col("file_id") > file_id
    if key == "file_id":
        return ids
    own, null = F.col(key), F.col(key).isNull()
    if value is None:
        return null & ids if descending else ~null | ids
    further = own < value if descending else own > value
    return F.coalesce(further | ((own == value) & ids), F.lit(descending))


def list_files(records: DataFrame, paths: DataFrame, jobs: DataFrame, sort: str = "indexed_at", descending: bool = True, limit: int = 50, offset: int = 0, after: tuple | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(a page of records with paths and status, total). The page begins at an offset, or behind the row `after`: (its value of
    the sort column, its file_id), by a filter that reaches the scan. The page, PAGE rows at most, is written once; paths and jobs
    are joined to it only."""
    if not 1 <= limit <= PAGE:
        raise ValueError(f"limit 1..{PAGE}")
    key = "file_id" if sort == "path" else sort
    fitting = filter_files(records, paths, **filters)
    order = [F.desc(c) if descending else F.asc(c) for c in dict.fromkeys((key, "file_id"))]
    rest = fitting if after is None else fitting.filter(behind(key, descending, *after))
    page = stored(rest.orderBy(*order).offset(offset).limit(limit))
    of_page = paths.join(page.select("file_id"), "file_id", "left_semi")
    return files_with_paths(with_status(page, of_page, jobs), of_page), fitting.agg(F.count("*").alias("total"))


def pending_folders(jobs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """A2: (the folders with most pending jobs that never failed, number of folders)."""
    by = jobs.filter("done_at is null and last_error is null").groupBy("root_id", dirname(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "root_id", "folder").limit(limit), by.agg(F.count("*").alias("folders"))


def queue_stats(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """A3: one row; pending, running and failed are told up to COUNT_CAP, done is not."""
    capped = lambda c: F.least(F.count_if(c), F.lit(COUNT_CAP))
    open_, locked, error = F.col("done_at").isNull(), F.col("locked_until").isNotNull(), F.col("last_error").isNotNull()
    counts = jobs.agg(capped(open_ & ~locked).alias("pending"), capped(open_ & locked).alias("running"), capped(~open_ & error).alias("failed"), F.count_if(~open_).alias("done"))
    alive = records.agg(F.count_if(F.col("tombstoned_at").isNull()).alias("alive_files"))
    return counts.join(alive)  # one row beside one row


def vector_counts(chunks: DataFrame) -> DataFrame:
    """A4: captions, and everything else (null kinds too) as text."""
    caption = F.col("kind").eqNullSafe("caption")
    return chunks.agg(F.count_if(~caption).alias("text"), F.count_if(caption).alias("visual"))


def throughput(jobs: DataFrame, now_ms: int) -> DataFrame:
    """A5: completions of the trailing ten minutes, the rate a minute, and the seconds that pending jobs still take."""
    recent = (F.col("done_at") >= now_ms - RATE_MS) & (F.col("done_at") <= now_ms)
    counts = jobs.agg(F.count_if(recent).alias("completed"), F.count_if(F.col("done_at").isNull() & F.col("locked_until").isNull()).alias("pending"))
    rate = F.round(F.col("completed") / (RATE_MS / 60_000), 2)
    eta = F.when((rate > 0) & (F.col("pending") > 0), F.floor(F.col("pending") * 60 / rate))
    return counts.select("completed", "pending", rate.alias("rate_per_min"), eta.cast("long").alias("eta_s"))


def trailing_rate(jobs: DataFrame, part: Column | None = None) -> DataFrame:
    """A5 per completed job: how many were completed in the ten minutes up to it. Jobs are dealt by spans of time, each with
    the span before it, so that no task orders them all."""
    span = F.floor(F.col("done_at") / RATE_MS)
    done = jobs.filter("done_at is not null").select("id", "done_at", span.alias("span"))
    both = done.select("id", "done_at", F.col("span").alias("at"), F.lit(True).alias("own")).unionByName(done.select("id", "done_at", (F.col("span") + 1).alias("at"), F.lit(False).alias("own")))
    w = W.partitionBy("at").orderBy("done_at").rangeBetween(-RATE_MS, 0)
    return both.withColumn("n", F.count("*").over(w)).filter("own").select("id", "done_at", F.col("n").alias("completed"))


def earliest_mtime(paths: DataFrame) -> DataFrame:
    """A7."""
    return paths.groupBy("file_id").agg(F.min("mtime_ms").alias("mtime_ms"))


def find_pollution(records: DataFrame, paths: DataFrame, exts: DataFrame) -> DataFrame:
    """Alive files of which no path has an allowed extension, with their extensions, paths, chunks and bytes."""
    known = exts.filter("enabled").select(F.col("ext").alias("_ext")).distinct()
    p = paths.withColumn("ext", path_ext(F.col("path"))).join(known, F.col("ext") == F.col("_ext"), "left")
    by = p.groupBy("file_id").agg(F.sort_array(F.collect_set("ext")).alias("exts"), F.count("*").alias("n_paths"), F.min("path").alias("sample_path"), F.bool_or(F.col("_ext").isNotNull()).alias("fine"))
    return records.filter("tombstoned_at is null").join(by.filter("not fine"), "file_id").select("file_id", "exts", "n_paths", "sample_path", "vector_count", "size")


def pollution_totals(polluted: DataFrame) -> DataFrame:
    return polluted.agg(F.count("*").alias("files"), F.coalesce(F.sum("vector_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
