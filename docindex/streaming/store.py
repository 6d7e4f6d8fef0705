"""A ledger whose tables are laid out by buckets, so that a batch of changes costs what it touches (T4).

records, chunks and owners (the paths again, by file) are laid out by file, paths by (root_id, path). A batch names paths; these name
the files that they had and get; and all that changes are rows of those files and paths. So a batch reads and writes the buckets
that these fall into, and no others. A retired root names its paths first: a scan of the paths for that root alone.

A committed state is a mark: a small file, written last, that names the snapshots of all tables. Without it nothing that a batch
wrote is ever read."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import Ledger, identified
from ..session import stored
from ..sources.layout import buckets_of, delete_folder, expire, layout, names_in, read_buckets, read_text, replace_buckets, write_table, write_text

#: How each table is laid out; jobs are there if the ledger has them.
KEYS = {"records": ["file_id"], "paths": ["root_id", "path"], "owners": ["file_id"], "chunks": ["file_id"], "jobs": ["root_id", "path"]}
BUCKETS = 64
#: Committed states that stay, for plans that still read the last one.
KEPT = 2


def create(ledger: Ledger, folder: str, buckets: int = BUCKETS) -> None:
    """The state before the first batch; nothing is done where there is one."""
    spark = ledger.records.sparkSession
    if committed(spark, folder) is None:
        tables = {"records": ledger.records, "paths": ledger.paths, "owners": ledger.paths, "chunks": ledger.chunks} | ({"jobs": ledger.jobs} if ledger.jobs is not None else {})
        commit(spark, folder, -1, {n: write_table(t, f"{folder}/{n}", KEYS[n], buckets) for n, t in tables.items()})


def commit(spark: SparkSession, folder: str, number: int, tables: dict[str, str]) -> None:
    write_text(spark, f"{folder}/marks/{number + 1:012d}.json", json.dumps({"number": number, "tables": tables}))


def committed(spark: SparkSession, folder: str, before: int | None = None) -> dict | None:
    """The newest mark (number, tables), or the newest of a batch before that number."""
    names = [n for n in names_in(spark, f"{folder}/marks") if n.endswith(".json") and (before is None or int(n[:-5]) - 1 < before)]
    return json.loads(read_text(spark, f"{folder}/marks/{names[-1]}")) if names else None


def read(spark: SparkSession, folder: str) -> Ledger:
    """The whole ledger as it was committed last."""
    tables = committed(spark, folder)["tables"]
    of = lambda n: read_buckets(spark, tables[n])
    return Ledger(of("records"), of("paths"), of("chunks"), of("jobs") if "jobs" in tables else None)


def apply_batch(spark: SparkSession, folder: str, number: int, jobs: DataFrame, fetch: Callable[[DataFrame], DataFrame], change: Callable[[Ledger, DataFrame, DataFrame], Ledger]) -> None:
    """One batch of compacted jobs (root_id, path, op, ...) from the state before it to a new one.

    fetch: the files (root_id, path, content, ...) of the paths that are to be indexed. change: the ledger after the jobs; it gets
    the part of the ledger that belongs to the touched files, the jobs and the files, and has to leave all else alone. A batch that
    is run again starts from the same state."""
    tables = committed(spark, folder, number)["tables"]
    at = {n: layout(spark, p).buckets for n, p in tables.items()}
    part = lambda n, rows, touched: read_buckets(spark, tables[n], touched).join(rows, KEYS[n], "left_semi")
    jobs = stored(jobs)
    content = stored(fetch(jobs.filter("op in ('index', 'reindex')").select("root_id", "path")))
    named = jobs.filter("op <> 'retire_root'").select("root_id", "path").distinct()
    retired = jobs.filter("op = 'retire_root'").select("root_id").distinct()
    old = part("paths", named, buckets_of(named, KEYS["paths"], at["paths"])).select("root_id", "path", "file_id")
    retires = not retired.isEmpty()
    if retires:
        old = old.unionByName(read_buckets(spark, tables["paths"]).join(retired, "root_id", "left_semi").select("root_id", "path", "file_id"))
    old = stored(old.distinct())
    files = stored(old.select("file_id").unionByName(identified(content).select("file_id")).distinct())
    keys = stored(named.unionByName(old.select("root_id", "path")).distinct())
    queued = None
    if "jobs" in tables:
        queued = read_buckets(spark, tables["jobs"]).join(retired, "root_id", "left_semi") if retires else spark.createDataFrame([], layout(spark, tables["jobs"]).schema)
    # the tables that are laid out by file share their buckets, unless the ledger was laid out in another way
    of_files = {b: buckets_of(files, ["file_id"], b) for b in {at[n] for n in ("records", "owners", "chunks")}}
    before = Ledger(*(stored(part(n, files, of_files[at[n]])) for n in ("records", "owners", "chunks")), queued if queued is None else stored(queued))
    after = change(before, jobs, content)
    paths = stored(after.paths)
    # what the batch leaves has no other keys than the touched ones
    new = {n: replace_buckets(tables[n], t, f"{folder}/{n}", files, of_files[at[n]]) for n, t in (("records", after.records), ("chunks", after.chunks), ("owners", paths))}
    new["paths"] = replace_buckets(tables["paths"], paths.join(keys, KEYS["paths"], "left_semi"), f"{folder}/paths", keys, buckets_of(keys, KEYS["paths"], at["paths"]))
    if "jobs" in tables:
        new["jobs"] = replace_buckets(tables["jobs"], stored(after.jobs), f"{folder}/jobs", before.jobs.select("root_id", "path")) if retires else tables["jobs"]
    commit(spark, folder, number, new)


def forget(spark: SparkSession, folder: str, kept: int = KEPT) -> None:
    """Deletes all but the last `kept` committed states, and what no kept one names. Not while a batch is written."""
    names = [n for n in names_in(spark, f"{folder}/marks") if n.endswith(".json")]
    marks = [json.loads(read_text(spark, f"{folder}/marks/{n}"))["tables"] for n in names[-kept:]]
    for n in names[:-kept]:
        delete_folder(spark, f"{folder}/marks/{n}")
    for n in KEYS:
        expire(spark, f"{folder}/{n}", [m[n] for m in marks if n in m])
