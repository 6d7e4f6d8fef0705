"""Workload plans: a batch of files to chunk points, end to end."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import guess_mime, is_gated, path_ext
from ..operators.chunking import build_chunks, chunk_routed
from ..operators.inference import embed
from ..operators.ledger import Ledger, dedup_files, identified, resolve_identity, retire_roots
from ..operators.reports import root_ids
from ..operators.routing import indexable, route_files
from ..operators.upserts import set_chunk_roots, upsert_chunks, upsert_paths, upsert_records
from ..session import stored
from ..sources.io import html_to_markdown, to_markdown

#: Extensions that the converter here reads; files of other formats that need one fail, and so have no chunk.
HTML = (".html", ".htm")


def converted(files: DataFrame, converter: Callable[[str], str] = html_to_markdown, formats: tuple[str, ...] = HTML) -> DataFrame:
    """files (path, size, content) with route, stored_mime, text and error: formats of the converter as markdown, plain ones as they
    are. What can't be converted keeps its row with a mime of its own and no text; raw bytes are never chunked."""
    ext = path_ext(F.col("path"))
    bare = F.regexp_replace(ext, r"^\.", "")
    routed = route_files(files).withColumn("_converts", (F.col("route") == "docling") & ext.isin(*formats)).withColumn("content", F.when(F.col("route") != "too_large", F.col("content")))
    rows = to_markdown(routed, converter, only="_converts")
    failed = F.col("route").isin("docling", "legacy") & (~F.col("_converts") | F.col("error").isNotNull())
    mime = F.when(failed & (F.col("route") == "legacy"), F.concat(F.lit("application/legacy-office/"), bare)).when(failed, F.concat(F.lit("application/octet-stream/"), bare))
    return rows.withColumn("text", F.when(~failed, F.col("text"))).withColumn("stored_mime", F.coalesce(mime, "stored_mime")).drop("_converts", "content")


def index_files(files: DataFrame, exts: DataFrame, rules: DataFrame, parser_version: str, model_version: str, now_ms: int, converter: Callable[[str], str] = html_to_markdown) -> DataFrame:
    """The chunk table of a batch of files (root_id, path, content, size, mtime_ms).

    Content is hashed where it is read; what is shuffled to find one copy of each file is its hash and path. The content of
    indexable files then comes back by one join on the copy that was chosen, and is converted and chunked."""
    fine = indexable(files, exts, rules).filter("indexable")
    rows = identified(fine)
    chosen = dedup_files(rows.select("file_id", "root_id", "path", "size", "mtime_ms")).select("file_id", "path", "root_id", "size", "mtime_ms")
    one = chosen.join(fine.select("root_id", "path", "content"), ["root_id", "path"]).select("file_id", "path", "size", "mtime_ms", "content")
    return build_chunks(converted(one, converter), rows.select("root_id", "path", "file_id"), parser_version, model_version, now_ms)


def index_and_embed(files: DataFrame, exts: DataFrame, rules: DataFrame, parser_version: str, model_version: str, now_ms: int, encoder: Callable) -> DataFrame:
    """index_files() with vectors. Chunks are spread evenly first, so that one long file doesn't hold a task."""
    return embed(index_files(files, exts, rules, parser_version, model_version, now_ms).hint("rebalance"), encoder)


def vector_counts_by_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.count("*").alias("vector_count"))


@dataclass
class Indexed:
    """The ledger after a batch, and what was done: root_id, path, file_id, action, old_file_id, orphaned, root_lost, indexable."""

    ledger: Ledger
    actions: DataFrame


def index_batch(
    ledger: Ledger, files: DataFrame, exts: DataFrame, rules: DataFrame, parser_version: str, model_version: str, now_ms: int,
    encoder: Callable | None = None, converter: Callable[[str], str] = html_to_markdown,
) -> Indexed:
    """The flagship: files (root_id, path, content, size, mtime_ms, priority, id; one row a path) go through the gate, identity,
    conversion, chunking and embedding into the ledger's records, paths and chunks (of which `dense` and `sparse` are columns if
    there is an encoder).

    A path below a gate is left alone. Any other path gets its file: a new one has a provisional record until it is indexed. One
    indexable path of each new or outdated file, the first by (priority, id), is indexed whole: all points of the file are
    replaced if it has any chunk, else only its record is renewed. Other paths add their root. A file that loses its last path
    is tombstoned, one that loses a root shrinks."""
    rows = stored(identified(indexable(files.filter(~is_gated(F.col("path"))), exts, rules)).drop("content"))
    # a path that isn't indexable never does the work that another path of the file can do
    ranked = rows.select("root_id", "path", "sha256_full", "file_id", (F.col("priority") + F.when(F.col("indexable"), 0).otherwise(1 << 20)).alias("priority"), "id")
    resolved = resolve_identity(ranked, ledger.records, ledger.paths, parser_version, {"text": model_version})
    actions = stored(resolved.join(rows.select("root_id", "path", "indexable", "sha256_full", "size", "mtime_ms"), ["root_id", "path"]))
    paths = stored(upsert_paths(ledger.paths, actions.select("root_id", "path", "file_id", "mtime_ms").select(ledger.paths.columns)))

    full = actions.filter("action = 'FULL_INDEX' and indexable").select("root_id", "path", "file_id", "sha256_full", "size", "mtime_ms")
    # the chosen paths are indexable: the rules were asked once, above
    texts = converted(full.join(files.select("root_id", "path", "content"), ["root_id", "path"]), converter)
    made = stored(chunk_routed(texts).select("file_id", "sha256_full", "size", "stored_mime", "mtime_ms", "chunks"))
    chunks = build_chunks(made, paths.select("root_id", "path", "file_id"), parser_version, model_version, now_ms)
    if encoder is not None:
        chunks = embed(chunks.hint("rebalance"), encoder)

    # records: provisional ones of new files, then those that were indexed; tombstones of the batch's files go
    renewed = {"modalities_done": F.lit(json.dumps({"text": model_version}, separators=(",", ":"))), "parser_version": F.lit(parser_version), "indexed_at": F.lit(now_ms).cast("long")}
    new = actions.join(ledger.records.select("file_id"), "file_id", "left_anti").groupBy("file_id").agg(F.min(F.struct("path", "sha256_full", "size")).alias("r")).select("file_id", "r.*")
    new = guess_mime(new).select("file_id", "sha256_full", "size", "mime").withColumns(renewed | {"modalities_done": F.lit("{}")})
    indexed = made.select("file_id", "sha256_full", "size", F.col("stored_mime").alias("mime"), F.size("chunks").cast("long").alias("_n")).withColumns(renewed)
    first = new.join(indexed.select("file_id"), "file_id", "left_anti").withColumn("_n", F.lit(0).cast("long"))
    both = first.unionByName(indexed)
    records = upsert_records(ledger.records, both.withColumn("vector_count", F.col("_n")).drop("_n"))
    told = both.filter("_n > 0").select("file_id", "_n")
    seen = actions.select("file_id").distinct().withColumn("_seen", F.lit(True))
    gone = actions.filter("orphaned").select(F.col("old_file_id").alias("file_id")).distinct().withColumn("_gone", F.lit(True))
    records = records.join(told, "file_id", "left").join(seen, "file_id", "left").join(gone, "file_id", "left").withColumns({
        "vector_count": F.coalesce("_n", "vector_count"),
        "tombstoned_at": F.when(F.col("_gone"), F.lit(now_ms).cast("long")).when(F.col("_seen"), None).otherwise(F.col("tombstoned_at")),
    }).select(ledger.records.columns)

    # roots of files that gained or lost a path; those that were indexed have theirs in their new chunks
    changed = actions.filter("action <> 'FULL_INDEX'").select("file_id").unionByName(actions.filter("orphaned or root_lost").select(F.col("old_file_id").alias("file_id"))).distinct()
    roots = changed.join(root_ids(paths.join(changed, "file_id", "left_semi")), "file_id", "left")
    updates = roots.select("file_id", F.coalesce("root_ids", F.array().cast("array<string>")).alias("new_roots"), F.lit(now_ms).cast("long").alias("at"))
    kept = set_chunk_roots(ledger.chunks, updates)
    after = Ledger(records, paths, upsert_chunks(kept, chunks.select([c for c in chunks.columns if c in ledger.chunks.columns])), ledger.jobs)
    return Indexed(after, actions.drop("sha256_full", "size", "mtime_ms"))


def apply_jobs(ledger: Ledger, jobs: DataFrame, files: DataFrame, exts: DataFrame, rules: DataFrame, parser_version: str, model_version: str, now_ms: int, **options) -> Ledger:
    """T4: the ledger after a batch of jobs (root_id, path, op, priority; one a path, see latest_per_path): retired roots (M4) and
    deleted paths (M3) go, then what is to be indexed is read from `files` (index_batch); a path that isn't there any more changes
    nothing."""
    after, _ = retire_roots(ledger, jobs.filter("op = 'retire_root'").select("root_id"), now_ms, jobs.filter("op = 'delete'").select("root_id", "path"))
    todo = jobs.filter("op in ('index', 'reindex')").select("root_id", "path", F.col("priority").alias("_p")).dropDuplicates(["root_id", "path"])
    found = files.join(todo, ["root_id", "path"]).withColumn("priority", F.col("_p")).drop("_p")
    return index_batch(after, found, exts, rules, parser_version, model_version, now_ms, **options).ledger
