"""The registered queries of the library's operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import mimetypes
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths, scalars
from ..operators import chunking, inference, jobs, ledger, reports, routing, search, upserts, verify
from ..session import shared_dir, stored
from ..sources import io, layout
from ..streaming import feed, store, stream
from . import fixtures as X
from .indexing import apply_jobs, converted, index_batch, index_files

NOW = X.BASE_MS + 90 * 24 * 3_600_000
JOBS_NOW = 978_307_200_000  # 2001-01-01, inside the orders' dates
VERSION, MODELS = "parser/0.3.0", {"text": "hash/v1"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query; sql follows the derived tables of fixtures.SQL (it starts with `SELECT`, or `,` and more tables)."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = X.SQL + sql
        return f

    return register


def joined(column: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


def hashed(rows: DataFrame) -> DataFrame:
    """Whole texts told by their digests."""
    return rows.withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")


def tables(s: SparkSession, d: str) -> ledger.Ledger:
    return ledger.Ledger(X.file_records(s, d), stored(X.file_paths(s, d)), X.ledger_chunks(s, d), stored(X.parse_jobs(s, d)))


# --- sources and sinks


@query()
def s1_read_files(s, d):
    """The documents as text files, a line break after each text. 64 texts share a file, which no 64 of under 1/64 of the limit can
    make too large; a longer text has a file to itself, so that only what the reader itself refuses is left out."""
    texts, share = X.table(s, d, "documents").select("text"), 64
    long = F.coalesce(F.octet_length("text"), F.lit(0)) >= routing.MAX_FILE_BYTES // share
    folder = f"{shared_dir(s)}/files-{uuid.uuid4().hex}"
    texts.filter(~long).write.option("maxRecordsPerFile", share).text(f"{folder}/shared")
    texts.filter(long).write.option("maxRecordsPerFile", 1).text(f"{folder}/single")
    rows = io.read_files(s, folder, pathGlobFilter="*.txt")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1), r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    return rows.select(name.alias("name"), "size", "mime", F.char_length("text").alias("n_chars"))


@query()
def s2_to_markdown(s, d):
    rows = X.table(s, d, "pages").select("page_id", F.concat(F.lit("/DATA/web/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    out = chunking.chunk_markdown_texts(io.converted_mime(io.to_markdown(rows)).drop("content"), least=20)
    return out.select("page_id", "stored_mime", "error", F.sha2("text", 256).alias("text_sha256"), F.size("chunks").alias("n_chunks"))


@query("SELECT doc_id, left(text, 40000) AS text, length(text) > 40000 AS truncated FROM documents")
def s3_extract_preview(s, d):
    return io.extract_preview(X.table(s, d, "documents").select("doc_id", "text"))


@query(f"SELECT root_id, path, op, is_dir, detected_at, seq FROM file_events WHERE detected_at > {X.BASE_MS + 3_600_000} OR (detected_at = {X.BASE_MS + 3_600_000} AND seq > 10) ORDER BY detected_at, seq LIMIT 200")
def s4_read_events_after(s, d):
    return io.read_events_after(X.file_events(s, d), X.BASE_MS + 3_600_000, 10, 200)


@query("SELECT 's' || s_suppkey AS id, '/DATA/s' || s_suppkey AS path, coalesce(s_suppkey % 5 <> 0, true) AS enabled FROM supplier WHERE s_suppkey % 3 <> 2")
def s5_normalize_roots(s, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("s"), k)
    listing = X.table(s, d, "supplier").select(F.when(k % 3 == 0, name).alias("id"), F.when(k % 3 == 0, F.concat(F.lit("/DATA/"), name)).alias("path"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("enabled"))
    upper = X.table(s, d, "supplier").select(F.when(k % 3 == 1, name).alias("ID"), F.when(k % 3 == 1, F.concat(F.lit("/DATA/"), name)).alias("Path"), F.when(k % 5 == 0, False).when(k % 5 == 1, True).alias("enabled"))
    return io.normalize_roots(listing.filter("id is not null")).unionByName(io.normalize_roots(upper.filter("ID is not null")))


def exported_captions(s, d):
    return io.export_captions(X.chunks(s, d).withColumn("tombstoned_at", F.lit(None).cast("long")), "src2", None, 1000)


@query("SELECT point_id, substr(file_id, 6) AS asset_id, sha256(text) AS text_sha256, mtime_ms FROM (SELECT * FROM chunks WHERE root_ids = 'src2' AND kind = 'caption' ORDER BY point_id LIMIT 1000) WHERE starts_with(file_id, 'src2:')")
def s6_export_captions(s, d):
    return hashed(exported_captions(s, d))


@query("SELECT * FROM file_records")
def s7_write_table(s, d):
    folder = f"{shared_dir(s)}/tables-{uuid.uuid4().hex}"
    old = io.write_table(X.file_records(s, d).withColumn("size", F.when(F.col("vector_count") == 3, F.lit(-1)).otherwise(F.col("size"))), folder, "file_id", 12)
    new = io.replace_buckets(old, X.file_records(s, d).filter("vector_count = 3"), folder)
    return io.read_buckets(s, new)


# --- projections and predicates

ODD = (".env", "a.tar.gz", "noext", "..b.C", "x.", ".a.b", "...")
ODD_EXT = ("", ".gz", "", ".c", ".", ".b", "")


@query(f", odd AS (SELECT doc_id, '/d/' || {X._pick(ODD, 'doc_id')} AS path, {X._pick(ODD_EXT, 'doc_id')} AS ext FROM documents) SELECT path, ext FROM files UNION ALL SELECT path, ext FROM file_paths UNION ALL SELECT path, ext FROM odd")
def p1_path_ext(s, d):
    odd = X.table(s, d, "documents").select(F.concat(F.lit("/d/"), X.pick(ODD, "doc_id")).alias("path"))
    rows = X.files(s, d).select("path").unionByName(X.file_paths(s, d).select("path")).unionByName(odd)
    return rows.select("path", paths.path_ext(F.col("path")).alias("ext"))


_ROUTE = "CASE WHEN size > 4194304 THEN 'too_large' WHEN ext IN ('.html', '.pdf') THEN 'docling' WHEN ext = '.md' THEN 'markdown' WHEN ext = '.py' THEN 'source' ELSE 'plain' END"


@query(f"SELECT path, size, {_ROUTE} AS route, CASE WHEN size > 4194304 THEN 'application/x-too-large/' || ext[2:] WHEN ext IN ('.html', '.pdf') THEN 'text/markdown+docling/' || ext[2:] WHEN ext = '.md' THEN 'text/markdown' WHEN ext = '.py' THEN 'text/x-source' ELSE 'text/plain' END AS stored_mime FROM files")
def p2_route_files(s, d):
    return routing.route_files(X.files(s, d).select("path", "size"))


_MIME = "CASE ext " + " ".join(f"WHEN '{e.lower()}' THEN '{mimetypes.types_map[e.lower()]}'" for e in X.EXT9 if e.lower() in mimetypes.types_map) + " ELSE 'application/octet-stream' END"


@query(f"SELECT path, {_MIME} AS mime FROM files UNION ALL SELECT path, {_MIME} FROM file_paths")
def p3_guess_mime(s, d):
    return paths.guess_mime(X.files(s, d).select("path").unionByName(X.file_paths(s, d).select("path")))


@query("SELECT path, CASE WHEN doc_id % 13 = 2 THEN '/DATA/Notes/d' || regexp_extract(path, 'd([0-9]+[.][A-Za-z]+)$', 1) ELSE path END AS normal, doc_id % 13 IN (0, 1, 2) AS gated FROM files")
def p4_is_gated(s, d):
    return X.files(s, d).select("path", paths.normalize_path(F.col("path")).alias("normal"), paths.is_gated(F.col("path")).alias("gated"))


@query("SELECT root_id, path, indexable FROM fine_files")
def p5_indexable(s, d):
    return routing.indexable(X.files(s, d).select("root_id", "path"), X.allowlist(s), X.rules(s))


def many_rules(s: SparkSession, d: str) -> DataFrame:
    """Rules for the documents' files, more than one for each: by prefix, by name, and by whole paths in another root."""
    k, root = F.col("doc_id"), lambda n: X.text("r", F.expr(f"(doc_id + {n}) % 7"))
    rows = X.table(s, d, "documents").select("doc_id", "source")
    deny = rows.filter("doc_id % 3 = 0").select(root(0).alias("root_id"), X.text("/DATA/", F.col("source"), "/docs/d", k, ".*").alias("path_glob"), F.lit("deny").alias("action"))
    allow = rows.filter("doc_id % 2 = 0").select(root(0).alias("root_id"), X.text("*/d", k, ".mov").alias("path_glob"), F.lit("allow").alias("action"))
    other = rows.select(root(1).alias("root_id"), X.text("/DATA/", F.col("source"), "/docs/d", k, ".csv").alias("path_glob"), F.lit("allow").alias("action"))
    return deny.unionByName(allow).unionByName(other)


@query(f"SELECT root_id, path, doc_id % 13 NOT IN (0, 1, 2) AND doc_id % 3 <> 0 AND ((ext = '.mov' AND doc_id % 2 = 0) OR ext IN ({X.ENABLED})) AS indexable FROM files")
def p5_many_rules(s, d):
    return routing.indexable(X.files(s, d).select("root_id", "path"), X.allowlist(s), many_rules(s, d))


@query(""", batch AS (SELECT id, CASE WHEN id % 8 = 1 THEN replace(path, '/DATA/', '/DATA/.Trash-7/') ELSE path END AS path, op IN ('index', 'reindex') AND id % 8 = 1 AS gated FROM parse_jobs WHERE done_at IS NULL) SELECT * FROM batch""")
def p6_split_gated(s, d):
    """Some of the open jobs lie below a gate; those of them that index are skipped, deletions aren't."""
    below = F.when(F.col("id") % 8 == 1, F.replace("path", F.lit("/DATA/"), F.lit("/DATA/.Trash-7/"))).otherwise(F.col("path"))
    run, skipped = jobs.split_gated(reports.open_jobs(X.parse_jobs(s, d)).withColumn("path", below))
    return run.select("id", "path", F.lit(False).alias("gated")).unionByName(skipped.select("id", "path", F.lit(True).alias("gated")))


@query("SELECT file_id, size, mime FROM file_records r WHERE tombstoned_at IS NULL AND last_error IS NULL AND starts_with(mime, 'text/') AND EXISTS (SELECT 1 FROM file_paths p WHERE p.file_id = r.file_id AND root_id = 's1' AND starts_with(path, '/DATA/o1'))")
def p7_filter_files(s, d):
    return reports.filter_files(X.file_records(s, d), X.file_paths(s, d), has_error=False, mime_prefix="text/", root_id="s1", path_prefix="/DATA/o1").select("file_id", "size", "mime")


_STATUS = "CASE WHEN tombstoned_at IS NOT NULL THEN 'tombstoned' WHEN EXISTS (SELECT 1 FROM file_paths p JOIN open_jobs USING (root_id, path) WHERE p.file_id = r.file_id) THEN 'indexing' WHEN last_error IS NOT NULL THEN 'error' ELSE 'ok' END AS status"


@query(f"SELECT file_id, {_STATUS} FROM file_records r")
def p8_with_status(s, d):
    return reports.with_status(X.file_records(s, d), X.file_paths(s, d), X.parse_jobs(s, d)).select("file_id", "status")


@query("SELECT conv_id, turn, text FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN ' ' || chr(9) || chr(10) ELSE text END AS text FROM conversations) WHERE regexp_matches(text, '\\S')")
def p9_drop_blank(s, d):
    rows = X.table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, " \t\n").otherwise(F.col("text")).alias("text"))
    return routing.drop_blank(rows)


@query("SELECT * FROM event_jobs")
def p10_events_to_jobs(s, d):
    return routing.events_to_jobs(X.file_events(s, d), X.allowlist(s), X.rules(s))


# --- joins


_PATHS = "(SELECT string_agg(root_id || '|' || path || '|' || mtime_ms, ',' ORDER BY root_id, path, mtime_ms) FROM file_paths p WHERE p.file_id = {})"


def flat_paths(df: DataFrame) -> DataFrame:
    return df.withColumn("paths", F.array_join(F.transform("paths", lambda p: F.concat_ws("|", p["root_id"], p["path"], p["mtime_ms"].cast("string"))), ","))


@query(f"SELECT file_id, size, coalesce({_PATHS.format('r.file_id')}, '') AS paths FROM file_records r")
def j1_files_with_paths(s, d):
    return flat_paths(reports.files_with_paths(X.file_records(s, d), X.file_paths(s, d))).select("file_id", "size", "paths")


@query(f", ids AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey ELSE 'p' || p_partkey END AS file_id FROM part WHERE p_partkey % 4 = 0) SELECT r.file_id, coalesce({_PATHS.format('r.file_id')}, '') AS paths, NULL::BIGINT AS missing_at FROM file_records r JOIN ids USING (file_id) UNION ALL SELECT file_id, NULL, ordinal FROM ids WHERE ordinal % 3 = 0")
def j2_lookup_files(s, d):
    k = F.col("p_partkey")
    asked = X.table(s, d, "part").filter("p_partkey % 4 = 0").select(k.alias("ordinal"), F.concat(F.when(k % 3 == 0, "x").otherwise("p"), k).alias("file_id"))
    found, missing = reports.lookup_files(asked, X.file_records(s, d), X.file_paths(s, d))
    return flat_paths(found).select("file_id", "paths", F.lit(None).cast("long").alias("missing_at")).unionByName(missing.select("file_id", F.lit(None).cast("string").alias("paths"), F.col("ordinal").alias("missing_at")))


_DIFF = "diff AS (SELECT coalesce(i.root_id, p.root_id) AS root_id, coalesce(i.path, p.path) AS path, i.mtime_ms AS wiki_mtime, p.mtime_ms AS local_mtime, coalesce(i.ext, p.ext) AS ext, CASE WHEN p.path IS NULL THEN 'missing' WHEN i.path IS NULL THEN 'extra' WHEN abs(i.mtime_ms - p.mtime_ms) > 1000 THEN 'stale' ELSE 'same' END AS class FROM inventory_files i FULL JOIN file_paths p ON i.root_id = p.root_id AND i.path = p.path)"


@query(f", {_DIFF} SELECT root_id, path, wiki_mtime, local_mtime, class FROM diff")
def j3_diff_ledger(s, d):
    return verify.diff_ledger(X.inventory_files(s, d), X.file_paths(s, d))


@query("SELECT root_id, path, file_id FROM file_paths p WHERE NOT EXISTS (SELECT 1 FROM open_jobs o WHERE o.root_id = p.root_id AND o.path = p.path)")
def j4_without_open_jobs(s, d):
    return ledger.without_open_jobs(X.file_paths(s, d).select("root_id", "path", "file_id"), X.parse_jobs(s, d))


@query(", o AS (SELECT file_id, max({'at': done_at, 'r': j.root_id, 'p': j.path, 'e': j.last_error}) AS o FROM parse_jobs j JOIN file_paths p ON p.root_id = j.root_id AND p.path = j.path WHERE done_at IS NOT NULL GROUP BY file_id) SELECT file_id, CASE WHEN o.o IS NOT NULL THEN o.o.e ELSE last_error END AS last_error FROM file_records LEFT JOIN o USING (file_id)")
def j5_apply_errors(s, d):
    outcomes = X.parse_jobs(s, d).filter("done_at is not null").select("root_id", "path", F.col("done_at").alias("at"), F.col("last_error").alias("error"))
    return jobs.apply_errors(X.file_records(s, d), X.file_paths(s, d), outcomes).select("file_id", "last_error")


@query("SELECT j.id, j.path, CASE WHEN j.last_error IS NOT NULL THEN 'failed' WHEN op = 'delete' THEN 'deleted' ELSE 'indexed' END AS status, CASE WHEN j.last_error IS NULL AND op <> 'delete' AND r.file_id IS NOT NULL THEN CASE modalities_done WHEN '{\"text\":\"hash/v1\"}' THEN 'text=hash/v1' WHEN '{\"text\":\"hash/v2\"}' THEN 'text=hash/v2' WHEN '{\"text\":\"hash/v1\",\"image\":\"x\"}' THEN 'image=x,text=hash/v1' ELSE '' END END AS modalities, j.last_error AS error FROM parse_jobs j LEFT JOIN file_paths p ON p.root_id = j.root_id AND p.path = j.path LEFT JOIN file_records r ON r.file_id = p.file_id WHERE done_at IS NOT NULL AND op <> 'visual_ingest' AND (j.last_error IS NOT NULL OR id % 8 <> 0)")
def j6_receipts(s, d):
    done = X.parse_jobs(s, d).filter("done_at is not null").withColumn("skipped", F.col("id") % 8 == 0)
    pairs = F.transform(F.sort_array(F.map_entries("modalities")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return jobs.receipts(done, X.file_paths(s, d), X.file_records(s, d)).withColumn("modalities", F.array_join(pairs, ","))


# --- aggregations


@query("SELECT file_id, array_to_string(list_sort(list(DISTINCT root_id)), ',') AS root_ids FROM file_paths GROUP BY file_id")
def a1_root_ids(s, d):
    return reports.root_ids(X.file_paths(s, d)).withColumn("root_ids", F.array_join("root_ids", ","))


@query(", g AS (SELECT root_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM parse_jobs WHERE done_at IS NULL AND last_error IS NULL GROUP BY 1, 2) SELECT root_id, folder, n, (SELECT count(*) FROM g) AS folders FROM g ORDER BY n DESC, root_id, folder LIMIT 20")
def a2_pending_folders(s, d):
    top, total = reports.pending_folders(X.parse_jobs(s, d), 20)
    return top.join(total)


@query("SELECT least(count(*) FILTER (done_at IS NULL AND locked_until IS NULL), 10000) AS pending, least(count(*) FILTER (done_at IS NULL AND locked_until IS NOT NULL), 10000) AS running, least(count(*) FILTER (done_at IS NOT NULL AND last_error IS NOT NULL), 10000) AS failed, count(*) FILTER (done_at IS NOT NULL) AS done, (SELECT count(*) FROM file_records WHERE tombstoned_at IS NULL) AS alive_files FROM parse_jobs")
def a3_queue_stats(s, d):
    return reports.queue_stats(X.parse_jobs(s, d), X.file_records(s, d))


@query("SELECT count(*) FILTER (kind IS DISTINCT FROM 'caption') AS text, count(*) FILTER (kind = 'caption') AS visual FROM chunks")
def a4_vector_counts(s, d):
    return reports.vector_counts(X.chunks(s, d))


@query(f", c AS (SELECT count(*) FILTER (done_at BETWEEN {JOBS_NOW - 600_000} AND {JOBS_NOW}) AS completed, count(*) FILTER (done_at IS NULL AND locked_until IS NULL) AS pending FROM parse_jobs) SELECT completed, pending, round(completed / 10, 2) AS rate_per_min, CASE WHEN completed > 0 AND pending > 0 THEN floor(pending * 60 / round(completed / 10, 2))::BIGINT END AS eta_s FROM c")
def a5_throughput(s, d):
    return reports.throughput(X.parse_jobs(s, d), JOBS_NOW)


@query("SELECT id, done_at, count(*) OVER (ORDER BY done_at RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW) AS completed FROM parse_jobs WHERE done_at IS NOT NULL")
def a5_trailing_rate(s, d):
    return reports.trailing_rate(X.parse_jobs(s, d))


_REPORT = """, r AS (SELECT id AS root_id, enabled, count(*) FILTER (class <> 'extra') AS w, count(*) FILTER (class = 'missing') AS m, count(*) FILTER (class = 'stale') AS s, count(*) FILTER (class = 'extra') AS x, (SELECT count(*) FROM file_paths p WHERE p.root_id = id) AS local_files
  FROM inventory_roots LEFT JOIN diff ON diff.root_id = id GROUP BY id, enabled)
SELECT root_id, CASE WHEN NOT enabled THEN 'disabled' ELSE 'verified' END AS status, CASE WHEN enabled THEN w ELSE 0 END AS wiki_files, local_files, CASE WHEN enabled THEN m ELSE 0 END AS missing, CASE WHEN enabled THEN s ELSE 0 END AS stale,
       CASE WHEN enabled THEN x ELSE 0 END AS extra, CASE WHEN enabled AND w = 0 AND local_files > 0 THEN x ELSE 0 END AS extra_skipped FROM r"""


@query(f", {_DIFF}{_REPORT}")
def a6_verify_report(s, d):
    return verify.verify_report(verify.diff_ledger(X.inventory_files(s, d), X.file_paths(s, d)), X.inventory_roots(s, d), X.file_paths(s, d))


@query("SELECT file_id, min(mtime_ms) AS mtime_ms FROM file_paths GROUP BY file_id")
def a7_earliest_mtime(s, d):
    return reports.earliest_mtime(X.file_paths(s, d))


@query("SELECT file_id, bool_or(indexable) AS indexable FROM file_paths GROUP BY file_id")
def a8_file_indexable(s, d):
    return routing.indexable(X.file_paths(s, d), X.allowlist(s), X.rules(s)).groupBy("file_id").agg(F.bool_or("indexable").alias("indexable"))


_POLLUTED = "bad AS (SELECT r.file_id, array_to_string(list_sort(list(DISTINCT ext)), ',') AS exts, count(*) AS n_paths, min(path) AS sample_path, any_value(vector_count) AS vector_count, any_value(size) AS size FROM file_records r JOIN file_paths p ON p.file_id = r.file_id WHERE tombstoned_at IS NULL GROUP BY r.file_id HAVING NOT bool_or(indexable))"


@query(f", {_POLLUTED} SELECT * FROM bad")
def a9_find_pollution(s, d):
    return reports.find_pollution(X.file_records(s, d), X.file_paths(s, d), X.allowlist(s)).withColumn("exts", F.array_join("exts", ","))


@query(f", {_POLLUTED} SELECT count(*) AS files, coalesce(sum(vector_count), 0)::BIGINT AS chunks, coalesce(sum(size), 0)::BIGINT AS bytes FROM bad")
def a9_pollution_totals(s, d):
    return reports.pollution_totals(reports.find_pollution(X.file_records(s, d), X.file_paths(s, d), X.allowlist(s)))


@query(", t AS (SELECT l_orderkey AS doc, l_partkey % 50 AS token, max(round(l_discount - 0.03, 2)) AS w FROM lineitem WHERE l_partkey % 50 > 3 AND round(l_discount - 0.03, 2) > 0 GROUP BY 1, 2) SELECT doc, string_agg(token || ':' || round(w * 100)::INT, ',' ORDER BY token) AS terms FROM t GROUP BY doc")
def a10_aggregate_sparse(s, d):
    out = inference.aggregate_sparse(X.token_weights(s, d), [0, 1, 2, 3])
    pairs = F.zip_with("indices", "values", lambda i, v: F.concat_ws(":", i.cast("string"), F.round(v * 100).cast("int").cast("string")))
    return out.select("doc", F.array_join(pairs, ",").alias("terms"))


# --- order and limits

W1_NOW = 978_307_200_000


@query(f"SELECT id, priority, attempts + 1 AS attempts, {W1_NOW + 300_000} AS locked_until, {W1_NOW} AS picked_at FROM parse_jobs WHERE done_at IS NULL AND (locked_until IS NULL OR locked_until < {W1_NOW}) ORDER BY priority, id LIMIT 500")
def w1_next_batch(s, d):
    return jobs.next_batch(X.parse_jobs(s, d), W1_NOW, 500).select("id", "priority", "attempts", "locked_until", "picked_at")


@query(f"SELECT file_id, size, {_STATUS}, coalesce({_PATHS.format('r.file_id')}, '') AS paths, (SELECT count(*) FROM file_records WHERE tombstoned_at IS NULL) AS total FROM (SELECT * FROM file_records WHERE tombstoned_at IS NULL ORDER BY size DESC, file_id DESC LIMIT 100 OFFSET 50) r")
def w2_list_files(s, d):
    page, total = reports.list_files(X.file_records(s, d), X.file_paths(s, d), X.parse_jobs(s, d), sort="size", limit=100, offset=50)
    return flat_paths(page).select("file_id", "size", "status", "paths").join(total)


@query(" UNION ALL ".join(f"(SELECT id, '{n}' AS status, path FROM parse_jobs WHERE {w} ORDER BY id DESC LIMIT 100)" for n, w in (("pending", "done_at IS NULL AND locked_until IS NULL"), ("running", "done_at IS NULL AND locked_until IS NOT NULL"), ("failed", "done_at IS NOT NULL AND last_error IS NOT NULL"))))
def w3_list_jobs(s, d):
    of = lambda n: jobs.list_jobs(X.parse_jobs(s, d), n, 100).select("id", F.lit(n).alias("status"), "path")
    return of("pending").unionByName(of("running")).unionByName(of("failed"))


@query(", t AS (SELECT l_orderkey AS doc, l_partkey % 50 AS i, max(round(l_discount - 0.03, 2)) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY abs(w) DESC, i) AS n FROM t) SELECT doc, string_agg(i || ':' || round(w * 100)::INT, ',' ORDER BY n) AS terms FROM r WHERE n <= 5 GROUP BY doc")
def w4_top_sparse_terms(s, d):
    best = X.token_weights(s, d).groupBy("doc", "token").agg(F.max("weight").alias("weight"))
    docs = best.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("p"))
    top = scalars.top_sparse_terms(F.col("p.token"), F.col("p.weight"))
    return docs.select("doc", F.array_join(F.transform(top, lambda t: F.concat_ws(":", t["index"].cast("string"), F.round(t["weight"] * 100).cast("int").cast("string"))), ",").alias("terms"))


# --- sets


@query("SELECT DISTINCT root_id, 'retire' AS plan FROM file_paths WHERE root_id NOT IN (SELECT id FROM inventory_roots) UNION ALL SELECT r, 'unknown' FROM (VALUES ('s18'), ('zz')) v(r) WHERE r NOT IN (SELECT id FROM inventory_roots)")
def o1_plan_roots(s, d):
    retire, _ = verify.plan_roots(X.file_paths(s, d), X.inventory_roots(s, d))
    _, unknown = verify.plan_roots(X.file_paths(s, d), X.inventory_roots(s, d), ["s1", "s18", "zz"])
    return retire.withColumn("plan", F.lit("retire")).unionByName(unknown.withColumn("plan", F.lit("unknown")))


@query("SELECT file_id, coalesce(array_to_string(list_sort(list(DISTINCT root_id) FILTER (root_id <> 's1')), ','), '') AS root_ids FROM file_paths GROUP BY file_id")
def o2_roots_left(s, d):
    left = F.array_except("root_ids", F.array(F.lit("s1")))
    return reports.root_ids(X.file_paths(s, d)).select("file_id", F.array_join(left, ",").alias("root_ids"))


@query("SELECT point_id, root_ids FROM chunks WHERE root_ids IN ('src1', 'r2')")
def o3_overlap(s, d):
    return X.chunks(s, d).filter(F.arrays_overlap("root_ids", F.array(F.lit("src1"), F.lit("r2")))).select("point_id", F.array_join("root_ids", ",").alias("root_ids"))


# --- scalars


@query("SELECT doc_id, sha256(text) AS sha256_full, left(sha256(text), 32) AS file_id FROM documents")
def f1_content_id(s, d):
    return X.table(s, d, "documents").select("doc_id", ids.sha256_hex(F.col("text")).alias("sha256_full"), ids.content_id(F.col("text")).alias("file_id"))


def _uuid_sql(ns: str, name: str) -> str:
    h = f"sha1(unhex('{ns.replace('-', '')}') || encode({name}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[instr('0123456789abcdef', h[17]) % 4 + CASE WHEN instr('0123456789abcdef', h[17]) % 4 = 0 THEN 4 ELSE 0 END] || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


@query(f"SELECT doc_id, {_uuid_sql(ids.OID, 'left(sha256(text), 32) || $$:body:$$ || (doc_id % 7)')} AS point_id, {_uuid_sql(ids.MEMORY, 'doc_id || $$:s:$$ || (doc_id % 5)')} AS memory_id FROM documents")
def f2_uuid5(s, d):
    k = F.col("doc_id")
    return X.table(s, d, "documents").select("doc_id", ids.point_id(ids.content_id(F.col("text")), k % 7).alias("point_id"), ids.memory_id(k, F.lit("s"), k % 5).alias("memory_id"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def f3_rough_tokens(s, d):
    return X.table(s, d, "documents").select("doc_id", scalars.rough_tokens(F.col("text")).alias("tokens"))


@query("SELECT asset_id, trim(caption, ' ' || chr(10) || chr(9)) || CASE WHEN taken IS NULL AND place IS NULL THEN '' ELSE chr(10) || 'Taken: ' || concat_ws(', ', taken, place) END AS text FROM assets")
def f4_caption_text(s, d):
    return X.assets(s, d).select("asset_id", scalars.caption_text(F.col("caption"), F.col("meta")).alias("text"))


@query("SELECT source || ':' || asset_id AS file_id FROM assets")
def f5_asset_file_id(s, d):
    return X.assets(s, d).select(ids.asset_file_id(F.col("source"), F.col("asset_id")).alias("file_id"))


@query("SELECT chunk_no, round(sqrt(list_sum(list_transform(dense, lambda x: x * x))), 6) AS norm, round(dense[1] / sqrt(list_sum(list_transform(dense, lambda x: x * x))), 6) AS first FROM memory")
def f6_l2_normalize(s, d):
    return X.memory(s, d).select("chunk_no", F.round(scalars.norm(F.col("dense")), 6).alias("norm"), F.round(scalars.l2_normalize(F.col("dense"))[0], 6).alias("first"))


@query("SELECT a.chunk_no, round(list_cosine_similarity(a.dense, b.dense), 6) AS score FROM memory a JOIN memory b ON b.chunk_no = a.chunk_no + 1")
def f7_cosine(s, d):
    a = X.memory(s, d).select("chunk_no", "dense")
    b = a.select((F.col("chunk_no") - 1).alias("chunk_no"), F.col("dense").alias("other"))
    return a.join(b, "chunk_no").select("chunk_no", F.round(scalars.cosine(F.col("dense"), F.col("other")), 6).alias("score"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 10)), 6) AS score FROM events")
def f8_sigmoid(s, d):
    return X.table(s, d, "events").select("event_id", F.round(scalars.sigmoid(F.col("value") / 10), 6).alias("score"))


@query("SELECT file_id, CASE modalities_done WHEN '{\"text\":\"hash/v1\"}' THEN 'hash/v1' WHEN '{\"text\":\"hash/v2\"}' THEN 'hash/v2' WHEN '{\"text\":\"hash/v1\",\"image\":\"x\"}' THEN 'hash/v1' END AS text_model, CASE modalities_done WHEN '{\"text\":\"hash/v1\",\"image\":\"x\"}' THEN 2 WHEN '{}' THEN 0 WHEN 'not json' THEN 0 ELSE 1 END AS n FROM file_records")
def f9_parse_modalities(s, d):
    m = scalars.parse_modalities(F.col("modalities_done"))
    return X.file_records(s, d).select("file_id", m["text"].alias("text_model"), F.size(m).alias("n"))


# --- chunking


def chunk_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode("chunks").alias("c")).select(*keys, "c.*")


#: Packing by recursion: a stretch ends at the last line end that fits, and the next one starts with its tail.
_PACKED = f""", lines AS (SELECT doc_id, text, length(text) AS n, list_sort(list_distinct(list_append(list_filter(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN text[i] = chr(10) THEN i END), lambda x: x IS NOT NULL), length(text)))) AS ends FROM documents WHERE length(text) > 0),
packed AS (
  SELECT doc_id, text, n, ends, 0::BIGINT AS start, greatest(1, len(list_filter(ends, lambda x: x < {4 * (chunking.TARGET + 1)}))) AS taken FROM lines
  UNION ALL
  SELECT doc_id, text, n, ends, s, greatest(taken + 1, len(list_filter(ends, lambda x: x < s + {4 * (chunking.TARGET + 1)})))
  FROM (SELECT *, CASE WHEN ends[taken] - start > {4 * chunking.OVERLAP} THEN ends[taken] - {4 * chunking.OVERLAP} ELSE start END AS s FROM packed WHERE taken < len(ends))),
stretches AS (SELECT doc_id, start, taken = len(ends) AS last, n, ends[taken] AS stop, trim(text[start + 1:ends[taken]], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM packed) """


@query(_PACKED + """SELECT doc_id, (row_number() OVER w - 1)::INT AS chunk_no, text, start::INT AS offset_start, CASE WHEN last THEN n ELSE stop END::INT AS offset_end, '' AS section, (row_number() OVER w - 1)::INT AS section_no
FROM stretches WHERE text <> '' AND greatest(1, length(text) // 4) >= 5 WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop)""")
def c1_chunk_plain(s, d):
    return chunk_rows(chunking.chunk_plain_texts(X.table(s, d, "documents").select("doc_id", "text")), "doc_id")


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sections(texts: str, where: str) -> str:
    """SQL of the lines of `texts` (doc_id, text), with where each begins, and whether it begins a section."""
    return f"""texts AS ({texts}),
split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM texts),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos0, {where} AS begins FROM lines)"""


#: Sections by heading; a heading's path has the last one of each smaller depth that no shallower one has come after.
_MD_SECTIONS = _sections("SELECT doc_id, '# ' || source || chr(10) || chr(10) || replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '## Part' || chr(10) || chr(10) ELSE chr(10) || chr(10) END) AS text FROM documents", "regexp_matches(line, '^#{1,6}\\s+.+$')") + f""",
heads AS (SELECT doc_id, pos0, length(regexp_extract(line, '^(#+)', 1)) AS depth, trim(regexp_extract(line, '^#+\\s+(.+)$', 1), {_BLANKS}) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS h FROM placed WHERE begins),
last AS (SELECT *, {", ".join(f"coalesce(max(CASE WHEN depth = {n} THEN h END) OVER (PARTITION BY doc_id ORDER BY h), 0) AS l{n}" for n in range(1, 7))}, list(title) OVER (PARTITION BY doc_id ORDER BY h) AS titles, lead(pos0) OVER (PARTITION BY doc_id ORDER BY h) AS next FROM heads),
ways AS (SELECT doc_id, h, pos0, next, list_filter([{", ".join(f"CASE WHEN depth >= {n} AND l{n} > greatest(0{''.join(f', l{m}' for m in range(1, n))}) THEN titles[l{n}] END" for n in range(1, 7))}], lambda t: t IS NOT NULL) AS way FROM last),
secs AS (
  SELECT t.doc_id, h, pos0 AS first, coalesce(next, length(text)) AS stop, array_to_string(way, ' > ') AS title, text[pos0 + 1:coalesce(next, length(text))] AS body FROM ways w JOIN texts t ON t.doc_id = w.doc_id
  UNION ALL SELECT t.doc_id, 0, 0, pos0, '', text[1:pos0] FROM ways w JOIN texts t ON t.doc_id = w.doc_id WHERE h = 1 AND trim(text[1:pos0], {_BLANKS}) <> '')"""
#: Sections by block of source code, titled by their first line.
_SRC_SECTIONS = _sections("SELECT doc_id, 'def f' || doc_id || '():' || chr(10) || replace(text, chr(10), chr(10) || 'class C:' || chr(10) || '  ') AS text FROM documents", "i > 1 AND regexp_matches(line, '^(def |class |async def |func |fn |type |impl )')") + f""",
secs AS (
  SELECT t.doc_id, h, first, stop, left(trim(string_split(ltrim(text[first + 1:stop], {_BLANKS}), chr(10))[1], {_BLANKS}), {chunking.TITLE}) AS title, text[first + 1:stop] AS body
  FROM (SELECT doc_id, pos0 AS first, row_number() OVER w AS h, lead(pos0) OVER w AS next FROM placed WHERE begins OR i = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY pos0)) p
  JOIN (SELECT *, length(text) AS n FROM texts) t ON t.doc_id = p.doc_id, LATERAL (SELECT coalesce(next, n) AS stop) WHERE stop > first)"""


def _chunks_of(sections: str, least: int, number: str) -> str:
    """SQL of the chunks of secs (doc_id, h, first, stop, title, body): a section that fits is one, a longer one is packed by recursion
    along its paragraphs, or else its lines. number: of the section a chunk is in."""
    target, keep = chunking.TARGET, 4 * chunking.OVERLAP
    return f""", {sections},
sized AS (SELECT *, length(body) AS n, trim(body, {_BLANKS}) AS whole, row_number() OVER (PARTITION BY doc_id ORDER BY h) - 1 AS ordinal FROM secs),
fine AS (SELECT *, greatest(1, length(whole) // 4) AS tokens FROM sized WHERE whole <> '' AND greatest(1, length(whole) // 4) >= {least}),
parts AS (SELECT doc_id, h, first, stop, n, body, regexp_extract_all(body, '\\n\\s*\\n') AS seps, string_split_regex(body, '\\n\\s*\\n') AS paras, string_split(body, chr(10)) AS rows FROM fine WHERE tokens > {target}),
cuts AS (SELECT doc_id, h, first, stop, n, body, CASE WHEN len(seps) > 0
    THEN list_transform(range(1, len(seps) + 1), lambda i: list_sum(list_transform(paras[1:i], lambda x: length(x))) + list_sum(list_transform(seps[1:i], lambda x: length(x))))
    ELSE list_transform(range(1, len(rows)), lambda i: list_sum(list_transform(rows[1:i], lambda x: length(x) + 1))) END AS found FROM parts),
ended AS (SELECT doc_id, h, first, stop, n, body, list_sort(list_distinct(list_append(list_transform(found, lambda x: x::BIGINT), n))) AS ends FROM cuts),
packed AS (
  SELECT doc_id, h, first, stop, n, body, ends, 0::BIGINT AS start, greatest(1, len(list_filter(ends, lambda x: x < {4 * (target + 1)}))) AS taken FROM ended
  UNION ALL
  SELECT doc_id, h, first, stop, n, body, ends, s, greatest(taken + 1, len(list_filter(ends, lambda x: x < s + {4 * (target + 1)})))
  FROM (SELECT *, CASE WHEN ends[taken] - start > {keep} THEN ends[taken] - {keep} ELSE start END AS s FROM packed WHERE taken < len(ends))),
pieces AS (
  SELECT doc_id, h, first + start AS offset_start, CASE WHEN taken = len(ends) THEN stop ELSE first + ends[taken] END AS offset_end, trim(body[start + 1:ends[taken]], {_BLANKS}) AS text, taken FROM packed
  UNION ALL SELECT doc_id, h, first, stop, whole, 0 FROM fine WHERE tokens <= {target}),
kept AS (SELECT * FROM pieces WHERE text <> '' AND greatest(1, length(text) // 4) >= {least})
SELECT k.doc_id, (row_number() OVER (PARTITION BY k.doc_id ORDER BY k.h, taken) - 1)::INT AS chunk_no, k.text, k.offset_start::INT AS offset_start, k.offset_end::INT AS offset_end, title AS section, ({number})::INT AS section_no
FROM kept k JOIN sized s ON s.doc_id = k.doc_id AND s.h = k.h"""


@query(_chunks_of(_MD_SECTIONS, 2, "ordinal"))
def c2_chunk_markdown(s, d):
    return chunk_rows(chunking.chunk_markdown_texts(X.md_files(s, d)), "doc_id")


@query(_chunks_of(_SRC_SECTIONS, 5, "dense_rank() OVER (PARTITION BY k.doc_id ORDER BY k.h) - 1"))
def c3_chunk_source(s, d):
    return chunk_rows(chunking.chunk_source_texts(X.src_files(s, d)), "doc_id")


def _routed_chunks(texts: str) -> str:
    """SQL of the chunks of texts (key, ext, text; no headings, blocks, blank lines or markup in them): by route, with markup's converter
    leaving one line."""
    target, keep = chunking.TARGET, 4 * chunking.OVERLAP
    return f"""read AS (SELECT key, CASE WHEN ext = '.html' THEN array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') ELSE text END AS text, CASE WHEN ext = '.py' THEN {chunking.LEAST["source"]} ELSE {chunking.LEAST["plain"]} END AS least FROM ({texts}) WHERE ext <> '.pdf' AND strlen(text) <= {routing.MAX_FILE_BYTES}),
torn AS (SELECT key, text, least, length(text) AS n, string_split(text, chr(10)) AS rows FROM read WHERE text <> ''),
ended AS (SELECT key, text, least, n, list_sort(list_distinct(list_append(list_transform(range(1, len(rows)), lambda i: list_sum(list_transform(rows[1:i], lambda x: length(x) + 1))::BIGINT), n))) AS ends FROM torn),
packed AS (
  SELECT key, text, least, n, ends, 0::BIGINT AS start, greatest(1, len(list_filter(ends, lambda x: x < {4 * (target + 1)}))) AS taken FROM ended
  UNION ALL
  SELECT key, text, least, n, ends, s, greatest(taken + 1, len(list_filter(ends, lambda x: x < s + {4 * (target + 1)})))
  FROM (SELECT *, CASE WHEN ends[taken] - start > {keep} THEN ends[taken] - {keep} ELSE start END AS s FROM packed WHERE taken < len(ends))),
pieces AS (SELECT key, least, start, taken, CASE WHEN taken = len(ends) THEN n ELSE ends[taken] END AS stop, trim(text[start + 1:ends[taken]], {_BLANKS}) AS text FROM packed),
made AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY taken) - 1)::INT AS chunk_no, text, start::INT AS offset_start, stop::INT AS offset_end FROM pieces WHERE text <> '' AND greatest(1, length(text) // 4) >= least)"""


@query(f""", {_routed_chunks("SELECT path AS key, ext, content AS text FROM files")}
SELECT path, CASE WHEN ext IN ('.html', '.pdf') THEN 'docling' WHEN ext = '.md' THEN 'markdown' WHEN ext = '.py' THEN 'source' ELSE 'plain' END AS route, chunk_no, text, offset_start, offset_end, '' AS section, chunk_no AS section_no FROM made JOIN files ON key = path""")
def c4_chunk_files(s, d):
    return chunk_rows(chunking.chunk_routed(converted(X.files(s, d).select("path", "size", "content"))), "path", "route")


_STORED = "CASE WHEN size > 4194304 THEN 'application/x-too-large/' || ext[2:] WHEN ext = '.html' THEN 'text/markdown+docling/html' WHEN ext = '.pdf' THEN 'application/octet-stream/pdf' WHEN ext = '.md' THEN 'text/markdown' WHEN ext = '.py' THEN 'text/x-source' ELSE 'text/plain' END"


@query(f""", chosen AS (SELECT file_id, any_value(content) AS text, any_value(size) AS size, arg_min(ext, (path, root_id)) AS ext, arg_min(mtime_ms, (path, root_id)) AS mtime_ms, array_to_string(list_sort(list(DISTINCT root_id)), ',') AS root_ids FROM fine_files WHERE indexable GROUP BY file_id),
{_routed_chunks("SELECT file_id AS key, ext, text FROM chosen")}
SELECT {_uuid_sql(ids.OID, "file_id || $$:body:$$ || chunk_no")} AS point_id, file_id, root_ids, 'body' AS kind, {_STORED} AS mime, chunk_no, {_uuid_sql(ids.OID, "file_id || $$:section:$$ || chunk_no")} AS parent_id, '' AS section, chunk_no AS section_no, made.text, offset_start, offset_end,
  'auto' AS lang, '{VERSION}' AS parser_version, 'hash/v1' AS embed_model_version, {NOW}::BIGINT AS indexed_at, mtime_ms, NULL::BIGINT AS tombstoned_at FROM made JOIN chosen ON key = file_id""")
def c5_build_chunks(s, d):
    return index_files(X.files(s, d), X.allowlist(s), X.rules(s), VERSION, "hash/v1", NOW).withColumn("root_ids", F.array_join("root_ids", ","))


@query(", fine AS (SELECT * FROM fine_files WHERE indexable) SELECT file_id, min(path) AS path, count(*) AS n_paths, array_to_string(list_sort(list(DISTINCT root_id)), ',') AS root_ids FROM fine GROUP BY file_id")
def flagship_index(s, d):
    """The files of a batch by content: one copy, its paths and roots (the whole plan is flagship_batch)."""
    rows = ledger.identified(routing.indexable(X.files(s, d), X.allowlist(s), X.rules(s)).filter("indexable"))
    return ledger.dedup_files(rows.select("file_id", "root_id", "path", "size", "mtime_ms")).select("file_id", "path", "n_paths", F.array_join("root_ids", ",").alias("root_ids"))


#: Unknown files, outdated ones, dead ones, and paths that had another file before, told of the documents.
_BEFORE = f""", batch AS (SELECT * FROM fine_files WHERE doc_id % 13 NOT IN (0, 1, 2)),
old_paths AS (SELECT root_id, path, CASE WHEN doc_id % 3 = 0 THEN file_id ELSE 'old' || (doc_id % 10) END AS file_id FROM fine_files WHERE doc_id % 3 < 2 UNION ALL SELECT 'other', path, 'old' || (doc_id % 10) FROM fine_files WHERE doc_id % 97 = 5),
old_records AS (SELECT DISTINCT file_id, left(file_id, 1) < '8' AS current, left(file_id, 1) IN ('0', '1') AS dead FROM fine_files WHERE doc_id % 2 = 0 UNION ALL SELECT DISTINCT 'old' || (doc_id % 10), true, false FROM fine_files),
new_paths AS (SELECT root_id, path, file_id FROM batch UNION ALL SELECT root_id, path, file_id FROM old_paths o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.root_id = o.root_id AND b.path = o.path)),
lost AS (SELECT DISTINCT o.file_id FROM old_paths o JOIN batch b ON b.root_id = o.root_id AND b.path = o.path WHERE o.file_id <> b.file_id AND o.file_id NOT IN (SELECT file_id FROM new_paths)),
work AS (SELECT b.file_id, any_value(size) AS size, min(path) AS any_path, bool_or(indexable) AND NOT coalesce(bool_or(r.current), false) AS indexed, arg_min(ext, (NOT indexable, doc_id)) AS ext, arg_min(b.ext, path) AS first_ext FROM batch b LEFT JOIN old_records r ON r.file_id = b.file_id GROUP BY b.file_id)
"""


def before_batch(s: SparkSession, d: str) -> ledger.Ledger:
    """What the ledger knows of the documents' files before a batch of them comes."""
    k, lead = F.col("doc_id"), F.substring("file_id", 1, 1)
    rows = ledger.identified(X.files(s, d)).drop("content")
    old = F.concat(F.lit("old"), k % 10)
    was = rows.filter(k % 3 < 2).select("root_id", "path", F.when(k % 3 == 0, F.col("file_id")).otherwise(old).alias("file_id"), F.lit(1).cast("long").alias("mtime_ms"))
    was = was.unionByName(rows.filter("doc_id % 97 = 5").select(F.lit("other").alias("root_id"), "path", old.alias("file_id"), F.lit(1).cast("long").alias("mtime_ms")))
    known = rows.filter("doc_id % 2 = 0").select("file_id", F.when(lead < "8", VERSION).otherwise("parser/0.2.0").alias("parser_version"), F.when(lead.isin("0", "1"), 1).cast("long").alias("tombstoned_at")).distinct()
    known = known.unionByName(rows.select(old.alias("file_id"), F.lit(VERSION).alias("parser_version"), F.lit(None).cast("long").alias("tombstoned_at")).distinct())
    nothing = F.lit(None).cast("string")
    records = known.select("file_id", F.col("file_id").alias("sha256_full"), F.lit(1).cast("long").alias("size"), F.lit("old").alias("mime"), F.lit('{"text":"hash/v1"}').alias("modalities_done"), "parser_version", F.lit(1).cast("long").alias("indexed_at"), "tombstoned_at", F.lit(1).cast("long").alias("vector_count"), nothing.alias("last_error"))
    chunks = known.select(ids.point_id(F.col("file_id"), F.lit(0)).alias("point_id"), "file_id", F.array(F.lit("before")).alias("root_ids"), F.lit("body").alias("kind"), F.lit(0).alias("chunk_no"), F.lit("before").alias("text"), "tombstoned_at", F.lit(None).cast("array<float>").alias("dense"))
    return ledger.Ledger(stored(records), stored(was), stored(chunks))


@query(_BEFORE + f"""SELECT 'record' AS kind, w.file_id AS name, CASE WHEN indexed THEN {_STORED} WHEN r.file_id IS NOT NULL THEN 'old' ELSE {_MIME.replace("CASE ext", "CASE first_ext")} END || ' ' || CASE WHEN indexed OR r.file_id IS NULL THEN '{VERSION}' WHEN r.current THEN '{VERSION}' ELSE 'parser/0.2.0' END || ' -' AS value FROM work w LEFT JOIN old_records r ON r.file_id = w.file_id
UNION ALL SELECT 'record', r.file_id, 'old ' || CASE WHEN current THEN '{VERSION}' ELSE 'parser/0.2.0' END || ' ' || CASE WHEN r.file_id IN (SELECT file_id FROM lost) THEN '{NOW}' WHEN dead THEN '1' ELSE '-' END FROM old_records r WHERE r.file_id NOT IN (SELECT file_id FROM work)
UNION ALL SELECT 'path', root_id || '|' || path, file_id FROM new_paths""")
def flagship_batch(s, d):
    """The flagship in one plan: a batch of files through gate, identity, conversion, chunks and vectors into the ledger. Told are the
    records and paths after it (the chunks are in flagship_chunks)."""
    out = index_batch(before_batch(s, d), X.files(s, d), X.allowlist(s), X.rules(s), VERSION, "hash/v1", NOW, encoder=inference.hash_encoder(16)).ledger
    dead = F.coalesce(F.col("tombstoned_at").cast("string"), F.lit("-"))
    told = out.records.select(F.lit("record").alias("kind"), F.col("file_id").alias("name"), F.concat_ws(" ", "mime", "parser_version", dead).alias("value"))
    return told.union(out.paths.select(F.lit("path"), F.concat_ws("|", "root_id", "path"), "file_id"))


@query(_BEFORE + f""", {_routed_chunks("SELECT w.file_id AS key, w.ext, f.text FROM work w JOIN (SELECT file_id, any_value(content) AS text FROM files GROUP BY file_id) f ON f.file_id = w.file_id WHERE indexed")},
roots AS (SELECT file_id, array_to_string(list_sort(list(DISTINCT root_id)), ',') AS root_ids FROM new_paths GROUP BY file_id),
moved AS (SELECT DISTINCT o.file_id FROM old_paths o JOIN batch b ON b.root_id = o.root_id AND b.path = o.path WHERE o.file_id <> b.file_id AND NOT EXISTS (SELECT 1 FROM new_paths n WHERE n.file_id = o.file_id AND n.root_id = o.root_id)),
changed AS (SELECT file_id FROM moved UNION SELECT b.file_id FROM batch b LEFT JOIN old_records r ON r.file_id = b.file_id GROUP BY b.file_id HAVING count(*) > 1 OR coalesce(bool_or(r.current), false))
SELECT {_uuid_sql(ids.OID, "key || $$:body:$$ || chunk_no")} AS point_id, key AS file_id, root_ids, chunk_no, text, NULL::BIGINT AS tombstoned_at, 16 AS dim FROM made JOIN roots ON roots.file_id = key
UNION ALL SELECT {_uuid_sql(ids.OID, "r.file_id || $$:body:0$$")}, r.file_id, CASE WHEN r.file_id IN (SELECT file_id FROM changed) THEN coalesce(root_ids, '') ELSE 'before' END, 0, 'before', CASE WHEN r.file_id IN (SELECT file_id FROM changed) THEN CASE WHEN root_ids IS NULL THEN {NOW} END WHEN dead THEN 1 END, NULL FROM old_records r LEFT JOIN roots ON roots.file_id = r.file_id WHERE r.file_id NOT IN (SELECT key FROM made)""")
def flagship_chunks(s, d):
    """The chunks that flagship_batch leaves, with their vectors."""
    out = index_batch(before_batch(s, d), X.files(s, d), X.allowlist(s), X.rules(s), VERSION, "hash/v1", NOW, encoder=inference.hash_encoder(16)).ledger
    return out.chunks.select("point_id", "file_id", F.array_join("root_ids", ",").alias("root_ids"), "chunk_no", "text", "tombstoned_at", F.array_size("dense").alias("dim"))


# --- inference


@query(_PACKED + """, told AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS chunk_no, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS words
FROM stretches WHERE text <> '' AND greatest(1, length(text) // 4) >= 5 WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop)) SELECT doc_id, chunk_no, CASE WHEN len(words) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, len(words)::INT AS n_terms FROM told""")
def e1_embed(s, d):
    rows = chunk_rows(chunking.chunk_plain_texts(X.table(s, d, "documents").select("doc_id", "text")), "doc_id").select("doc_id", "chunk_no", "text")
    out = inference.embed(rows, inference.hash_encoder(64))
    return out.select("doc_id", "chunk_no", F.round(scalars.norm(F.col("dense")), 4).alias("norm"), F.size("sparse.indices").alias("n_terms"))


def conversation_pairs(s, d):
    t = X.table(s, d, "conversations")
    q = t.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query_text"))
    return q.join(t.filter("role = 'assistant'"), "conv_id").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("candidate_id"), "query_text", "text")


#: The stand-in scorer: the share of the query's distinct words that the text has.
_WORDS = "list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '\\s+'), lambda w: w <> ''))"
_SIGMOID = "1 / (1 + exp(-({0})))"


@query(f""", asked AS (SELECT conv_id, {_WORDS.format("text")} AS q FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
scored AS (SELECT c.conv_id AS query_id, c.turn AS candidate_id, {_SIGMOID.format(f"CASE WHEN len(q) = 0 THEN -2.0 ELSE 4.0::DOUBLE * len(list_intersect(q, {_WORDS.format('c.text')})) / len(q) - 2.0 END")} AS score FROM asked JOIN conversations c ON c.conv_id = asked.conv_id WHERE c.role = 'assistant')
SELECT query_id, candidate_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM scored QUALIFY rank <= 10""")
def e2_rerank(s, d):
    # a turn comes once in a conversation, so that a run of CANDIDATES turns is a request at most
    request = F.floor(F.col("candidate_id") / inference.CANDIDATES)
    return inference.rerank(conversation_pairs(s, d), inference.overlap_scorer(), 10, request).select("query_id", "candidate_id", F.round("rerank_score", 6).alias("score"), "rank")


@query(f""", photos AS (SELECT 'photos:' || asset_id AS file_id, trim(caption, ' ' || chr(10) || chr(9)) || CASE WHEN taken IS NULL AND place IS NULL THEN '' ELSE chr(10) || 'Taken: ' || concat_ws(', ', taken, place) END AS text FROM assets WHERE source = 'photos')
SELECT point_id, file_id, kind, d.text, NULL::INT AS dim FROM chunks c JOIN documents d ON c.point_id = 'pt' || lpad(d.doc_id::VARCHAR, 12, '0') WHERE kind = 'caption' AND NOT EXISTS (SELECT 1 FROM photos p WHERE p.file_id = c.file_id)
UNION ALL SELECT {_uuid_sql(ids.OID, "file_id || $$:caption:0$$")}, file_id, 'caption', text, 16 FROM photos""")
def e3_ingest_captions(s, d):
    old = X.chunks(s, d).filter("kind = 'caption'").select("point_id", "file_id", "root_ids", "kind", "text", "mtime_ms", "tombstoned_at")
    out = inference.ingest_captions(old, X.assets(s, d).filter("source = 'photos'"), inference.hash_encoder(16), NOW)
    return out.select("point_id", "file_id", "kind", "text", F.array_size("dense").alias("dim"))


# --- vector search


_POINTS = f""", points AS (SELECT user_id, session_id, chunk_no // 20 AS chunk_no, text, dense, created_at, {_uuid_sql(ids.MEMORY, "user_id || $$:$$ || session_id || $$:$$ || (chunk_no // 20)")} AS point_id FROM memory),
note_points AS (SELECT user_id, note_id, chunk_no % 3 AS chunk_no, 'v' || chunk_no AS text, type, status, chunk_no * 1000 AS updated_at, dense, {_uuid_sql(ids.MEMORY, "$$note:$$ || user_id || $$:$$ || note_id || $$:$$ || (chunk_no % 3)")} AS point_id FROM notes) """
_TOP = "SELECT query_id, {0}, round(score, 6) AS score, rank FROM (SELECT q.query_id, m.*, list_cosine_similarity(q.dense, m.dense) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.dense, m.dense) DESC, m.point_id) AS rank FROM memory_queries q JOIN {1} m ON m.user_id = q.user_id{2}) WHERE rank <= {3}"


@query("SELECT query_id, (SELECT count(*) FROM memory m WHERE m.user_id = q.user_id) AS candidates FROM memory_queries q")
def j7_candidates(s, d):
    return search.candidate_counts(X.memory_queries(s, d), X.memory_points(s, d))


@query(_POINTS + _TOP.format("point_id, session_id, chunk_no, text, created_at", "points", "", 5))
def v1_query_memory(s, d):
    return search.query_memory(X.memory_queries(s, d), X.memory_points(s, d), 5).select("query_id", "point_id", "session_id", "chunk_no", "text", "created_at", F.round("score", 6).alias("score"), "rank")


@query(_POINTS + _TOP.format("point_id, note_id, chunk_no, text, type, status, updated_at", "note_points", " AND m.status IN ('open', 'old') AND m.type = 'fact'", 10))
def v2_query_notes(s, d):
    return search.query_notes(X.memory_queries(s, d), X.note_points(s, d), 10, ["open", "old"], ["fact"]).select("query_id", "point_id", "note_id", "chunk_no", "text", "type", "status", "updated_at", F.round("score", 6).alias("score"), "rank")


@query("SELECT q.query_id, m.chunk_no, round(list_cosine_similarity(q.dense, m.dense), 6) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.dense, m.dense) DESC, m.chunk_no) AS rank FROM memory_queries q JOIN memory m ON m.chunk_no % 20 = (q.query_id // 50) % 20")
def v3_score_chunks(s, d):
    # the queries' ids are multiples of 50: taken in turn they meet all 20 documents
    q = X.memory_queries(s, d).select("query_id", F.expr("query_id div 50 % 20").alias("session_id"), "dense")
    return search.score_chunks(q, X.memory(s, d), "session_id").select("query_id", "chunk_no", scalars.rounded(F.col("score"), 6).alias("score"), "rank")


@query(f""", ranked AS (SELECT q.query_id, m.chunk_no, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.dense, m.dense) DESC, m.chunk_no) AS rank FROM memory_queries q JOIN memory m ON m.chunk_no // 200 = q.query_id // 200),
again AS (SELECT *, CASE WHEN rank <= {search.RERANKED} THEN {_SIGMOID.format("CASE WHEN query_id = chunk_no THEN 2.0 ELSE -2.0 END")} END AS score FROM ranked)
SELECT query_id, chunk_no, rank, row_number() OVER (PARTITION BY query_id ORDER BY (rank > {search.RERANKED})::INT, score DESC, rank) AS final_rank, round(score, 6) AS rerank_score FROM again""")
def v4_retrieve_rerank(s, d):
    # documents of 200 chunks, each asked by its own queries: the queries' ids have only two residues of the 20 sessions
    group = lambda v: F.expr(f"{v} div 200")
    q = X.memory_queries(s, d).select("query_id", group("query_id").alias("session_id"), "dense", F.concat(F.lit("v"), "query_id").alias("query_text"))
    chunks = X.memory(s, d).withColumn("session_id", group("chunk_no"))
    return search.retrieve_rerank(q, chunks, inference.overlap_scorer(), "session_id").select("query_id", "chunk_no", "rank", "final_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("SELECT chunk_no, 1::BIGINT AS token_count, array_to_string(list_transform(dense[1:8], lambda x: round(x * 10000)::INT::VARCHAR), ',') AS head FROM memory")
def v5_preview_chunks(s, d):
    out = chunking.preview_chunks(X.memory(s, d))
    return out.select("chunk_no", "token_count", joined(F.transform("dense_head", lambda x: F.round(x * 10000).cast("int"))).alias("head"))


# --- upserts


def upserted_chunks(s, d):
    # laid out by file, as an upsert's result would be for the next one: the join leaves the old side where it is
    rows = X.chunks(s, d).select("point_id", "file_id", "text")
    old = layout.clustered(rows, "file_id", max(16, -(-rows.count() // 100_000)))
    new = old.filter("point_id like '%3'").select(F.concat(F.lit("n"), "point_id").alias("point_id"), "file_id", F.lit("new").alias("text"))
    return upserts.upsert_chunks(old, new)


@query("SELECT point_id, file_id, sha256(text) AS text_sha256 FROM chunks WHERE file_id NOT IN (SELECT file_id FROM chunks WHERE point_id LIKE '%3') UNION ALL SELECT 'n' || point_id, file_id, sha256('new') FROM chunks WHERE point_id LIKE '%3'")
def u1_upsert_chunks(s, d):
    return hashed(upserted_chunks(s, d))


@query("SELECT conv_id || '.' || turn AS point_id, CASE WHEN turn = 0 THEN 'new' ELSE text END AS text FROM conversations")
def u2_upsert_memory(s, d):
    old = X.table(s, d, "conversations").select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("point_id"), "text")
    new = old.filter("point_id like '%.0'").withColumn("text", F.lit("new")).unionByName(s.createDataFrame([("blank.0", " ")], "point_id string, text string"))
    return upserts.upsert_memory(old, new)


@query("SELECT chunk_no AS point_id, user_id, note_id, 'old' AS text FROM notes n WHERE (user_id, note_id) NOT IN (SELECT (user_id, note_id) FROM notes WHERE chunk_no % 10 = 0) UNION ALL SELECT chunk_no, user_id, note_id, 'new' FROM notes WHERE chunk_no % 20 = 0")
def u3_upsert_notes(s, d):
    old = X.notes(s, d).select(F.col("chunk_no").alias("point_id"), "user_id", "note_id", F.lit("old").alias("text"))
    new = old.filter("point_id % 10 = 0").withColumn("text", F.when(F.col("point_id") % 20 == 0, "new").otherwise(" "))
    return upserts.upsert_notes(old, new)


@query("SELECT file_id, 'old' AS text FROM chunks WHERE kind = 'caption' AND file_id NOT IN (SELECT file_id FROM chunks WHERE point_id LIKE '%2') UNION ALL SELECT file_id, 'new' FROM chunks WHERE kind = 'caption' AND point_id LIKE '%2'")
def u4_upsert_captions(s, d):
    old = X.chunks(s, d).filter("kind = 'caption'")
    return upserts.upsert_captions(old.select("file_id", F.lit("old").alias("text")), old.filter("point_id like '%2'").select("file_id", F.lit("new").alias("text")))


@query("SELECT 'memory' AS kind, chunk_no FROM memory WHERE NOT (user_id % 2 = 0 AND session_id % 3 = 0) UNION ALL SELECT 'note', chunk_no FROM notes WHERE NOT (user_id = 1 AND note_id % 2 = 0)")
def u5_delete(s, d):
    m, n = X.memory(s, d), X.notes(s, d)
    left = upserts.delete_memory(m, m.filter("user_id % 2 = 0 and session_id % 3 = 0").select("user_id", "session_id"))
    notes = upserts.delete_note(n, n.filter("user_id = 1 and note_id % 2 = 0").select("user_id", "note_id"))
    return left.select(F.lit("memory").alias("kind"), "chunk_no").unionByName(notes.select(F.lit("note").alias("kind"), "chunk_no"))


@query(f"SELECT chunk_no, file_id, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'a,b' ELSE 's0' END AS root_ids, CASE WHEN k % 3 = 0 THEN {NOW} WHEN k % 3 = 1 THEN NULL ELSE tombstoned_at END AS tombstoned_at FROM (SELECT *, substr(file_id, 2)::BIGINT AS k FROM ledger_chunks)")
def u6_set_chunk_roots(s, d):
    k = F.substring("file_id", 2, 20).cast("long")
    u = X.file_records(s, d).filter(k % 3 < 2).select("file_id", F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("new_roots"), F.lit(NOW).cast("long").alias("at"))
    return upserts.set_chunk_roots(X.ledger_chunks(s, d), u).select("chunk_no", "file_id", F.array_join("root_ids", ",").alias("root_ids"), "tombstoned_at")


@query("SELECT file_id, sha256_full, CASE WHEN k % 4 = 0 THEN 7 ELSE size END AS size, CASE WHEN k % 4 = 0 THEN 'new' ELSE mime END AS mime, CASE WHEN k % 4 <> 0 THEN tombstoned_at END AS tombstoned_at, vector_count, last_error FROM (SELECT *, substr(file_id, 2)::BIGINT AS k FROM file_records) UNION ALL SELECT 'x' || p_partkey, 'sha', 7, 'new', NULL, 0, NULL FROM part WHERE p_partkey % 6 = 0")
def u7_upsert_records(s, d):
    old = X.file_records(s, d)
    k = F.substring("file_id", 2, 20).cast("long")
    renew = lambda df: df.select("file_id", F.lit("sha").alias("sha256_full"), F.lit(7).cast("long").alias("size"), F.lit("new").alias("mime"), F.lit("{}").alias("modalities_done"), F.lit("v").alias("parser_version"), F.lit(NOW).cast("long").alias("indexed_at"))
    new = renew(old.filter(k % 4 == 0)).unionByName(renew(old.filter(k % 6 == 0).withColumn("file_id", F.concat(F.lit("x"), k))))
    return upserts.upsert_records(old, new).select("file_id", "sha256_full", "size", "mime", "tombstoned_at", "vector_count", "last_error")


@query("SELECT root_id, path, CASE WHEN mtime_ms % 7 = 0 THEN 'new' ELSE file_id END AS file_id FROM file_paths UNION ALL SELECT 'zz', path, 'new' FROM file_paths WHERE mtime_ms % 11 = 0")
def u8_upsert_paths(s, d):
    old = X.file_paths(s, d)
    new = old.filter("mtime_ms % 7 = 0").withColumn("file_id", F.lit("new")).unionByName(old.filter("mtime_ms % 11 = 0").withColumns({"file_id": F.lit("new"), "root_id": F.lit("zz")}))
    return upserts.upsert_paths(old, new).select("root_id", "path", "file_id")


# --- ledger maintenance


@query(f""", old AS (SELECT root_id, path, CASE WHEN doc_id % 3 = 0 THEN file_id WHEN doc_id % 3 = 1 THEN 'old' || (doc_id % 10) ELSE NULL END AS was, file_id, doc_id FROM files),
known AS (SELECT DISTINCT file_id, 'parser/0.' || CASE WHEN left(file_id, 1) < '8' THEN '3' ELSE '2' END || '.0' = '{VERSION}' AS current, left(file_id, 1) IN ('0', '1') AS dead FROM files WHERE doc_id % 2 = 0),
lost AS (SELECT 'old' || (doc_id % 10) AS was FROM files WHERE doc_id % 97 = 5)
SELECT root_id, path, o.file_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY o.file_id) THEN 'APPEND_ROOT_ONLY' WHEN NOT coalesce(current, false) THEN 'FULL_INDEX' WHEN dead THEN 'REVIVE' ELSE 'APPEND_ROOT_ONLY' END AS action,
       CASE WHEN was <> o.file_id THEN was END AS old_file_id, coalesce(was <> o.file_id AND was NOT IN (SELECT was FROM lost), false) AS orphaned, coalesce(was <> o.file_id AND was IN (SELECT was FROM lost), false) AS root_lost
FROM old o LEFT JOIN known k ON k.file_id = o.file_id""")
def m1_resolve_identity(s, d):
    batch = ledger.identified(X.files(s, d)).select("doc_id", "root_id", "path", "sha256_full", "file_id", "priority", "id")
    k = F.col("doc_id")
    before = batch.filter(k % 3 < 2).select("root_id", "path", F.when(k % 3 == 0, F.col("file_id")).otherwise(F.concat(F.lit("old"), k % 10)).alias("file_id"))
    # some of the old files have another path, in a root of its own
    before = before.unionByName(batch.filter("doc_id % 97 = 5").select(F.lit("other").alias("root_id"), "path", F.concat(F.lit("old"), k % 10).alias("file_id")))
    lead = F.substring("file_id", 1, 1)
    records = batch.filter("doc_id % 2 = 0").select("file_id").distinct().select("file_id", F.lit('{"text":"hash/v1"}').alias("modalities_done"), F.when(lead < "8", VERSION).otherwise("parser/0.2.0").alias("parser_version"), F.when(lead.isin("0", "1"), 1).cast("long").alias("tombstoned_at"))
    return ledger.resolve_identity(batch.drop("doc_id"), records, before, VERSION, MODELS)


@query("SELECT file_id, min(path) AS path, array_to_string(list_sort(list(DISTINCT root_id)), ',') AS root_ids, count(*) AS n_paths FROM files GROUP BY file_id")
def m2_dedup_files(s, d):
    rows = ledger.identified(X.files(s, d)).select("file_id", "root_id", "path", "size", "mtime_ms")
    return ledger.dedup_files(rows).select("file_id", "path", F.array_join("root_ids", ",").alias("root_ids"), "n_paths")


def told(out: ledger.Ledger) -> DataFrame:
    """A ledger as rows that SQL can tell: records' tombstones and the paths, and the chunks' roots."""
    r = out.records.select(F.lit("record").alias("kind"), F.col("file_id").alias("name"), F.col("tombstoned_at").cast("string").alias("value"))
    p = out.paths.select(F.lit("path"), F.concat_ws("|", "root_id", "path"), "file_id")
    c = out.chunks.select(F.lit("chunk"), F.concat_ws("|", "file_id", F.col("chunk_no").cast("string")), F.concat(F.array_join("root_ids", ","), F.lit("@"), F.coalesce(F.col("tombstoned_at").cast("string"), F.lit("-"))))
    return r.union(p).union(c)


def _told(touched: str, left: str) -> str:
    """SQL of told(): `touched` files lose paths, `left` are the paths after."""
    dead = f"CASE WHEN f.file_id IN (SELECT file_id FROM {touched}) AND f.file_id NOT IN (SELECT file_id FROM {left}) THEN {NOW} ELSE tombstoned_at END"
    roots = f"CASE WHEN f.file_id IN (SELECT file_id FROM {touched}) THEN coalesce((SELECT array_to_string(list_sort(list(DISTINCT root_id)), ',') FROM {left} l WHERE l.file_id = f.file_id), '') || '@' || CASE WHEN f.file_id IN (SELECT file_id FROM {left}) THEN '-' ELSE '{NOW}' END ELSE 's0@' || coalesce(tombstoned_at::VARCHAR, '-') END"
    return f"SELECT 'record' AS kind, file_id AS name, ({dead})::VARCHAR AS value FROM file_records f UNION ALL SELECT 'path', root_id || '|' || path, file_id FROM {left} UNION ALL SELECT 'chunk', file_id || '|' || chunk_no, {roots} FROM ledger_chunks f"


@query(", gone AS (SELECT DISTINCT file_id FROM file_paths WHERE mtime_ms % 3 = 0), lef AS (SELECT root_id, path, file_id FROM file_paths WHERE mtime_ms % 3 <> 0) ".replace("mtime_ms % 3", "(mtime_ms // 86400000) % 3") + _told("gone", "lef"))
def m3_delete_paths(s, d):
    keys = X.file_paths(s, d).filter("(mtime_ms div 86400000) % 3 = 0").select("root_id", "path")
    return told(ledger.delete_paths(tables(s, d), keys.unionByName(s.createDataFrame([("s1", "/nowhere")], "root_id string, path string")), NOW))


@query(", gone AS (SELECT DISTINCT file_id FROM file_paths WHERE root_id IN ('s18', 's19', 's1')), lef AS (SELECT root_id, path, file_id FROM file_paths WHERE root_id NOT IN ('s18', 's19', 's1')) " + _told("gone", "lef"))
def m4_retire_roots(s, d):
    roots = s.createDataFrame([("s18",), ("s19",), ("s1",)], "root_id string")
    return told(ledger.retire_roots(tables(s, d), roots, NOW)[0])


@query(""", r AS (SELECT * FROM (VALUES ('s18'), ('s19'), ('s1')) v(root_id)), per AS (SELECT DISTINCT root_id, file_id FROM file_paths WHERE root_id IN (SELECT root_id FROM r)),
kept AS (SELECT DISTINCT file_id FROM file_paths WHERE root_id NOT IN (SELECT root_id FROM r)),
dies AS (SELECT file_id, max(root_id) AS root_id FROM per WHERE file_id NOT IN (SELECT file_id FROM kept) GROUP BY file_id)
SELECT root_id, (SELECT count(*) FROM per p WHERE p.root_id = r.root_id) AS files_seen, (SELECT count(*) FROM dies p WHERE p.root_id = r.root_id) AS tombstoned,
       (SELECT count(*) FROM per p WHERE p.root_id = r.root_id) - (SELECT count(*) FROM dies p WHERE p.root_id = r.root_id) AS rehomed, (SELECT count(*) FROM parse_jobs j WHERE j.root_id = r.root_id AND done_at IS NULL) AS jobs_dropped FROM r""")
def m4_retire_counts(s, d):
    return ledger.retire_roots(tables(s, d), s.createDataFrame([("s18",), ("s19",), ("s1",)], "root_id string"), NOW)[1]


@query(f", old AS (SELECT file_id FROM file_records WHERE tombstoned_at < {NOW} - 86400000) SELECT 'record' AS kind, file_id AS name FROM file_records WHERE file_id NOT IN (SELECT file_id FROM old) UNION ALL SELECT 'path', root_id || '|' || path FROM file_paths WHERE file_id NOT IN (SELECT file_id FROM old) UNION ALL SELECT 'chunk', file_id || '|' || chunk_no FROM ledger_chunks WHERE file_id NOT IN (SELECT file_id FROM old)")
def m5_sweep_tombstones(s, d):
    return told(ledger.sweep_tombstones(tables(s, d), NOW)).select("kind", "name")


@query(f", bad AS (SELECT file_id FROM file_paths GROUP BY file_id HAVING NOT bool_or(indexable)) SELECT file_id, CASE WHEN tombstoned_at IS NULL AND file_id IN (SELECT file_id FROM bad) THEN {NOW} ELSE tombstoned_at END AS tombstoned_at FROM file_records")
def m6_sweep_allowlist(s, d):
    return ledger.sweep_allowlist(tables(s, d), X.allowlist(s), X.rules(s), NOW).records.select("file_id", "tombstoned_at")


@query(f", {_POLLUTED} SELECT 'record' AS kind, file_id AS name FROM file_records WHERE file_id NOT IN (SELECT file_id FROM bad) UNION ALL SELECT 'job', id::VARCHAR FROM parse_jobs WHERE NOT (done_at IS NOT NULL AND lower(regexp_extract(path, '([.][^./]*)$', 1)) IN ('.csv', '.mov'))")
def m7_cleanup_pollution(s, d):
    out = ledger.cleanup_pollution(tables(s, d), X.allowlist(s))
    return out.records.select(F.lit("record").alias("kind"), F.col("file_id").alias("name")).union(out.jobs.select(F.lit("job"), F.col("id").cast("string")))


@query("SELECT chunk_no, c.file_id, CASE WHEN coalesce(c.mtime_ms, 0) = 0 THEN coalesce(m, c.mtime_ms) ELSE c.mtime_ms END AS mtime_ms FROM ledger_chunks c LEFT JOIN (SELECT file_id, min(mtime_ms) AS m FROM file_paths GROUP BY file_id) p ON p.file_id = c.file_id")
def m8_backfill_mtime(s, d):
    return ledger.backfill_mtime(X.ledger_chunks(s, d), X.file_paths(s, d)).select("chunk_no", "file_id", "mtime_ms")


_FREE = "NOT EXISTS (SELECT 1 FROM open_jobs o WHERE o.root_id = p.root_id AND o.path = p.path)"


@query(f"SELECT root_id, path, 'reindex' AS op, 2000 AS priority FROM file_paths p JOIN file_records r ON r.file_id = p.file_id WHERE parser_version <> '{VERSION}' AND tombstoned_at IS NULL AND indexable AND {_FREE}")
def m9_drift_jobs(s, d):
    t = tables(s, d)
    return ledger.drift_jobs(t.records, t.paths, t.jobs, X.allowlist(s), X.rules(s), VERSION)


@query(""", fits AS (SELECT file_id FROM file_records r WHERE tombstoned_at IS NULL AND starts_with(mime, 'text/x') AND EXISTS (SELECT 1 FROM file_paths p WHERE p.file_id = r.file_id))
SELECT 'job' AS kind, root_id || '|' || path AS name, 'reindex 1000' AS value FROM file_paths WHERE file_id IN (SELECT file_id FROM fits)
UNION ALL SELECT 'skipped', file_id, 'no_paths_orphan' FROM file_records r WHERE tombstoned_at IS NULL AND starts_with(mime, 'text/x') AND file_id NOT IN (SELECT file_id FROM file_paths)""")
def m10_reindex(s, d):
    t = tables(s, d)
    _, todo, skipped = ledger.reindex(t.records, t.paths, NOW, filter={"mime_prefix": "text/x"}, most=None)
    return todo.select(F.lit("job").alias("kind"), F.concat_ws("|", "root_id", "path").alias("name"), F.concat_ws(" ", "op", F.col("priority").cast("string")).alias("value")).union(skipped.select(F.lit("skipped"), "file_id", "reason"))


@query("SELECT root_id, path, 'reindex' AS op, 500 AS priority FROM file_paths WHERE root_id = 's2' AND indexable")
def m11_rescan_root(s, d):
    return ledger.rescan_root(X.file_paths(s, d), X.allowlist(s), X.rules(s), "s2")


@query(f""", {_DIFF}, kept AS (SELECT diff.* FROM diff JOIN inventory_roots ON id = root_id AND enabled),
lef AS (SELECT p.root_id, p.path, p.file_id FROM file_paths p WHERE root_id IN (SELECT id FROM inventory_roots) AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.root_id = p.root_id AND k.path = p.path AND k.class = 'extra'))
SELECT 'job' AS kind, root_id || '|' || path AS name, CASE class WHEN 'missing' THEN 'index' ELSE 'reindex' END AS value FROM kept p WHERE class = 'missing' AND ext IN ({X.ENABLED}) AND NOT EXISTS (SELECT 1 FROM open_jobs o WHERE o.root_id = p.root_id AND o.path = p.path AND p.root_id IN (SELECT id FROM inventory_roots))
UNION ALL SELECT 'job', root_id || '|' || path, 'reindex' FROM kept p WHERE class = 'stale' AND {_FREE}
UNION ALL (WITH gone AS (SELECT DISTINCT file_id FROM file_paths p WHERE NOT EXISTS (SELECT 1 FROM lef l WHERE l.root_id = p.root_id AND l.path = p.path)) {_told("gone", "lef")})
UNION ALL SELECT 'retired', root_id, NULL FROM (SELECT DISTINCT root_id FROM file_paths WHERE root_id NOT IN (SELECT id FROM inventory_roots))""")
def m12_verify(s, d):
    # the inventory is a table that a run reads more than once, as the ledger's are
    out = verify.verify(tables(s, d), stored(X.inventory_files(s, d)), X.inventory_roots(s, d), X.allowlist(s), X.rules(s), NOW)
    name = F.concat_ws("|", "root_id", "path")
    rows = out.jobs.select(F.lit("job").alias("kind"), name.alias("name"), F.col("op").alias("value")).union(told(out.ledger))
    return rows.union(out.retired.select(F.lit("retired"), "root_id", F.lit(None).cast("string")))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN {NOW} WHEN id % 3 = 1 AND attempts + 1 >= 5 THEN {NOW} ELSE done_at END AS done_at, CASE WHEN id % 3 = 2 THEN locked_until END AS locked_until, CASE WHEN id % 3 = 1 THEN 'e' || id ELSE last_error END AS last_error, CASE WHEN id % 3 = 1 THEN attempts + 1 ELSE attempts END AS attempts FROM parse_jobs")
def m13_apply_outcomes(s, d):
    j = X.parse_jobs(s, d)
    outcomes = j.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 1, F.concat(F.lit("e"), "id")).alias("error"))
    return jobs.apply_outcomes(j, outcomes, NOW).select("id", "done_at", "locked_until", "last_error", "attempts")


@query("SELECT 'retry' AS what, id, CASE WHEN NOT (done_at IS NOT NULL AND last_error IS NOT NULL) THEN done_at END AS value FROM parse_jobs UNION ALL SELECT 'clear', id, NULL FROM parse_jobs WHERE NOT (done_at IS NOT NULL AND last_error IS NOT NULL) UNION ALL SELECT 'delete', id, NULL FROM parse_jobs WHERE id % 7 <> 0 OR (locked_until IS NOT NULL AND locked_until > 978307200000)")
def m14_retry_clear_delete(s, d):
    j = X.parse_jobs(s, d)
    null = F.lit(None).cast("long")
    left, _ = jobs.delete_jobs(j, j.filter("id % 7 = 0").select("id"), 978_307_200_000)
    return jobs.retry_failed(j).select(F.lit("retry").alias("what"), "id", F.col("done_at").alias("value")).union(jobs.clear_failed(j).select(F.lit("clear"), "id", null)).union(left.select(F.lit("delete"), "id", null))


@query("SELECT 'job' AS kind, '/DATA/thumbs/a/' || asset_id || '.jpg' AS path, asset_id FROM assets WHERE source = 'photos' AND NOT outside UNION ALL SELECT CASE WHEN source <> 'photos' THEN 'bad source' ELSE 'outside allowed directories' END, NULL, asset_id FROM assets WHERE source <> 'photos' OR outside")
def m15_visual_jobs(s, d):
    ok, refused = jobs.visual_jobs(X.assets(s, d), ["/DATA/thumbs"])
    return ok.select(F.lit("job").alias("kind"), "path", scalars.parse_visual_payload(F.col("sub_modality"))["asset_id"].cast("long").alias("asset_id")).union(refused.select("reason", F.lit(None).cast("string"), "asset_id"))


# --- streaming


def events_stream(s: SparkSession, d: str) -> DataFrame:
    """file_events as a stream: the events are written below the shared folder first, as a feed would leave them."""
    src = io.write_table(X.file_events(s, d), f"{shared_dir(s)}/feed-{uuid.uuid4().hex}")
    return s.readStream.schema(s.read.parquet(src).schema).option("maxFilesPerTrigger", 4).parquet(src)


@query("SELECT * FROM event_jobs")
def t1_stream_events(s, d):
    out = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    stream.stream_events_to_jobs(events_stream(s, d), X.allowlist(s), X.rules(s), f"{out}/jobs", f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/jobs").drop("batch")


@query("SELECT * FROM event_jobs")
def t1_feed_source(s, d):
    """The events as a keyset feed in pages, followed by a stream that is stopped and started again half-way."""
    out = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    events = X.file_events(s, d)
    for half in (events.filter("seq % 2 = 0"), events.filter("seq % 2 = 1")):
        # the second half's events lie between the first half's: moved behind them by an era, and back when they are told
        era = F.when(F.col("seq") % 2 == 1, F.lit(1 << 50)).otherwise(0)
        feed.publish(half.withColumn("detected_at", F.col("detected_at") + era), f"{out}/feed", 5000)
        stream.stream_events_to_jobs(feed.read_feed(s, f"{out}/feed"), X.allowlist(s), X.rules(s), f"{out}/jobs", f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/jobs").drop("batch").withColumn("detected_at", F.col("detected_at") % (1 << 50))


@query(f", c AS (SELECT 'u' || user_id AS feed, CASE WHEN user_id % 7 = 0 THEN 0 ELSE min(epoch_us(ts) // 1000) END AS since_ms, min(event_id) AS last_seq, max(epoch_us(ts) // 1000) AS top, any_value(user_id) AS u FROM events GROUP BY user_id) SELECT feed, CASE WHEN u % 3 = 0 THEN 5 ELSE {NOW} END AS detected_at, since_ms, last_seq, top AS archive_cutoff_ms, u % 6 = 0 AS triggered, u % 6 <> 0 AS fire FROM c WHERE u % 7 <> 0 AND since_ms < top AND u % 5 <> 0")
def t2_cursor_gap(s, d):
    u = F.col("user_id")
    by = X.table(s, d, "events").select("user_id", "event_id", X.epoch_ms("ts").alias("t")).groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("event_id").alias("last_seq"))
    feed = F.concat(F.lit("u"), u)
    cursors = by.select(feed.alias("feed"), F.when(u % 7 == 0, 0).otherwise(F.col("lo")).alias("since_ms"), "last_seq")
    horizons = by.select(feed.alias("feed"), F.col("hi").alias("archive_cutoff_ms"), (u % 5 != 0).alias("has_archived"))
    gaps = by.filter((u % 3 == 0) & (u % 5 != 0)).select(feed.alias("feed"), F.lit(5).cast("long").alias("detected_at"), F.col("lo").alias("since_ms"), "last_seq", F.col("hi").alias("archive_cutoff_ms"), (u % 2 == 0).alias("triggered"))
    return stream.cursor_gap_transition(cursors, horizons, gaps, NOW)


def gap_polls(s: SparkSession, d: str) -> DataFrame:
    """A poll of the user's feed for each event, with a horizon before or behind its cursor, and the word that a verify started after
    some of them."""
    e, t = F.col("event_id"), F.col("t")
    rows = X.table(s, d, "events").select("user_id", "event_id", X.epoch_ms("ts").alias("t"))
    own = [F.concat(F.lit("u"), "user_id").alias("feed"), e.alias("at"), F.when(e % 11 == 0, 0).otherwise(t).alias("since_ms"), e.alias("last_seq"), (t + F.when(e % 3 < 2, 1000).otherwise(-1000)).alias("archive_cutoff_ms"), (e % 5 != 0).alias("has_archived")]
    return rows.select(*own, F.lit(False).alias("started")).unionByName(rows.filter(e % 2 == 0).select(*own, F.lit(True).alias("started")))


@query(""", p AS (SELECT 'u' || user_id AS feed, event_id AS polled_at, CASE WHEN event_id % 11 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS since_ms, epoch_us(ts) // 1000 + CASE WHEN event_id % 3 < 2 THEN 1000 ELSE -1000 END AS cutoff, event_id % 5 <> 0 AS told, s AS started,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id, s) AS n FROM events, (VALUES (false), (true)) v(s) WHERE NOT s OR event_id % 2 = 0),
q AS (SELECT *, told AND since_ms > 0 AND since_ms < cutoff AS behind FROM p),
walk AS (
  SELECT feed, 0::BIGINT AS n, NULL::BIGINT AS polled_at, NULL::VARCHAR AS step, NULL::BIGINT AS g, NULL::BIGINT AS g_since, NULL::BIGINT AS g_cutoff, NULL::BOOLEAN AS trig, NULL::BIGINT AS was, NULL::BIGINT AS w_since, NULL::BIGINT AS w_cutoff, NULL::BOOLEAN AS w_trig FROM (SELECT DISTINCT feed FROM q)
  UNION ALL
  SELECT q.feed, q.n, q.polled_at,
    CASE WHEN q.started THEN CASE WHEN g IS NOT NULL AND NOT trig THEN 'started' END WHEN NOT told THEN NULL WHEN NOT behind THEN CASE WHEN g IS NOT NULL THEN 'cleared' END WHEN g IS NULL THEN 'recorded' WHEN NOT trig THEN 'retried' END,
    CASE WHEN q.started OR NOT told THEN g WHEN NOT behind THEN NULL ELSE coalesce(g, q.polled_at) END,
    CASE WHEN q.started OR NOT told OR g IS NOT NULL THEN g_since ELSE q.since_ms END, CASE WHEN q.started OR NOT told OR g IS NOT NULL THEN g_cutoff ELSE q.cutoff END,
    CASE WHEN q.started THEN g IS NOT NULL WHEN NOT told OR g IS NOT NULL THEN trig ELSE false END, g, g_since, g_cutoff, trig
  FROM walk w JOIN q ON q.feed = w.feed AND q.n = w.n + 1)
SELECT feed, polled_at, step, coalesce(CASE WHEN step <> 'cleared' THEN g END, was) AS detected_at, CASE WHEN step = 'cleared' THEN w_since ELSE g_since END AS since_ms, coalesce(CASE WHEN step <> 'cleared' THEN g END, was) AS last_seq, CASE WHEN step = 'cleared' THEN w_cutoff ELSE g_cutoff END AS archive_cutoff_ms, CASE WHEN step = 'cleared' THEN w_trig ELSE trig END AS triggered, step IN ('recorded', 'retried') AS fire FROM walk WHERE step IS NOT NULL""")
def t2_gap_stream(s, d):
    """The feeds' gaps over several micro-batches, their state in the stream."""
    out, polls = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}", stored(gap_polls(s, d))
    first, last = polls.agg(F.min("at"), F.max("at")).head()
    share = F.floor((F.col("at") - (first or 0)) * 3 / F.lit((last or 0) - (first or 0) + 1))
    for k in range(3):  # a feed's rows of a third are in one file, and thirds come one after the other
        polls.filter(share == k).repartition(4, "feed").write.mode("append").parquet(f"{out}/in")
    steps = stream.stream_gaps(s.readStream.schema(polls.schema).option("maxFilesPerTrigger", 4).parquet(f"{out}/in"))
    steps.writeStream.format("parquet").option("path", f"{out}/steps").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(steps.schema).parquet(f"{out}/steps").withColumnRenamed("at", "polled_at")


@query("SELECT start_ms, start_ms + 600000 AS end_ms, count(*) AS completed, round(count(*) / 10, 2) AS rate_per_min FROM (SELECT (done_at // 60000 - k) * 60000 AS start_ms FROM parse_jobs, range(0, 10) r(k) WHERE done_at IS NOT NULL) GROUP BY start_ms")
def t3_throughput(s, d):
    return stream.stream_throughput(X.parse_jobs(s, d))


@query(", live AS (SELECT * FROM event_jobs WHERE op <> 'retire_root' AND root_id NOT IN (SELECT root_id FROM event_jobs WHERE op = 'retire_root')) SELECT root_id, path, arg_max(op, (detected_at, seq)) AS op, max((detected_at, seq))[2] AS seq FROM live GROUP BY root_id, path UNION ALL SELECT root_id, '', 'retire_root', max((detected_at, seq))[2] FROM event_jobs WHERE op = 'retire_root' GROUP BY root_id")
def t4_stream_apply(s, d):
    out = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    src = io.write_table(routing.events_to_jobs(X.file_events(s, d), X.allowlist(s), X.rules(s)), f"{out}/in")
    rows = s.readStream.schema(s.read.parquet(src).schema).parquet(src)
    stream.stream_apply(rows, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/applied/batch={n}"), f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/applied").select("root_id", "path", "op", "seq")


@query(_BEFORE + f""", came AS (SELECT * FROM batch WHERE doc_id % 97 <> 5 AND doc_id % 5 <> 0),
stay AS (SELECT root_id, path, file_id FROM came UNION ALL SELECT o.root_id, o.path, o.file_id FROM old_paths o JOIN fine_files f ON f.root_id = o.root_id AND f.path = o.path WHERE f.doc_id % 97 = 5 OR (f.doc_id % 5 <> 0 AND f.doc_id % 13 IN (0, 1, 2))),
left_by AS (SELECT DISTINCT file_id FROM old_paths o WHERE NOT EXISTS (SELECT 1 FROM stay l WHERE l.root_id = o.root_id AND l.path = o.path AND l.file_id = o.file_id)),
names AS (SELECT file_id FROM old_records UNION SELECT file_id FROM came)
SELECT 'path' AS kind, root_id || '|' || path AS name, file_id AS value FROM stay
UNION ALL SELECT 'record', n.file_id, CASE WHEN coalesce(r.current, true) OR n.file_id IN (SELECT file_id FROM came WHERE indexable) THEN '{VERSION}' ELSE 'parser/0.2.0' END || ' ' || CASE WHEN n.file_id IN (SELECT file_id FROM came) THEN '-' WHEN n.file_id IN (SELECT file_id FROM left_by) AND n.file_id NOT IN (SELECT file_id FROM stay) THEN '{NOW}' WHEN r.dead THEN '1' ELSE '-' END FROM names n LEFT JOIN old_records r ON r.file_id = n.file_id
UNION ALL SELECT 'chunk', file_id, CASE WHEN file_id IN (SELECT file_id FROM left_by) THEN coalesce((SELECT array_to_string(list_sort(list(DISTINCT root_id)), ',') FROM stay l WHERE l.file_id = r.file_id), '') || '@' || CASE WHEN file_id IN (SELECT file_id FROM stay) THEN '-' ELSE '{NOW}' END ELSE 'before@-' END FROM old_records r WHERE starts_with(file_id, 'old')""")
def t4_stream_ledger(s, d):
    """The ledger that follows a stream of jobs on the documents' files: some paths are deleted, one root retires, the others are indexed
    unless they lie below a gate. Told are its paths, its records, and the chunks of the files that only lose paths."""
    k, out = F.col("doc_id"), f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    op = F.when(k % 97 == 5, "retire_root").when(k % 5 == 0, "delete").otherwise("index")
    retires = op == "retire_root"
    todo = X.files(s, d).select(F.when(retires, "other").otherwise(F.col("root_id")).alias("root_id"), F.when(retires, "").otherwise(F.col("path")).alias("path"), op.alias("op"), F.lit(100).alias("priority"), F.col("mtime_ms").alias("detected_at"), F.col("id").alias("seq"))
    src = io.write_table(todo.repartition(3), f"{out}/in")
    jobs = s.readStream.schema(s.read.parquet(src).schema).option("maxFilesPerTrigger", 2).parquet(src)
    # the files' contents are laid out by path, so that a batch reads the buckets of its own paths
    n = 24  # as few as Spark lists without a job of its own
    contents = io.write_table(X.files(s, d), f"{out}/contents", ["root_id", "path"], n)
    fetch = lambda keys: io.read_buckets(s, contents, layout.buckets_of(keys, ["root_id", "path"], n)).join(keys, ["root_id", "path"], "left_semi")
    change = lambda before, batch, files: apply_jobs(before, batch, files, X.allowlist(s), X.rules(s), VERSION, "hash/v1", NOW)
    stream.stream_ledger(jobs, before_batch(s, d), fetch, change, f"{out}/ledger", f"{out}/state", n).awaitTermination()
    after = store.read(s, f"{out}/ledger")
    dead = F.coalesce(F.col("tombstoned_at").cast("string"), F.lit("-"))
    rows = after.paths.select(F.lit("path").alias("kind"), F.concat_ws("|", "root_id", "path").alias("name"), F.col("file_id").alias("value"))
    rows = rows.union(after.records.select(F.lit("record"), "file_id", F.concat_ws(" ", "parser_version", dead)))
    return rows.union(after.chunks.filter("file_id like 'old%'").select(F.lit("chunk"), "file_id", F.concat(F.array_join("root_ids", ","), F.lit("@"), dead)))
