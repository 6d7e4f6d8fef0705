"""Ledger tables derived from the given tables, in Spark and, as common table expressions, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_id, memory_id, note_id
from ..functions.paths import DEFAULT_EXTENSIONS

BASE_MS = 1704067200000
EXT9 = (".md", ".txt", ".py", ".csv", ".log", ".html", ".mov", ".pdf", ".JSON")
MIMES = ("text/markdown", "text/plain", "text/x-source", "application/pdf")
MODALITIES = ('{"text":"hash/v1"}', "{}", "not json", '{"text":"hash/v2"}', '{"text":"hash/v1","image":"x"}')
OPS = ("index", "reindex", "delete", "visual_ingest")
RULES = (("r1", "*/src1/*", "deny"), ("r2", "*.mov", "allow"), ("r1", "*.mov", "allow"))
DISABLED = ".csv"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def pick(values: tuple[str, ...], n: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast(({n}) % {len(values)} + 1 as int)"))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.expr("doc_id % 13")
    folder = F.when(k == 0, "@eaDir").when(k == 1, ".Trash-1000").when(k == 2, "x/../../Notes").otherwise("docs")
    path = text("/DATA/", F.col("source"), "/", folder, "/d", F.col("doc_id"), pick(EXT9, "doc_id"))
    return table(spark, d, "documents").select("doc_id", text("r", F.expr("doc_id % 7")).alias("root_id"), path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1000 + BASE_MS).alias("mtime_ms"), F.col("doc_id").alias("id"), F.lit(100).alias("priority"))


def md_files(spark: SparkSession, d: str) -> DataFrame:
    sep = F.when(F.col("doc_id") % 2 == 0, "\n\n## Part\n\n").otherwise("\n\n")
    body = F.replace("text", F.lit("\n"), sep)
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), body).alias("text"))


def src_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat(text("def f", F.col("doc_id"), "():\n"), F.replace("text", F.lit("\n"), F.lit("\nclass C:\n  "))).alias("text"))


def path_rows(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.max("l_shipdate").alias("t"))
    path = text("/DATA/o", F.col("l_orderkey"), "/", F.col("l_linenumber"), pick(EXT9, "p"))
    return by.select("l_orderkey", "l_linenumber", text("s", F.expr("s % 20")).alias("root_id"), path.alias("path"), text("p", F.col("p")).alias("file_id"), epoch_ms("t").alias("mtime_ms"))


def file_paths(spark: SparkSession, d: str) -> DataFrame:
    return path_rows(spark, d).drop("l_orderkey", "l_linenumber")


def file_records(spark: SparkSession, d: str) -> DataFrame:
    p, n = F.col("p_partkey"), "p_partkey"
    return table(spark, d, "part").select(
        text("p", p).alias("file_id"), F.sha2(text("p", p).cast("binary"), 256).alias("sha256_full"), (F.col("p_size") * 1000).cast("long").alias("size"), pick(MIMES, n).alias("mime"),
        pick(MODALITIES, n).alias("modalities_done"), text("parser/0.", F.expr("p_partkey % 3 + 1"), ".0").alias("parser_version"), (p * 1000 + BASE_MS).alias("indexed_at"),
        F.when(p % 10 == 0, p * 3_600_000 + BASE_MS).alias("tombstoned_at"), (p % 17).alias("vector_count"), F.when(p % 23 == 0, text("err", p)).alias("last_error"),
    )


def parse_jobs(spark: SparkSession, d: str) -> DataFrame:
    paths = path_rows(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("line"), "root_id", "path")
    o = F.col("o_orderkey")
    rows = table(spark, d, "orders").withColumn("line", o % 7 + 1).join(paths, ["o_orderkey", "line"], "left")
    created, status = epoch_ms("o_orderdate"), F.col("o_orderstatus")
    error = F.when((status == "F") & (o % 5 == 0), "boom").when((status == "O") & (o % 50 == 0), "earlier")
    return rows.select(
        o.alias("id"), F.coalesce("root_id", F.lit("s0")).alias("root_id"), F.coalesce("path", text("/DATA/o", o, "/0.md")).alias("path"), pick(OPS, "o_orderkey").alias("op"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 100).alias("priority"), (o % 6).alias("attempts"), error.alias("last_error"), F.when(status == "P", created + 300_000).alias("locked_until"),
        created.alias("created_at"), F.lit(None).cast("long").alias("picked_at"), F.when(status == "F", created + o % 600_000).alias("done_at"),
    )


def file_events(spark: SparkSession, d: str) -> DataFrame:
    k, t, e = F.get_json_object("props", "$.k").cast("long"), F.col("event_type"), F.col("event_id")
    op = F.when(t == "signup", "create").when(t == "click", "modify").when(t == "view", "rename").when(t == "purchase", "delete").when(e % 500 == 0, "root_removed").otherwise("modify")
    rows = table(spark, d, "events").withColumn("k", k)
    path = text("/DATA/u", F.col("user_id"), "/k", F.col("k"), pick(EXT9, "k"))
    return rows.select(text("r", F.expr("user_id % 7")).alias("root_id"), path.alias("path"), op.alias("op"), ((t == "error") & (e % 500 != 0)).cast("int").alias("is_dir"), epoch_ms("ts").alias("detected_at"), e.alias("seq"))


def inventory_files(spark: SparkSession, d: str) -> DataFrame:
    rows = path_rows(spark, d)
    o = F.col("l_orderkey")
    same = rows.filter(o % 11 != 0).select("root_id", "path", (F.col("mtime_ms") + F.when(o % 7 == 0, 5000).when(o % 5 == 0, 500).otherwise(0)).alias("mtime_ms"))
    more = rows.filter(o % 13 == 0).groupBy("root_id", "l_orderkey").agg(F.max("mtime_ms").alias("mtime_ms"))
    return same.unionByName(more.select("root_id", text("/DATA/o", o, "/99.md").alias("path"), "mtime_ms"))


def inventory_roots(spark: SparkSession, d: str) -> DataFrame:
    """s0 to s17 as far as suppliers have them; s3 is disabled."""
    s = table(spark, d, "supplier").select(F.expr("s_suppkey % 20").alias("n")).distinct().filter("n < 18")
    return s.select(text("s", F.col("n")).alias("id"), (F.col("n") != 3).alias("enabled"))


def allowlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, e != DISABLED) for e in DEFAULT_EXTENSIONS], "ext string, enabled boolean")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "root_id string, path_glob string, action string")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    i, caption = F.col("doc_id"), F.col("doc_id") % 6 == 0
    return table(spark, d, "documents").select(
        text("pt", F.lpad(i.cast("string"), 12, "0")).alias("point_id"), F.when(caption, text(F.col("source"), ":", i)).otherwise(content_id(F.col("text"))).alias("file_id"),
        F.array(F.when(caption, F.col("source")).otherwise(text("r", F.expr("doc_id % 7")))).alias("root_ids"), F.when(i % 50 == 0, None).when(caption, "caption").otherwise("body").alias("kind"),
        "text", F.when(i % 4 != 0, i * 1000).alias("mtime_ms"), F.when(i % 31 == 0, i).alias("tombstoned_at"),
    )


def ledger_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the ledger's files: two a record."""
    return file_records(spark, d).select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("chunk_no"), "file_id", F.array(F.lit("s0")).alias("root_ids"), F.when(F.col("size") % 3000 != 0, F.col("size")).alias("mtime_ms"), "tombstoned_at")


def memory(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("user_id"), F.expr("vec_id % 20").alias("session_id"), v.alias("chunk_no"), text("v", v).alias("text"), F.col("embedding").alias("dense"), (v * 1000).alias("created_at"))


def memory_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("user_id"), F.col("embedding").alias("dense"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("user_id"), F.expr("vec_id div 3").alias("note_id"), v.alias("chunk_no"), text("v", v).alias("text"), F.when(v % 2 == 0, "fact").otherwise("plan").alias("type"), pick(("open", "done", "old"), "vec_id").alias("status"), F.col("embedding").alias("dense"))


def memory_points(spark: SparkSession, d: str) -> DataFrame:
    """The memory with chunk numbers that start anew in every session, and the ids of its points."""
    m = memory(spark, d).withColumn("chunk_no", F.expr("chunk_no div 20"))
    return m.withColumn("point_id", memory_id(F.col("user_id"), F.col("session_id"), F.col("chunk_no")))


def note_points(spark: SparkSession, d: str) -> DataFrame:
    """The notes with chunk numbers that start anew in every note, and the ids of their points."""
    n = notes(spark, d).withColumn("updated_at", F.col("chunk_no") * 1000).withColumn("chunk_no", F.col("chunk_no") % 3)
    return n.withColumn("point_id", note_id(F.col("user_id"), F.col("note_id"), F.col("chunk_no")))


def assets(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    meta = F.when(i % 4 == 0, text('{"taken_at":"2024-01-', i % 28 + 1, '","place":"P', i, '"}')).when(i % 4 == 1, text('{"place":"P', i, '"}')).when(i % 4 == 2, text('{"taken_at":"2024"}')).otherwise("{}")
    image = text(F.when(i % 5 == 0, "/DATA/thumbs/../private/").otherwise("/DATA/thumbs/./a//"), i, ".jpg")
    return table(spark, d, "benchmark").select(F.when(i % 9 == 8, "Bad Source").otherwise("photos").alias("source"), i.alias("asset_id"), F.col("text").alias("caption"), meta.alias("meta"), (i * 1000).alias("mtime_ms"), image.alias("image_path"), F.lit("image/jpeg").alias("mime"))


def token_weights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.expr("l_partkey % 50").alias("token"), F.expr("round(l_discount - 0.03, 2)").alias("weight"))


def _pick(values: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({n}) % {len(values)} + 1]"


ENABLED = ", ".join(f"'{e}'" for e in DEFAULT_EXTENSIONS if e != DISABLED)

#: The same tables for DuckDB; a query's own SQL follows.
SQL = f"""
WITH RECURSIVE files AS (
  SELECT doc_id, 'r' || (doc_id % 7) AS root_id, lower({_pick(EXT9, "doc_id")}) AS ext,
         '/DATA/' || source || '/' || CASE doc_id % 13 WHEN 0 THEN '@eaDir' WHEN 1 THEN '.Trash-1000' WHEN 2 THEN 'x/../../Notes' ELSE 'docs' END || '/d' || doc_id || {_pick(EXT9, "doc_id")} AS path,
         text AS content, strlen(text) AS size, {BASE_MS} + doc_id * 1000 AS mtime_ms, left(sha256(text), 32) AS file_id, source
  FROM documents),
fine_files AS (
  SELECT *, doc_id % 13 NOT IN (0, 1, 2) AND NOT (root_id = 'r1' AND source = 'src1' AND doc_id % 13 > 2)
         AND ((root_id IN ('r1', 'r2') AND ext = '.mov') OR ext IN ({ENABLED})) AS indexable FROM files),
path_rows AS (
  SELECT l_orderkey, l_linenumber, 's' || (min(l_suppkey) % 20) AS root_id, lower({_pick(EXT9, "min(l_partkey)")}) AS ext,
         '/DATA/o' || l_orderkey || '/' || l_linenumber || {_pick(EXT9, "min(l_partkey)")} AS path, 'p' || min(l_partkey) AS file_id, epoch_ms(max(l_shipdate)) AS mtime_ms
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
file_paths AS (SELECT root_id, path, file_id, mtime_ms, ext, ext IN ({ENABLED}) AS indexable FROM path_rows),
file_records AS (
  SELECT 'p' || p_partkey AS file_id, sha256('p' || p_partkey) AS sha256_full, p_size::BIGINT * 1000 AS size, {_pick(MIMES, "p_partkey")} AS mime, {_pick(MODALITIES, "p_partkey")} AS modalities_done,
         'parser/0.' || (p_partkey % 3 + 1) || '.0' AS parser_version, {BASE_MS} + p_partkey * 1000 AS indexed_at, CASE WHEN p_partkey % 10 = 0 THEN {BASE_MS} + p_partkey * 3600000 END AS tombstoned_at,
         p_partkey % 17 AS vector_count, CASE WHEN p_partkey % 23 = 0 THEN 'err' || p_partkey END AS last_error
  FROM part),
parse_jobs AS (
  SELECT o_orderkey AS id, coalesce(root_id, 's0') AS root_id, coalesce(path, '/DATA/o' || o_orderkey || '/0.md') AS path, {_pick(OPS, "o_orderkey")} AS op, o_orderpriority[1]::INT * 100 AS priority, o_orderkey % 6 AS attempts,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'boom' WHEN o_orderstatus = 'O' AND o_orderkey % 50 = 0 THEN 'earlier' END AS last_error,
         CASE WHEN o_orderstatus = 'P' THEN epoch_ms(o_orderdate) + 300000 END AS locked_until, epoch_ms(o_orderdate) AS created_at, NULL::BIGINT AS picked_at,
         CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) + o_orderkey % 600000 END AS done_at
  FROM orders LEFT JOIN path_rows ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 7 + 1),
open_jobs AS (SELECT DISTINCT root_id, path FROM parse_jobs WHERE done_at IS NULL),
file_events AS (
  SELECT 'r' || (user_id % 7) AS root_id, '/DATA/u' || user_id || '/k' || k || {_pick(EXT9, "k")} AS path, lower({_pick(EXT9, "k")}) AS ext,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'view' THEN 'rename' WHEN 'purchase' THEN 'delete' ELSE CASE WHEN event_id % 500 = 0 THEN 'root_removed' ELSE 'modify' END END AS op,
         (event_type = 'error' AND event_id % 500 <> 0)::INT AS is_dir, epoch_us(ts) // 1000 AS detected_at, event_id AS seq
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
event_jobs AS (
  SELECT root_id, CASE WHEN op = 'root_removed' THEN '' ELSE path END AS path, CASE op WHEN 'root_removed' THEN 'retire_root' WHEN 'delete' THEN 'delete' ELSE 'index' END AS op,
         CASE WHEN op = 'root_removed' THEN 50 ELSE 100 END AS priority, detected_at, seq
  FROM file_events WHERE op = 'root_removed' OR (is_dir = 0 AND (op = 'delete' OR ext IN ({ENABLED}) OR (ext = '.mov' AND root_id IN ('r1', 'r2'))))),
inventory_files AS (
  SELECT root_id, path, mtime_ms + CASE WHEN l_orderkey % 7 = 0 THEN 5000 WHEN l_orderkey % 5 = 0 THEN 500 ELSE 0 END AS mtime_ms, ext FROM path_rows WHERE l_orderkey % 11 <> 0
  UNION ALL SELECT root_id, '/DATA/o' || l_orderkey || '/99.md', max(mtime_ms), '.md' FROM path_rows WHERE l_orderkey % 13 = 0 GROUP BY root_id, l_orderkey),
inventory_roots AS (SELECT DISTINCT 's' || (s_suppkey % 20) AS id, s_suppkey % 20 <> 3 AS enabled FROM supplier WHERE s_suppkey % 20 < 18),
chunks AS (
  SELECT 'pt' || lpad(doc_id::VARCHAR, 12, '0') AS point_id, CASE WHEN doc_id % 6 = 0 THEN source || ':' || doc_id ELSE left(sha256(text), 32) END AS file_id, CASE WHEN doc_id % 6 = 0 THEN source ELSE 'r' || (doc_id % 7) END AS root_ids,
         CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN 'caption' ELSE 'body' END AS kind, text, CASE WHEN doc_id % 4 <> 0 THEN doc_id * 1000 END AS mtime_ms, CASE WHEN doc_id % 31 = 0 THEN doc_id END AS tombstoned_at
  FROM documents),
ledger_chunks AS (SELECT c.chunk_no, file_id, CASE WHEN size % 3000 <> 0 THEN size END AS mtime_ms, tombstoned_at FROM file_records, (VALUES (0), (1)) c(chunk_no)),
memory AS (SELECT label::BIGINT AS user_id, vec_id % 20 AS session_id, vec_id AS chunk_no, 'v' || vec_id AS text, embedding::DOUBLE[] AS dense, vec_id * 1000 AS created_at FROM embeddings),
memory_queries AS (SELECT vec_id AS query_id, label::BIGINT AS user_id, embedding::DOUBLE[] AS dense FROM embeddings WHERE vec_id % 50 = 0),
notes AS (SELECT label::BIGINT AS user_id, vec_id // 3 AS note_id, vec_id AS chunk_no, CASE WHEN vec_id % 2 = 0 THEN 'fact' ELSE 'plan' END AS type, ['open', 'done', 'old'][vec_id % 3 + 1] AS status, embedding::DOUBLE[] AS dense FROM embeddings),
assets AS (
  SELECT CASE WHEN item_id % 9 = 8 THEN 'Bad Source' ELSE 'photos' END AS source, item_id AS asset_id, text AS caption, item_id % 4 AS k, item_id * 1000 AS mtime_ms,
         CASE WHEN item_id % 4 = 0 THEN '2024-01-' || (item_id % 28 + 1) WHEN item_id % 4 = 2 THEN '2024' END AS taken, CASE WHEN item_id % 4 < 2 THEN 'P' || item_id END AS place, item_id % 5 = 0 AS outside
  FROM benchmark)
"""
