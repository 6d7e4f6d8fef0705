"""Which files are indexed, and how."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_key, glob_regex, is_gated, path_ext, path_keys
from ..session import stored

MAX_FILE_BYTES = 4 * 1024 * 1024
# Extensions by the reader that takes them; all others are plain text.
MARKDOWN = (".md", ".markdown")
CONVERTED = (".pdf", ".docx", ".pptx", ".xlsx", ".html", ".htm")
LEGACY = (".doc", ".ppt", ".xls", ".wps")
SOURCE = (".py", ".go", ".rs", ".ts", ".tsx", ".js", ".jsx", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".bash", ".sql", ".lua")
#: Rules that become one expression at most; more are joined with the paths by their keys.
RULES = 200


def route_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """files (path, size) with `route` and `stored_mime`."""
    ext = path_ext(F.col("path"))
    bare = F.regexp_replace(ext, r"^\.", "")
    route = F.when(F.col("size") > max_bytes, "too_large").when(ext.isin(*LEGACY), "legacy").when(ext.isin(*CONVERTED), "docling").when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*SOURCE), "source").otherwise("plain")
    # fixed values: the mime strings that are stored
    mime = (
        F.when(F.col("route") == "too_large", F.concat(F.lit("application/x-too-large/"), bare))
        .when(F.col("route") == "legacy", F.concat(F.lit("text/markdown+libreoffice-docling/"), bare))
        .when(F.col("route") == "docling", F.concat(F.lit("text/markdown+docling/"), bare))
        .when(F.col("route") == "markdown", "text/markdown").when(F.col("route") == "source", "text/x-source").otherwise("text/plain")
    )
    return files.withColumn("route", route).withColumn("stored_mime", mime)


def _enabled(exts: DataFrame) -> DataFrame:
    """The enabled extensions: a control table of one row an extension."""
    return exts.filter("enabled").select(F.col("ext").alias("_ext")).distinct()


def _by_rules(paths: DataFrame, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    deny, allow = F.lit(False), F.lit(False)
    for root, glob, action in rules:
        hit = (F.col("root_id") == root) & F.col("path").rlike(glob_regex(glob))
        deny, allow = (deny | hit, allow) if action == "deny" else (deny, allow | hit)
    return deny, allow


def with_patterns(rules: DataFrame) -> DataFrame:
    """root_id, action, path_glob of rules, with `_key` and `_pattern` of the globs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            globs = b.column("path_glob").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([glob_key(g) for g in globs], pa.string()), pa.array([glob_regex(g) for g in globs], pa.string())], [*b.schema.names, "_key", "_pattern"])

    return rules.select("root_id", "action", "path_glob").filter("path_glob is not null").mapInArrow(work, "root_id string, action string, path_glob string, _key string, _pattern string")


def indexable(paths: DataFrame, exts: DataFrame, rules: DataFrame) -> DataFrame:
    """P5: paths (root_id, path, ...) with `indexable`: never below a gate, never on a deny rule, else on an allow rule or by extension.

    Up to RULES rules become an expression. More are keyed by a literal of their glob (glob_key), and a path meets only the rules
    of its own root whose key it has; then the pattern decides. Rules whose glob has no literal to go by are an expression, as
    long as they are few, and meet all paths of their root beyond that."""
    few = rules.select("root_id", "path_glob", "action").limit(RULES + 1).collect()
    if len(few) <= RULES:
        deny, allow = _by_rules(paths, [(r["root_id"], r["path_glob"], r["action"]) for r in few])
        ruled = paths.withColumn("_deny", deny).withColumn("_allow", allow)
    else:
        keyed = stored(with_patterns(rules))
        wide = keyed.filter("_key = ''").select("root_id", "path_glob", "action").limit(RULES + 1).collect()
        deny, allow = _by_rules(paths, [(r["root_id"], r["path_glob"], r["action"]) for r in wide]) if len(wide) <= RULES else (F.lit(False), F.lit(False))
        own = path_keys(F.col("path")) if len(wide) <= RULES else F.concat(path_keys(F.col("path")), F.array(F.lit("")))
        met = paths.select("root_id", "path").distinct().withColumn("_key", F.explode(own)).join(keyed, ["root_id", "_key"]).filter(F.expr("path rlike _pattern"))
        hits = met.groupBy("root_id", "path").agg(F.bool_or(F.col("action") == "deny").alias("_denied"), F.bool_or(F.col("action") == "allow").alias("_allowed"))
        ruled = paths.join(hits, ["root_id", "path"], "left").withColumn("_deny", deny | F.coalesce("_denied", F.lit(False))).withColumn("_allow", allow | F.coalesce("_allowed", F.lit(False))).drop("_denied", "_allowed")
    named = ruled.withColumn("_e", path_ext(F.col("path"))).join(_enabled(exts), F.col("_e") == F.col("_ext"), "left")
    yes = ~is_gated(F.col("path")) & ~F.coalesce("_deny", F.lit(False)) & (F.coalesce("_allow", F.lit(False)) | F.col("_ext").isNotNull())
    return named.withColumn("indexable", yes).drop("_deny", "_allow", "_e", "_ext")


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text has anything but white space."""
    return df.filter(F.col(text).rlike(r"(?U)[^\s\x1c-\x1f]"))


def events_to_jobs(events: DataFrame, exts: DataFrame, rules: DataFrame) -> DataFrame:
    """P10: file events as jobs: root_id, path, op, priority, detected_at, seq. Stateless, so streams take it too."""
    rows = indexable(events, exts, rules)
    a_file = ~F.coalesce(F.col("is_dir").cast("boolean"), F.lit(False))
    op = F.when(F.col("op") == "root_removed", "retire_root").when(a_file & (F.col("op") == "delete"), "delete").when(a_file & F.col("op").isin("create", "modify", "rename") & F.col("indexable"), "index")
    rows = rows.withColumn("job_op", op).filter(F.col("job_op").isNotNull())
    retire = F.col("job_op") == "retire_root"
    return rows.select("root_id", F.when(retire, "").otherwise(F.col("path")).alias("path"), F.col("job_op").alias("op"), F.when(retire, 50).otherwise(100).alias("priority"), "detected_at", "seq")
