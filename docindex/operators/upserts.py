"""Keyed upserts and deletes (U1-U8), from snapshot to snapshot: pure functions, so a retry gives the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import drop_blank


def last_per_key(new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the last by `order` (default: all columns, so that the choice is the same on each run)."""
    if not order:
        return new.dropDuplicates(keys) if set(keys) == set(new.columns) else _last(new, keys, [c for c in new.columns if c not in keys])
    return _last(new, keys, order)


def _last(new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    comparable = [c for c in order if not new.schema[c].dataType.typeName().startswith(("map", "variant"))]
    whole = F.struct(*[c for c in new.columns if c not in keys])
    return new.groupBy(*keys).agg(F.max_by(whole, F.struct(*comparable)).alias("_r")).select(*keys, "_r.*").select(new.columns)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't new, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose whole key isn't in `gone`."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All points of the new files are replaced."""
    return replace_by_key(old, new, ["file_id"])


upsert_captions = upsert_chunks


def upsert_memory(old: DataFrame, new: DataFrame) -> DataFrame:
    """By point id only, so an older longer session keeps its later chunks. Blank texts don't come in."""
    return replace_by_key(old, last_per_key(drop_blank(new), ["point_id"]), ["point_id"])


def upsert_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every chunk of the new notes goes first, also where only blank chunks came."""
    fresh = last_per_key(drop_blank(new), ["point_id"])
    return delete_keys(old, new, ["user_id", "note_id"]).unionByName(fresh, allowMissingColumns=True)


def delete_memory(memory: DataFrame, gone: DataFrame) -> DataFrame:
    return delete_keys(memory, gone, ["user_id", "session_id"])


def delete_note(notes: DataFrame, gone: DataFrame) -> DataFrame:
    return delete_keys(notes, gone, ["user_id", "note_id"])


def delete_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return delete_keys(chunks, gone, ["file_id"])


def set_chunk_roots(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (file_id, new_roots, at): empty roots tombstone a file's chunks at `at`, others restore them. Of several updates
    of a file the latest counts, and of those of one time the last by its roots."""
    u = last_per_key(updates.select("file_id", "new_roots", "at"), ["file_id"], ["at", "new_roots"]).select("file_id", F.col("new_roots").alias("_roots"), F.col("at").alias("_at"), F.lit(True).alias("_hit"))
    empty = F.size("_roots") == 0
    out = chunks.join(u, "file_id", "left")
    return out.withColumns({"root_ids": F.when(F.col("_hit"), F.col("_roots")).otherwise(F.col("root_ids")), "tombstoned_at": F.when(F.col("_hit"), F.when(empty, F.col("_at"))).otherwise(F.col("tombstoned_at"))}).select(chunks.columns)


#: What re-indexing a known file sets; its hash, vector count and error stay.
RENEWED = ("size", "mime", "modalities_done", "parser_version", "indexed_at")


def upsert_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known files get the new RENEWED columns and lose their tombstone; new files come in whole. Of several new rows of a file the
    one indexed last counts."""
    first = [c for c in ("indexed_at",) if c in new.columns]
    n = last_per_key(new, ["file_id"], first + [c for c in new.columns if c not in ("file_id", *first)]).select("file_id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in new.columns if c != "file_id"])
    both = old.withColumn("_old", F.lit(True)).join(n, "file_id", "full_outer")

    def column(c: str) -> Column:
        own, fresh = F.col(c), F.col(f"_{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        if c in RENEWED:
            return F.when(F.col("_new"), fresh).otherwise(own)
        if c == "tombstoned_at":
            return F.when(F.col("_new").isNull(), own)
        first = F.coalesce(fresh, F.lit(0)) if c == "vector_count" else fresh
        return F.when(F.col("_old"), own).otherwise(first)

    return both.select("file_id", *[column(c).alias(c) for c in old.columns if c != "file_id"]).select(old.columns)


def upsert_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """U8: by (root_id, path)."""
    return replace_by_key(old, last_per_key(new, ["root_id", "path"]), ["root_id", "path"])
