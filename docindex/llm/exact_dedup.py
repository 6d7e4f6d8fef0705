"""Exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests; positives join exact buckets
for byte checks, while duplicates inside the new batch are grouped separately.

Texts are equal when identical after white space [\\x20\\x09-\\x0D] is deleted; null counts as empty. Each batch is first
reduced to one row per digest (partial aggregation, so a group with a third of all rows leaves one row per task). The
snapshot is laid out by digest in exact buckets, and has a filter for about every BUCKET digests, built once and kept beside it; an
incoming digest that its filter rejects is certainly new and meets nothing else. The others are looked up in the exact
buckets by the whole 32-byte SHA-256.

Defined results: empty texts form one group; ties in length go to the smallest doc_id (null last), then to one of the
repeated rows; a very long text is one value, hashed by itself; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layout import clustered, open_clustered
from .common import cut, mixed, own_columns, unused

#: Distinct digests that one filter holds on average, and an exact bucket; exact buckets of a snapshot at least.
BUCKET, STORED, LEAST = 50_000, 2_000_000, 16
#: Groups of more than 1 / HOT of all rows are large.
HOT = 1000
#: Bits of a fingerprint; 2**-8 of the new digests pass by chance and are found out by the exact join.
FINGERPRINT = np.uint8


def normalised(text):
    """The text without white space, by plain searches (faster than a pattern)."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the original), digest; row_no tells repeated rows apart once the table is cut."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).alias("n_points"),
        F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def grouped(batch: DataFrame) -> DataFrame:
    """One row per digest of a batch: its size n and its best row."""
    best = F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("low_id"), F.bitwise_not("row_no").alias("low_row"))
    return batch.groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("n"))


def positions(keys: np.ndarray, seed: int, segment: int, segments: int) -> list[np.ndarray]:
    """Three cells of each key, in three neighbouring segments."""
    h = mixed(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    inside = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
    mask = np.uint64(segment - 1)
    return [(first + k) * segment + ((inside >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(3)]


def fingerprints(keys: np.ndarray, seed: int) -> np.ndarray:
    return mixed(keys ^ np.uint64(seed + 0x1234567)).astype(FINGERPRINT)


def fuse(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """seed, segment length, starting segments and cells of a binary-fuse filter over distinct keys.

    Peeling goes in rounds: all keys that are alone in a cell go at once, and get their cell in the reverse order."""
    n = len(keys)
    segment = 1 << max(2, min(14, int(np.log2(max(n, 2)) / 1.74 + 2.25)))
    capacity = max(4 * segment, int(n * (1.125 + 0.25 * max(0.0, 1.0 - np.log10(max(n, 10)) / 6)) + 8))
    for seed in range(1, 100):
        segments = max(1, -(-capacity // segment) - 2)
        cells = (segments + 2) * segment
        where = np.stack(positions(keys, seed, segment, segments)) if n else np.empty((3, 0), np.int64)
        degree = np.bincount(where.ravel(), minlength=cells)
        owners = np.zeros(cells, np.int64)
        for row in where:
            np.bitwise_xor.at(owners, row, np.arange(n))
        rounds, left = [], n
        alone = np.flatnonzero(degree == 1)
        while len(alone):
            who, at = np.unique(owners[alone], return_index=True)
            rounds.append((who, alone[at]))
            left -= len(who)
            touched = where[:, who]
            for row in touched:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(owners, row, who)
            touched = np.unique(touched)
            alone = touched[degree[touched] == 1]
        if not left:
            break
        capacity = int(capacity * 1.05) + segment
    else:
        raise ValueError("no seed gives a filter; are the keys distinct?")
    out = np.zeros(cells, FINGERPRINT)
    prints = fingerprints(keys, seed)
    for who, own in reversed(rounds):
        a, b, c = where[:, who]
        out[own] = 0
        out[own] = prints[who] ^ out[a] ^ out[b] ^ out[c]
    return seed, segment, segments, out


def maybe_in(keys: np.ndarray, seed: int, segment: int, segments: int, cells: np.ndarray) -> np.ndarray:
    """False only for keys that are certainly not in the filter."""
    a, b, c = positions(keys, seed, segment, segments)
    return fingerprints(keys, seed) == cells[a] ^ cells[b] ^ cells[c]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, segments, cells = fuse(np.unique(pdf["key"].to_numpy().view(np.uint64)))
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": seed, "segment": segment, "segments": segments, "cells": [cells.tobytes()]})


@dataclass
class Snapshot:
    """Groups that don't change any more (digest, best, n), laid out by their digests in `stored_in` exact buckets, and their
    filters, one row for each of the filters' own, smaller buckets."""

    groups: DataFrame
    filters: DataFrame
    stored_in: int

    def save(self, folder: str) -> None:
        self.groups.write.format("parquet").bucketBy(self.stored_in, "digest").sortBy("digest").option("path", f"{folder}/groups").saveAsTable(f"docindex_{uuid.uuid4().hex}")
        self.filters.withColumn("stored_in", F.lit(self.stored_in)).write.parquet(f"{folder}/filters")


def load(spark: SparkSession, folder: str) -> Snapshot:
    """What save() wrote: later batches are screened without building the filters or laying out the groups again."""
    filters = spark.read.parquet(f"{folder}/filters")
    first, schema = filters.select("stored_in").head(), spark.read.parquet(f"{folder}/groups").schema
    if first is None:
        return snapshot_of(spark.createDataFrame([], schema))
    return Snapshot(open_clustered(spark, f"{folder}/groups", schema, ["digest"], first[0]), filters.drop("stored_in"), first[0])


def snapshot_of(groups: DataFrame) -> Snapshot:
    """A snapshot of grouped() rows (cut), with a filter for each of the filters' buckets of their digests."""
    n = groups.count()
    stored_in, buckets = max(LEAST, -(-n // STORED)), max(1, -(-n // BUCKET))
    keyed = groups.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), F.xxhash64("digest", F.lit(1)).alias("key"))
    filters = keyed.groupBy("bucket").applyInPandas(_build, "bucket long, seed int, segment int, segments int, cells binary")
    return Snapshot(clustered(groups, "digest", stored_in), cut(filters.withColumn("buckets", F.lit(buckets).cast("long"))), stored_in)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """incoming (grouped) with `maybe`: whether its digest may be in the filters' snapshot. One shuffle of the incoming groups.

    An incoming bucket holds distinct digests only; it is cut into slices of about BUCKET, each beside a copy of its filter."""
    first = filters.select("buckets").head()
    if first is None:
        return incoming.withColumn("maybe", F.lit(False))
    slices = max(1, -(-incoming.count() // (BUCKET * first[0])))
    keyed = incoming.withColumns({"bucket": F.pmod(F.xxhash64("digest"), F.lit(first[0])), "key": F.xxhash64("digest", F.lit(1)), "slice": F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(slices))})
    copies = filters.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    columns = incoming.columns

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(left.num_rows, bool)
        if right.num_rows and left.num_rows:
            f = right.slice(0, 1).to_pylist()[0]
            found = maybe_in(left.column("key").to_numpy().view(np.uint64), f["seed"], f["segment"], f["segments"], np.frombuffer(f["cells"], FINGERPRINT))
        return left.select(columns).append_column("maybe", pa.array(found))

    schema = incoming.withColumn("maybe", F.lit(True)).schema
    return keyed.groupBy("bucket", "slice").cogroup(copies.groupBy("bucket", "slice")).applyInArrow(look, schema)


def met_and_new(snapshot: Snapshot, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the snapshot's groups with what came to them, the new groups) of an incoming batch (grouped(), cut).

    Digests that the filters let through are looked up in the snapshot's exact buckets, by their 32 bytes: only they travel, into as
    many buckets, and the snapshot's groups stay where they are. What isn't found there came through the filter by chance."""
    screened = cut(screen(incoming, snapshot.filters))
    through = screened.filter("maybe").select("digest", F.col("best").alias("best2"), F.col("n").alias("n2"))
    found = snapshot.groups.join(through.hint("shuffle_merge"), "digest", "left")
    met = found.select("digest", F.greatest("best", F.coalesce("best2", "best")).alias("best"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
    chance = screened.filter("maybe").drop("maybe").hint("shuffle_merge").join(snapshot.groups.select("digest"), "digest", "left_anti")
    return met, screened.filter("not maybe").drop("maybe").unionByName(chance)


def merged(snapshot: Snapshot, incoming: DataFrame) -> DataFrame:
    """Groups of the snapshot and of an incoming batch (grouped(), cut) together."""
    met, new = met_and_new(snapshot, incoming)
    return met.unionByName(new)


def dedup(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, keep_id, group_size, kept, text_sha256, row_no.

    The table is taken in as two batches, by a hash of the id: the first is the snapshot, the second is screened by its filters.
    Rows of groups that hold more than 1 / HOT of all rows, 4 * HOT digests at most, get their group from a broadcast table, so that no
    task gathers a large group; the others are joined by digest with the exact buckets, and with the new groups."""
    rows = cut(digests(docs))
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    first, incoming = cut(grouped(rows.filter(~second))), cut(grouped(rows.filter(second)))
    met, new = met_and_new(snapshot_of(first), incoming)
    least = rows.count() / (2 * HOT)
    hot = F.broadcast(cut(first.filter(F.col("n") > least).select("digest").unionByName(incoming.filter(F.col("n") > least).select("digest")).distinct().coalesce(1)))
    large = F.broadcast(met.join(hot, "digest", "left_semi").unionByName(new.join(hot, "digest", "left_semi")))
    many = rows.join(large, "digest")
    old = met.select("digest", F.col("best").alias("best1"), F.col("n").alias("n1"))
    few = rows.join(hot, "digest", "left_anti").hint("shuffle_merge").join(old, "digest", "left").join(new, "digest", "left")
    few = few.select(*rows.columns, F.coalesce("best1", "best").alias("best"), F.coalesce("n1", "n").alias("n"))
    out = many.select(*few.columns).unionByName(few)
    keep_id = F.when(F.col("best.known"), F.bitwise_not("best.low_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row_no") == F.bitwise_not("best.low_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_no",
    )


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs that dedup() keeps, with all their columns.

    Of rows with one id and one text, which no key tells apart, the longest original stays."""
    of, sha, own, kept, n = unused(docs, "_id", "_sha", "_own", "_kept", "_n")
    rows = dedup(docs).groupBy(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha)).agg(F.bool_or("kept").alias(kept), F.count("*").alias(n))
    gone = cut(rows.filter(~F.col(kept) | (F.col(n) > 1)))
    keyed = docs.withColumn(own, F.sha2(normalised(F.col("text")).cast("binary"), 256))
    # texts are shuffled once, whatever the number of rows that go: the plan is the same at every size
    met = keyed.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(sha)), "left")
    once = met.filter(F.col(sha).isNull()).select(own_columns(docs))
    if gone.filter(kept).isEmpty():
        return once
    twins = met.filter(kept).groupBy(sha).agg(F.max_by(F.struct(*own_columns(docs)), F.char_length(F.coalesce("text", F.lit("")))).alias("r")).select("r.*")
    return once.unionByName(twins)
