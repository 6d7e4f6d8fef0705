"""What the operators on embeddings share: vectors that can be used, and their components as exact whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers stand for components in steps of 1 / STEPS.
STEPS = 256
WIDTHS = ("<i1", "<i2", "<i4", "<i8")
#: Rows that are turned at once.
SLICE = 2048


def finite(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose embedding is no null and holds no null and no non-finite component, as far as they have the length that most
    of these have (of lengths as frequent, the smallest); and that length (0 without rows)."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return (rows.filter(F.size("embedding") == lengths[0]["n"]), lengths[0]["n"]) if lengths else (rows, 0)


def stepped(components: np.ndarray) -> np.ndarray:
    """floor(STEPS * c) of doubles as 64-bit numbers; what doesn't fit becomes the nearest that does."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(STEPS * components), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """The rows of whole numbers as bytes, each in the least width that holds it: equal rows have equal bytes."""
    out: list = [None] * len(x)
    low, high = (x.min(axis=1), x.max(axis=1)) if x.size else (np.zeros(len(x)), np.zeros(len(x)))
    left = np.ones(len(x), bool)
    for width in WIDTHS:
        held = np.iinfo(width)
        now = np.flatnonzero(left & (low >= held.min) & (high <= held.max))
        left[now] = False
        for i, row in zip(now.tolist(), x[now].astype(width), strict=True):
            out[i] = row.tobytes()
    return out


def unpacked(column: pa.Array, length: int) -> np.ndarray:
    """What packed() got, for rows of `length` numbers."""
    values = column.to_pylist()
    out, sizes = np.zeros((len(values), length), np.int64), np.array([len(v) for v in values], np.int64)
    for width in WIDTHS if length else ():
        now = np.flatnonzero(sizes == length * np.dtype(width).itemsize)
        if len(now):
            out[now] = np.frombuffer(b"".join([values[i] for i in now.tolist()]), width).reshape(len(now), length)
    return out


def as_numbers(rows: DataFrame) -> DataFrame:
    """rows (embedding: finite(), any other columns) with `x`, its packed() whole numbers, in the embedding's place."""
    others = [c for c in rows.columns if c != "embedding"]
    schema = rows.select(*others, F.lit(b"").alias("x")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                x = stepped(b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(packed(x), pa.binary())], [*others, "x"])

    return rows.select(*others, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(work, schema)
