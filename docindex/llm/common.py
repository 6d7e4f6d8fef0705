"""What the operators share: finding and hashing words, and cutting a lineage through a table in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Java and Python form of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that are hashed together, and of words in one run of prefix sums; a longer text or word is taken alone.
SLICE_BYTES, RUN_BYTES = 1_000_000, 250_000


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns its reader: later stages survive lost executors without this lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docindex-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table behind a cut() that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns beside those of docs: the given ones, with underscores in front as far as docs has them (whatever
    the case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame) -> list:
    """The columns of docs, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def lower_ascii(col):
    """A-Z lower-cased, nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64; kept up to a million."""
    if not _powers or len(_powers[0]) < n:
        pair = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, 4096), base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        if n > 1_000_000:
            return pair[0][:n], pair[1][:n]
        _powers[:] = pair
    return _powers[0][:n], _powers[1][:n]


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, from the words' hashes: differences of prefix sums of a polynomial modulo 2**64."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty), and where each value starts in them, with the end of the last."""
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    column = column.cast(pa.large_binary() if large else pa.binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return all_bytes[edges[0] : edges[-1]], edges - edges[0]


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space) of the texts in data, and each text's first word, with the end of
    the last."""
    word = ~_IS_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, edges)


def hash_tables(lower: bool, seed: int) -> np.ndarray:
    """A 64-bit number for each byte; those of A-Z are those of a-z if lower."""
    t = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed * 0x5851F42D4C957F2D & (1 << 64) - 1))
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of prefix sums of a polynomial, of RUN_BYTES at a time. Spans are in
    order and don't overlap."""
    table, out, at = hash_tables(lower, seed), np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        till = max(at + 1, int(np.searchsorted(starts, starts[at] + RUN_BYTES)))
        a, b = starts[at], ends[till - 1]
        up, down = powers(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * up, out=sums[1:])
        s, e = starts[at:till] - a, ends[at:till] - a
        out[at:till] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        at = till
    return out


def text_slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of values that hold `most` bytes together (None: SLICE_BYTES), or one longer value."""
    at, sizes = 0, np.diff(bytes_of(column)[1]) if len(column) else np.empty(0, np.int64)
    total = np.cumsum(sizes)
    while at < len(sizes):
        before = total[at - 1] if at else 0
        till = max(at + 1, int(np.searchsorted(total, before + (most or SLICE_BYTES), side="right")))
        yield at, till
        at = till


def hashed_words(column: pa.Array, lower: bool = False, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, word hashes, each text's first word and the end of the last) for slices of a column of texts."""
    for at, till in text_slices(column):
        data, edges = bytes_of(column.slice(at, till - at))
        starts, ends, firsts = word_spans(data, edges)
        yield at, span_hashes(data, starts, ends, lower, seed), firsts


def packed_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns and `packed`: the text (null: empty) as zstd bytes, a third of its size on the way through a shuffle."""
    kept = docs.select(*columns, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("packed"))

    def work(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            i = b.schema.get_field_index("packed")
            yield pa.RecordBatch.from_arrays([pa.array([z.compress(t.as_py()) for t in c], pa.binary()) if k == i else c for k, c in enumerate(b.columns)], schema=b.schema)

    return kept.mapInArrow(work, kept.schema)


def unpacked(column) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [z.decompress(t.as_py()) for t in column]
