"""Token-id / binary output: flat unsigned integer files plus 64-bit document offsets, memory-mapped; partition bases come
from prefix sums.

write() puts documents into ascending doc_id order by a range partitioning, and each task writes one part:
`part-N.ids` (unsigned 16-bit integers where the vocabulary fits, else 32-bit, little-endian, nothing else in it) and
`part-N.idx` (int64: number of documents, their doc_ids, and their offsets in the part with a last one for its end). A part's
name comes from its partition and its content is the same for every attempt; it is written under a name of the attempt and
then renamed, so retries and speculative tasks leave one whole part. Bases of the parts are prefix sums over one row a part.
read() maps a part's files and hands out slices.

The folder has to be one that all executors share; where it is not a mounted file system, slices are read by ranges instead of
being mapped. Texts are encoded by the tokenizers library, in runs between white space and, of these, the tail of punctuation by
itself: both are independent in a vocabulary with the settings below (SETTINGS), and each is asked for once per slice of texts
and remembered by the worker. With a vocabulary of other settings whole texts go to the library.

Defined results: null is the empty text, whose only id is the end id; null doc_ids come first and read back as null; repeated
doc_ids and rows stay, in the order of their texts' hashes; bytes that are no UTF-8 are replaced; a very long text is one slice;
other columns are ignored, whatever their names; an empty table writes no parts.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import byte_letters
from .common import bytes_of, cut, shared_dir, text_slices, word_spans

#: Runs of at most RUN bytes that a worker remembers.
RUNS_KEPT, RUN = 500_000, 48
#: Bytes of texts whose runs are looked up together: the more, the fewer distinct ones to a byte.
SLICE = 3_000_000
# The settings of a vocabulary whose runs are independent. White space only separates; all is lower-cased.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Runs of a-z; of ASCII punctuation without the apostrophe; of Latin letters that lower-casing maps one to one.
LETTERS, PUNCTUATION, LATIN = re.compile(rb"[a-z]+"), re.compile(rb"[!-&(-/:-@\[-`{-~]+"), re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")
#: Begins every added token of such a vocabulary; they are matched before lower-casing.
ADDED = b"<|"
#: Stands for a null doc_id in an index.
NO_ID = -(2**63)

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_PUNCTUATION = np.array([PUNCTUATION.fullmatch(bytes([b])) is not None for b in range(256)])
_STEM_END = np.array([bytes([b]).isalnum() for b in range(256)])


def with_tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of runs end, and where each run's pieces begin among them (with the end of the last): a tail of
    punctuation behind a letter or digit is a piece of its own, but in runs that stay whole."""
    stem = np.maximum.accumulate(np.where(_PUNCTUATION[data], 0, np.arange(1, len(data) + 1)))[ends - 1]
    split = (stem > starts) & (stem < ends) & _STEM_END[data[np.maximum(stem, 1) - 1]] & ~whole
    first = np.concatenate([[0], np.cumsum(1 + split)])
    out = np.empty(first[-1], np.int64)
    out[first[1:] - 1] = ends
    out[first[:-1][split]] = stem[split]
    return out, first


class RunEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct run."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.by_runs = all(spec[k] == v for k, v in SETTINGS.items()) and spec["model"]["type"] == "BPE" and all(ADDED.decode() in t["content"] and not t["normalized"] for t in spec["added_tokens"])
        self.letter = {b: c for c, b in byte_letters().items()}
        self.kept: dict[bytes, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def fresh(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs that aren't remembered. What the library's splitting would leave whole goes to its model alone."""
        out, rest, model, letter = {}, [], self.tokenizer.model, self.letter
        for run in runs:
            if LETTERS.fullmatch(run) or (PUNCTUATION.fullmatch(run) and ADDED not in run):
                out[run] = self.packed([t.id for t in model.tokenize(run.decode())])
                continue
            text = run.decode("utf-8", "replace")
            if LATIN.fullmatch(text):
                out[run] = self.packed([t.id for t in model.tokenize("".join([letter[b] for b in text.lower().encode()]))])
            else:
                rest.append((run, text))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for (run, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False), strict=True):
                out[run] = self.packed(e.ids)
        self.kept.update((run, ids) for run, ids in out.items() if len(run) <= RUN)
        return out

    def _whole(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [(t or b"").decode("utf-8", "replace") for t in column.to_pylist()]
        found = [np.array([*e.ids, end], self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found), np.array([len(f) for f in found])

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts one after the other, each with `end` behind it; how many each has), for slices of a binary column."""
        for at, till in text_slices(column, SLICE):
            part = column.slice(at, till - at)
            yield self._by_runs(part, end) if self.by_runs else self._whole(part, end)

    def _by_runs(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        kept = self.kept
        if len(kept) > RUNS_KEPT:
            for key in list(kept)[: len(kept) // 2]:
                del kept[key]
        data, edges = bytes_of(column)
        starts, ends, firsts = word_spans(data, edges)
        if not len(starts):
            return np.full(len(column), end, self.dtype), np.ones(len(column), np.int64)
        low = _LOWER[data]
        # texts with added tokens keep their case, as those are matched before lower-casing
        odd = np.flatnonzero((data[:-1] == ADDED[0]) & (data[1:] == ADDED[1]))
        for text in np.unique(np.searchsorted(edges, odd, side="right") - 1):
            low[edges[text] : edges[text + 1]] = data[edges[text] : edges[text + 1]]
        whole = np.zeros(len(starts), bool)
        whole[np.searchsorted(starts, odd, side="right") - 1] = True
        piece_ends, first = with_tails(low, starts, ends, whole)
        # pieces without the white space between them
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        offsets = np.concatenate([[0], np.cumsum(inside)[piece_ends - 1]]).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(piece_ends), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        ids = list(map(kept.get, distinct))
        if None in ids:
            new = self.fresh([w for w, x in zip(distinct, ids, strict=True) if x is None])
            ids = [new[w] if x is None else x for w, x in zip(distinct, ids, strict=True)]
        # every occurrence takes the ids of its piece by their places
        all_ids, sizes = np.frombuffer(b"".join(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        which = pieces.indices.to_numpy()
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        tokens = all_ids[np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], n) + np.arange(upto[-1])]
        edges = upto[first[firsts]]
        return np.insert(tokens, edges[1:], self.dtype.type(end)), np.diff(edges) + 1


_encoders: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


def _fs(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def publish(fs, own: str, path: str) -> None:
    """Gives an attempt's file its name. Where a file of that name is there and the file system doesn't replace it, it came from
    another attempt and has the same content: it stays."""
    try:
        fs.move(own, path)
    except OSError:
        if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
            raise
        fs.delete_file(own)


def write(docs: DataFrame, path: str, folder: str, end: int = 1) -> DataFrame:
    """Writes docs' ids below folder; returns the cut manifest: part, n_docs, n_tokens, base (ids before the part)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (fs, where) = encoder(path), _fs(folder)
        part = TaskContext.get().partitionId()
        name, ids, offsets, n = f"{where}/part-{part:06d}", [], [np.zeros(1, np.int64)], 0
        fs.create_dir(where, recursive=True)
        own = uuid.uuid4().hex
        stream = None
        for batch in batches:
            ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
            for tokens, lengths in enc.encode(batch.column("text"), end):
                stream = stream or fs.open_output_stream(f"{name}.ids.{own}")
                stream.write(tokens.tobytes())
                offsets.append(n + np.cumsum(lengths))
                n += len(tokens)
        if stream is None:
            return
        stream.close()
        publish(fs, f"{name}.ids.{own}", f"{name}.ids")
        ids, offsets = np.concatenate(ids), np.concatenate(offsets)
        with fs.open_output_stream(f"{name}.idx.{own}") as f:
            f.write(np.concatenate([[len(ids)], ids, offsets]).astype("<i8").tobytes())
        publish(fs, f"{name}.idx.{own}", f"{name}.idx")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "width": pa.array([enc.dtype.itemsize], pa.int32())})

    parts = cut(ordered.mapInArrow(work, "part long, n_docs long, n_tokens long, width int"))
    base = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("base", base).withColumn("folder", F.lit(folder))


def flat(fs, path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """A function that gives the file's values from one place to another: mapped where it is on a mounted file system, else read
    by that range."""
    if isinstance(fs, pa.fs.LocalFileSystem):
        mapped = np.memmap(path, kind, "r")
        return lambda a, b: mapped[a:b]
    file, width = fs.open_input_file(path), np.dtype(kind).itemsize
    return lambda a, b: np.frombuffer(file.read_at(int(b - a) * width, int(a) * width), kind)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit) of every document, from the files of the manifest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, where = _fs(row["folder"])
                name = f"{where}/part-{row['part']:06d}"
                index, tokens = flat(fs, f"{name}.idx", "<i8"), flat(fs, f"{name}.ids", f"<u{row['width']}")
                n = int(index(0, 1)[0])
                for at in range(0, n, 1000):
                    till = min(at + 1000, n)
                    own, bounds = np.array(index(1 + at, 1 + till)), np.array(index(1 + n + at, 2 + n + till))
                    some, first = tokens(bounds[0], bounds[-1]), bounds[0]
                    sums = [zlib.crc32(some[a:b].astype("<u4").tobytes()) for a, b in zip((bounds[:-1] - first).tolist(), (bounds[1:] - first).tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, pa.int64(), mask=own == NO_ID), "start": pa.array(bounds[:-1] + row["base"], pa.int64()), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    # one part a task: a part is as large as a shuffle partition, while the rows of the manifest are tiny
    parts = manifest.repartitionByRange(max(1, manifest.count()), "part")
    return parts.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
