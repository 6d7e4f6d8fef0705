"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list, skipping stale entries;
decoding concatenates vocabulary strings.

The vocabulary file (byte-level BPE, JSON) is read on each worker from its path, a parameter. Whole texts are encoded:
added tokens are found first, the rest is split into pieces by the tokenizer's pattern, and every piece is merged by itself,
so memory is that of one text. Pieces repeat; a worker remembers up to PIECES_KEPT of them.

A vocabulary with other settings than those of SETTINGS (a normaliser, a prefix space, another splitting, dropout, added tokens that strip
or that want whole words) is refused by name when it is read, as its ids would differ.

Defined results: null is the empty text, with no ids; repeated rows, and null or repeated ids, are encoded each; a very long text is
encoded whole, and a very long piece (letters without a break) is merged as one, by its queue, without being remembered; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of at most PIECE bytes that a worker remembers; older ones go when there are more.
PIECES_KEPT, PIECE = 300_000, 64
# The settings that a vocabulary may have, as the file names them, and the pattern of byte-level BPE vocabularies.
SETTINGS = {"normalizer": (None,), "model.type": ("BPE",), "model.dropout": (None, 0, 0.0), "model.continuing_subword_prefix": (None, ""), "model.end_of_word_suffix": (None, ""), "model.byte_fallback": (None, False), "model.ignore_merges": (None, False), "pre_tokenizer.type": ("ByteLevel",), "pre_tokenizer.add_prefix_space": (False,), "pre_tokenizer.use_regex": (None, True), "decoder.type": ("ByteLevel",)}
ADDED = {"single_word": (None, False), "lstrip": (None, False), "rstrip": (None, False)}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def checked(spec: dict) -> dict:
    """spec, if the vocabulary has no settings but those that Codec follows; else an error that names the first other one."""
    for name, fine in SETTINGS.items():
        value = spec
        for part in name.split("."):
            value = (value or {}).get(part)
        if value not in fine:
            raise ValueError(f"vocabulary setting {name} is {value!r}, not one of {fine}")
    for token in spec.get("added_tokens") or []:
        for name, fine in ADDED.items():
            if token.get(name) not in fine:
                raise ValueError(f"added token {token['content']!r}: {name} is {token[name]!r}, not one of {fine}")
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    if missing := [c for c in letters if c not in vocab]:
        raise ValueError(f"vocabulary has no token for the bytes {[letters[c] for c in missing]}")
    return spec


class Codec:
    """Encodes and decodes with the vocabulary at path."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        letters, model = byte_letters(), spec["model"]
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.is_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN)
        size = max([*vocab.values(), *self.added.values()]) + 1
        strings = [b""] * size
        for token, i in vocab.items():
            strings[i] = token
        for token, i in self.added.items():
            strings[i] = token.encode()
        self.strings = strings
        self.kept: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. Each queue entry is (rank, place, left id, right id, merged id); one whose ids are no longer there is stale."""
        ids, n, ranks = [self.single[b] for b in piece], len(piece), self.ranks
        if n == 1:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if found := ranks.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def piece_ids(self, piece: str) -> bytes:
        data = piece.encode()
        out = np.array(self.merge(data), "<u4").tobytes()
        if len(data) <= PIECE:
            if len(self.kept) >= PIECES_KEPT:
                for key in list(self.kept)[: PIECES_KEPT // 2]:
                    del self.kept[key]
            self.kept[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.is_added.split(text) if self.is_added and any(t in text for t in self.added) else [text]
        out, kept = [], self.kept
        for part in parts:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                for piece in self.pieces.findall(part):
                    out.append(kept.get(piece) or self.piece_ids(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for path, built once."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (text). One narrow pass; nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, made beside the encoding so that ids and texts need not leave the worker."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
