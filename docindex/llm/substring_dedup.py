"""Substring dedup by difference-cover anchors: windows of words are hashed only at cover positions modulo a period; any
long match shares an aligned anchor, and from its anchors it is extended to whole windows.

With a difference cover D of a period v, any two places i and j have a shift k < v with (i + k) mod v and (j + k) mod v both in
D. So two equal runs of `window` words share an equal anchor of window - v + 1 words that starts at cover positions of both
documents. Only anchors are shuffled at first (a quarter of the places for 35 words); the windows around anchors that occur
twice are then compared whole, by 128-bit hashes, and no pairs are ever formed.

Documents with equal texts count once: where there are several, all their words repeat, and beyond that only what other texts
share with them matters. (Texts are told apart by 128 bits.) Occurrences of one hash are counted where they are met first: a task sends one row per hash and batch, and what occurs twice
inside a batch is known to repeat without leaving it, as does all that the task meets of it afterwards. A passage that a third of all
documents share thus sends one row per task, not one per document; one that no batch (a million words) holds twice has few rows. Each document's repeated places come back to it by a key of its content, and its words are
removed in one pass.

Defined results: null is a text without words; documents shorter than a window keep all words; repeated rows repeat each
other's windows, so all their words go; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hashed_words, mixed, packed_text, rolling, unpacked

WINDOW, SEED = 35, 29
#: Words that are put together before hashes are counted in a task.
BATCH_WORDS = 1_000_000
#: Hashes that a task remembers as repeating.
HEADS = 1_000_000
# Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of two fifths of a window, and its difference cover."""
    period = max(v for v in COVERS if v <= max(1, window * 3 // 5))
    return period, COVERS[period]


def anchor_places(n: int, window: int) -> np.ndarray:
    """Where the anchors of a document of n words start."""
    period, places = cover(window)
    last = n - (window - period + 1)
    return np.flatnonzero(np.isin(np.arange(max(0, last + 1)) % period, places)) if n >= window else np.empty(0, np.int64)


class Heads:
    """Pairs of hashes that a task has already told to repeat: HEADS of them, of which the older half goes when there are more."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def has(self, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
        pairs, out = as_pairs(keys, second), np.zeros(len(keys), bool)
        for part in self.parts:
            at = np.minimum(np.searchsorted(part["key"], keys), len(part) - 1)
            out |= part[at] == pairs
        return out

    def add(self, keys: np.ndarray, second: np.ndarray) -> None:
        """Pairs that aren't there yet. Of pairs with one key the first is remembered."""
        if len(keys):
            pairs = np.sort(as_pairs(keys, second), order=("key", "second"))
            self.parts.append(pairs[np.unique(pairs["key"], return_index=True)[1]])
            if len(self.parts) > 8:  # few parts, so that looking up stays quick
                self.parts[:] = [self.joined(self.parts)]
            if sum(map(len, self.parts)) > HEADS:
                del self.parts[: max(1, len(self.parts) // 2)]

    @staticmethod
    def joined(parts: list[np.ndarray]) -> np.ndarray:
        pairs = np.sort(np.concatenate(parts), order=("key", "second"))
        return pairs[np.unique(pairs["key"], return_index=True)[1]]


def as_pairs(keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), [("key", np.uint64), ("second", np.uint64)])
    out["key"], out["second"] = keys, second
    return out


def counted(keys: np.ndarray, second: np.ndarray, doc: np.ndarray, place: np.ndarray, told: Heads | None = None) -> pa.RecordBatch:
    """Rows of one batch: (key, second, doc, place, run). told: what earlier batches of the task have told to repeat.

    An occurrence alone in its batch goes out under its key. For one that isn't, the key goes out once without a document
    (twice is enough to know), and the known repeats go out under a key of their own, in runs of neighbouring places."""
    order = np.lexsort((second, keys))
    k, s = keys[order], second[order]
    same = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    again = np.zeros(len(k), bool)
    again[1:] |= same
    again[:-1] |= same
    heads = order[again & np.concatenate([[True], ~same])] if len(k) else order
    if told is not None:
        again |= told.has(k, s)
        heads = heads[~told.has(keys[heads], second[heads])]
        told.add(keys[heads], second[heads])
    alone = order[~again]
    known = np.sort(order[again])
    d, p = doc[known], place[known]
    start = np.ones(len(known), bool)
    start[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (known[1:] != known[:-1] + 1)
    at = np.flatnonzero(start)
    runs = np.diff(np.append(at, len(known)))
    first = known[at]
    own = mixed(doc[first].view(np.uint64) + mixed(place[first].astype(np.uint64)))
    n, m = len(alone), len(heads)
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array(np.concatenate([keys[alone], keys[heads], own]).view(np.int64)),
            "second": pa.array(np.concatenate([second[alone], second[heads], np.zeros(len(at), np.uint64)]).view(np.int64)),
            "doc": pa.array(np.concatenate([doc[alone], doc[heads], doc[first]]), mask=np.repeat([False, True, False], [n, m, len(at)])),
            "place": pa.array(np.concatenate([place[alone], place[heads], place[first]]).astype(np.int32)),
            "run": pa.array(np.concatenate([np.ones(n), np.zeros(m), -runs]).astype(np.int32)),
        }
    )


OCCURRENCES = "key long, second long, doc long, place int, run int"


def _emit(pending: list[tuple], size: int, told: Heads) -> Iterator[pa.RecordBatch]:
    if size:
        keys, second, doc, place = (np.concatenate(x) for x in zip(*pending, strict=True))
        rows = counted(keys, second, doc, place, told)
        for at in range(0, rows.num_rows, 50_000):
            yield rows.slice(at, 50_000)


def fresh(docs: list[int], met: set[int]) -> pa.Array:
    """Which texts of a batch come first in the task; copies are passed over (those of other tasks don't count as repeats either)."""
    out = np.zeros(len(docs), bool)
    for i, doc in enumerate(docs):
        if doc not in met:
            if len(met) >= 1_000_000:
                met.clear()
            met.add(doc)
            out[i] = True
    return pa.array(out)


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """Occurrences of all anchors of docs (doc, text)."""
    period, _ = cover(window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size, words_in, met, told = [], 0, 0, set(), Heads()
        for b in batches:
            new = fresh(b.column("doc").to_pylist(), met)
            doc, texts = b.column("doc").filter(new).to_numpy(), b.column("text").filter(new)
            for first, words, firsts in hashed_words(texts):
                hashes = rolling(words, window - period + 1)
                for d, a, z in zip(doc[first:].tolist(), firsts[:-1].tolist(), firsts[1:].tolist(), strict=False):
                    if z - a < window:
                        continue
                    at = anchor_places(z - a, window)
                    pending.append((hashes[a + at], np.zeros(len(at), np.uint64), np.full(len(at), d, np.int64), at))
                    size, words_in = size + len(at), words_in + z - a
                if words_in >= BATCH_WORDS:
                    yield from _emit(pending, size, told)
                    pending, size, words_in = [], 0, 0
        yield from _emit(pending, size, told)

    return docs.mapInArrow(work, OCCURRENCES)


def windows(docs: DataFrame, window: int) -> DataFrame:
    """Occurrences of the windows of docs (doc, packed, runs of places of repeated anchors) around those anchors, by 128 bits."""
    period, _ = cover(window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size, met, told = [], 0, set(), Heads()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                part = part.filter(fresh(part.column("doc").to_pylist(), met))
                texts, doc, found = pa.array(unpacked(part.column("packed")), pa.large_binary()), part.column("doc").to_pylist(), part.column("runs").to_pylist()
                for (first, words, firsts), (_, others, _) in zip(hashed_words(texts), hashed_words(texts, seed=1), strict=True):
                    keys, second = rolling(words, window), rolling(others, window)
                    for d, runs, a, z in zip(doc[first:], found[first:], firsts[:-1].tolist(), firsts[1:].tolist(), strict=False):
                        near = covered(z - a, runs, 1)
                        before = np.concatenate([[0], np.cumsum(near)])
                        p = np.arange(z - a - window + 1)
                        p = p[before[np.minimum(p + period, z - a)] > before[p]]
                        pending.append((keys[a + p], second[a + p], np.full(len(p), d, np.int64), p))
                        size += len(p)
                    if size >= BATCH_WORDS // 2:
                        yield from _emit(pending, size, told)
                        pending, size = [], 0
        yield from _emit(pending, size, told)

    return docs.mapInArrow(work, OCCURRENCES)


def repeated(occurrences: DataFrame) -> DataFrame:
    """doc and runs (array of place, length) of the occurrences whose key occurs more than once in one text, or in several."""
    by = W.partitionBy("key", "second")
    rows = occurrences.withColumns({"least": F.min("doc").over(by), "most": F.max("doc").over(by), "known": F.min("run").over(by) == 0})
    rows = rows.filter(F.col("doc").isNotNull() & ((F.col("run") < 0) | (F.col("least") != F.col("most")) | F.col("known")))
    return rows.groupBy("doc").agg(F.collect_set(F.struct("place", F.abs("run").alias("length"))).alias("runs"))


def by_text(docs: DataFrame) -> DataFrame:
    """docs (doc, doc2: two hashes of the text) with a `doc` of its own for every text: of texts that share one, all but the one of
    least doc2 take a hash of both. (About none do; they are looked for, so that none is taken for another's copy.)"""
    shared = cut(docs.groupBy("doc").agg(F.min("doc2").alias("lo"), F.max("doc2").alias("hi")).filter("lo <> hi").select("doc", "lo"))
    if shared.isEmpty():
        return docs.drop("doc2")
    other = F.col("lo").isNotNull() & (F.col("doc2") != F.col("lo"))
    return docs.join(shared, "doc", "left").withColumn("doc", F.when(other, F.xxhash64("doc", "doc2")).otherwise(F.col("doc"))).drop("doc2", "lo")


def covered(n: int, runs: list[dict] | None, width: int) -> np.ndarray:
    """Which of n words lie in `width` words from one of the places."""
    edges = np.zeros(n + 1, np.int64)
    if runs:
        place = np.array([r["place"] for r in runs])
        np.add.at(edges, place, 1)
        np.add.at(edges, np.minimum(place + np.array([r["length"] for r in runs]) + width - 1, n), -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with texts the kept text) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = by_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc"), F.xxhash64(F.lit(SEED), text).alias("doc2"), "text"))
    found = repeated(anchors(keyed.select("doc", F.col("text").cast("binary").alias("text")), window))
    packed = packed_text(keyed, ["doc_id", "doc"])
    again = repeated(windows(packed.join(found, "doc"), window))
    copied = keyed.groupBy("doc").count().filter("count > 1").select("doc", F.lit(True).alias("copied"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for text, runs, copies in zip(unpacked(part.column("packed")), part.column("runs").to_pylist(), part.column("copied").to_pylist(), strict=True):
                    words = text.split()
                    if copies and len(words) >= window:
                        gone, kept = np.ones(len(words)), b""
                    elif runs:
                        gone = covered(len(words), runs, window)
                        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    else:
                        gone, kept = np.zeros(0), b" ".join(words)
                    rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
                n, r, sha, kept = zip(*rows)
                out = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = packed.join(again, "doc", "left").join(copied, "doc", "left").mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")
