"""Quality classifier by Bradley-Terry pairwise ranking: document scores are learned from preference pairs (a document of label 1
beats one of label 0) by logistic loss on the differences of their features, and a quantile of the scores is the threshold.

Features of a text: its characters are turned into kinds (small and capital letters, digits, white space by kind, each ASCII sign
by itself), and the shares of the runs of 1 to 3 kinds, hashed into BUCKETS, tell how the text is written, in whatever language;
beside them a few figures of words and lines (MEASURES), scaled by the sample. A score is linear in the features, so that the
logistic loss of a pair is that of their difference, and no bias is learned.

Training takes a bounded sample: SAMPLE labelled rows, half of them of each label if there are as many, one document each, drawn by
a hash; whole texts, which tasks turn into at most BUCKETS shares. A fifth of it is left out of the pairs and finds the threshold:
the quantile of its scores that parts the labels best (balanced accuracy; the middle of all places that are as good). Scores told are
logistic in the distance from that quantile, which itself is told as CUT. Scoring takes every whole text, and only the text.

Defined results: a null text is the empty text, which has a score like others (that of no features at all); without labelled
rows of both labels every score is 0; labels that are null or neither 0 nor 1 are not learned from, nor are held-out rows; of
repeated labels or documents of one doc_id one is learned from; null ids are neither held out nor learned from; repeated rows are scored
each; a very long text is read whole, in slices; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Labelled rows of the sample, and pairs that are compared, in steps of so many.
SAMPLE, PAIRS, STEP = 4000, 120_000, 200
#: Buckets of the runs of 1 to RUN kinds of characters; code points that are hashed at once.
BUCKETS, RUN, SLICE = 4096, 3, 300_000
#: Figures of words and lines beside them; see measures().
MEASURES = 8
#: What the threshold is told as, and how far from it, in standard deviations of the sample's scores, the told score's odds grow by e.
CUT, SPREAD = 0.7, 0.25
RATE, DECAY, SEED = 0.5, 1e-4, 11
#: Code points whose kind is looked up; those beyond are letters without case.
KNOWN = 0x3000


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def kind(c: str) -> int:
    """Signs of ASCII are kinds of their own; others go by their Unicode category."""
    category = unicodedata.category(c)
    if category[0] == "L":
        return 1 if category == "Lu" or category == "Lt" else 2
    if category[0] == "N":
        return 3
    if c in " \n\t":
        return 4 + " \n\t".index(c)
    if c < "\x7f" and category[0] in "PS":
        return ord(c)
    return {"P": 8, "S": 9, "Z": 4, "M": 2}.get(category[0], 10)


_kinds: list[np.ndarray] = []


def kinds(text: str) -> np.ndarray:
    if not _kinds:
        _kinds.append(np.array([kind(chr(i)) for i in range(KNOWN)] + [2], np.uint32))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _kinds[0][np.minimum(points, KNOWN)]


def runs(text: str) -> np.ndarray:
    """How often each bucket's runs of kinds occur, with a space on both sides of the text."""
    counts = np.zeros(BUCKETS)
    whole = f" {text} "
    for at in range(0, len(whole), SLICE):
        k = kinds(whole[at : at + SLICE + RUN - 1])
        for n in range(1, RUN + 1):
            m = min(len(k) - n + 1, SLICE)  # runs that start here; they end in the next slice at the latest
            if m > 0:
                h = k[:m] + np.uint32(n)
                for j in range(1, n):
                    h = h * np.uint32(0x9E3779B1) + k[j : m + j] * np.uint32(0x85EBCA77)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                counts += np.bincount((h >> np.uint32(16)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def measures(text: str) -> list[float]:
    words, lines = text.split(), text.split("\n")
    if not words:
        return [0.0] * MEASURES
    n, sizes = len(words), [len(w) for w in words]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct, known = len(set(words)), len(set(lines))
    return [
        again / n, np.log1p(distinct) / np.log1p(n), np.log1p(n), sum(sizes) / n, max(sizes) ** 0.5,
        known / len(lines), np.log1p(len(text) / len(lines)), sum(w.isupper() for w in words) / n,
    ]


def features(text: str | None) -> np.ndarray:
    """The roots of the buckets' shares, then the measures; nothing but zeros for a text without words."""
    text = text or ""
    out = np.zeros(BUCKETS + MEASURES, np.float32)
    own = measures(text)
    if any(own):
        counts = runs(text)
        out[:BUCKETS] = np.sqrt(counts / counts.sum())
        out[BUCKETS:] = own
    return out


class Model:
    """A weight for each feature, the threshold, and the distance from it over which the told odds grow by e."""

    def __init__(self, weights: np.ndarray | None, threshold: float = 0.0, spread: float = 1.0, level: float = 0.0):
        self.weights, self.threshold, self.spread, self.level = weights, threshold, spread, level

    def raw(self, x: np.ndarray) -> float:
        return float(x.astype(np.float64) @ self.weights)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        odds = (self.raw(features(text)) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-odds))) if odds > -700 else 0.0


def ranked(x: np.ndarray, better: np.ndarray) -> np.ndarray:
    """The weights of the Bradley-Terry model over rows x: gradient steps, scaled by what each weight has moved (Adagrad), on the
    logistic loss of pairs of a better and a worse row."""
    rng = np.random.default_rng(SEED)
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    weights, moved = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    steps = PAIRS // STEP
    for step in range(steps):
        difference = x[rng.choice(good, STEP)] - x[rng.choice(bad, STEP)]
        lost = 1 / (1 + np.exp(np.clip(difference @ weights, -500, 500)))
        slope = -(lost @ difference) / STEP + DECAY * weights
        moved += slope * slope
        weights -= RATE * (1 - step / steps) * slope / np.sqrt(moved)
    return weights


def parted(scores: np.ndarray, better: np.ndarray) -> tuple[float, float]:
    """(threshold, its level): the quantile of the scores that parts better from worse rows with the best balanced accuracy; of
    quantiles as good, the middle one."""
    order = np.argsort(scores, kind="stable")
    s, b = scores[order], better[order]
    right = (np.concatenate([[0], np.cumsum(~b)]) / max(1, (~b).sum()) + (b.sum() - np.concatenate([[0], np.cumsum(b)])) / max(1, b.sum())) / 2
    right[1:-1][s[1:] == s[:-1]] = -1  # rows of one score aren't parted
    best = np.flatnonzero(right >= right.max() - 1e-12)
    i = int(best[len(best) // 2])
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    return float(edges[i]), i / len(s)


def train(x: np.ndarray, better: np.ndarray) -> Model:
    if not better.any() or better.all():
        return Model(None)
    x = x.copy()
    spread = x[:, BUCKETS:].std(axis=0)
    scale = np.where(spread > 0, 0.1 / np.where(spread > 0, spread, 1), 0).astype(np.float32)
    x[:, BUCKETS:] *= scale
    held = np.random.default_rng(SEED).permutation(len(x)) < len(x) // 5
    if len(set(better[~held])) < 2 or len(set(better[held])) < 2:
        held[:] = False
    weights = ranked(x[~held], better[~held])
    weights[BUCKETS:] *= scale
    x[:, BUCKETS:] /= np.where(scale > 0, scale, 1)
    scores = x.astype(np.float64) @ weights
    apart = held if held.any() else ~held
    threshold, level = parted(scores[apart], better[apart])
    return Model(weights, threshold, max(SPREAD * float(scores.std()), 1e-9), level)


def sampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, better, buckets, shares, measures of the bounded sample: SAMPLE rows at most, whatever repeats."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    # a hash lets about twice as many rows of each label through as are wanted; only those are ordered and cut
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    few = min(counts.get(0, 0), counts.get(1, 0), SAMPLE // 2)
    share = {q: int(min(1.0, 2 * (SAMPLE - few) / max(n, 1)) * (1 << 30)) for q, n in counts.items()}
    first = W.partitionBy("quality").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
    some = usable.filter(drawn < F.when(F.col("quality") == 1, share.get(1, 0)).otherwise(share.get(0, 0))).dropDuplicates(["doc_id", "quality"])
    some = some.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= SAMPLE - few)
    some = some.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = F.broadcast(cut(some.coalesce(1)))  # SAMPLE rows of two numbers each, twice at most

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = np.stack([features(t.as_py()) for t in part.column("text")])
                buckets = [np.flatnonzero(row[:BUCKETS]) for row in x]
                packed = [[i.astype("<u2").tobytes() for i in buckets], [row[i].tobytes() for row, i in zip(x, buckets, strict=True)], [row[BUCKETS:].tobytes() for row in x]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *(pa.array(c, pa.binary()) for c in packed)], ["doc_id", "quality", "buckets", "shares", "measures"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    rows = rows.mapInArrow(counted, "doc_id long, quality int, buckets binary, shares binary, measures binary")
    return rows.groupBy("doc_id").agg(F.min(F.struct("quality", "buckets", "shares", "measures")).alias("r")).select("doc_id", "r.*")


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    table = sampled(documents, labels).toArrow().sort_by("doc_id")
    x = np.zeros((table.num_rows, BUCKETS + MEASURES), np.float32)
    for row, b, s, m in zip(x, *(table.column(c) for c in ("buckets", "shares", "measures")), strict=True):
        row[np.frombuffer(b.as_py(), "<u2")] = np.frombuffer(s.as_py(), "<f4") if len(b.as_py()) else 0
        row[BUCKETS:] = np.frombuffer(m.as_py(), "<f4")
    return train(x, table.column("quality").to_numpy() == 1)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row; a narrow pass. Workers get the weights, one for each of BUCKETS + MEASURES features."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([sent.value.score(t.as_py()) for t in b.column("text")], pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents (doc_id, text); labels: doc_id, quality."""
    rows = scored(documents, learn(documents, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
