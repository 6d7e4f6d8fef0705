"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy,
with calibrated rejection.

A text's subwords are the runs of 2, 3 and 4 code points of the lower-cased text, hashed into BUCKETS rows of an embedding
table; the mean of their rows goes through one linear layer and a softmax. Training takes a bounded sample (SAMPLE rows shared by
all languages, at least FEW of each), whole texts, which tasks turn into counts of at most BUCKETS subwords; one task goes through
them, as each step follows from the one before, and the driver gets the model alone. A fifth of the sample calibrates
a temperature and the score below which a prediction is rejected. Prediction takes every whole text, and only the text. Workers get
the embeddings and the layer, or their product where that is smaller: its size depends on the number of languages alone.

Defined results: a text that is null or has no letter is `und` with score 0 and rejected; without labelled rows every text is;
ties between languages go to the first in order; null or repeated doc_ids and repeated rows are predicted like others, and null
ids are neither held out nor learned from; a very long text is hashed whole, in slices; an empty table gives no rows; other
columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import own_columns, unused

#: Rows of the training sample, and of a language at least.
SAMPLE, FEW = 4000, 8
#: Code points of a text that are hashed at once.
SLICE = 300_000
BUCKETS, DIM, RUNS = 1 << 16, 16, (2, 3, 4)
#: Passes over the sample (more over a small one, so that there are STEPS updates), learning rate.
EPOCHS, STEPS, RATE, SEED = 4, 12_000, 8.0, 7
#: A prediction is rejected below the score that this share of rightly predicted calibration texts doesn't reach, and at
#: most below DOUBT, where it is as likely wrong as right.
REJECTED, DOUBT = 0.0005, 0.5
# Odd multipliers of the subword hash.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
LETTER = regex.compile(r"\p{L}")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def subwords(text: str) -> Iterator[np.ndarray]:
    """The buckets of all runs of a text, spaces around it included, SLICE code points at a time."""
    whole = f" {text.lower()} "
    for at in range(0, len(whole), SLICE):
        a = np.frombuffer(whole[at : at + SLICE + max(RUNS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        out = [np.empty(0, np.uint32)]
        for n in RUNS:
            m = min(len(a) - n + 1, SLICE)  # runs that start here; they end in the next slice at the latest
            if m > 0:
                h = a[:m] * np.uint32(MULTIPLIERS[0] + 2 * n)
                for k in range(1, n):
                    h = (h ^ (h >> np.uint32(15))) + a[k : m + k] * np.uint32(MULTIPLIERS[k])
                out.append((h ^ (h >> np.uint32(13))) * np.uint32(MULTIPLIERS[3]) >> np.uint32(16))
        yield np.concatenate(out)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords, and the share of each."""
    counts = sum(np.bincount(found, minlength=BUCKETS) for found in subwords(text))
    rows = np.flatnonzero(counts)
    return rows.astype(np.int32), (counts[rows] / counts.sum()).astype(np.float32)


class Model:
    """Rows of buckets (embeddings, or their product with the layer, which is None then), a bias, a temperature and the rejection
    threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, layer: np.ndarray | None, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.layer, self.bias, self.temperature, self.threshold = languages, table, layer, bias, temperature, threshold

    def logits(self, text: str) -> np.ndarray:
        total, n = 0.0, 0
        for found in subwords(text):
            total, n = total + self.table[found].sum(axis=0, dtype=np.float64), n + len(found)
        return self.of_mean(total / n)

    def of_mean(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.layer is None else mean @ self.layer) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, rejected."""
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(1))
    rng = np.random.default_rng(SEED)
    y = np.array([languages.index(x) for x in langs])
    order = rng.permutation(len(bags))
    calibration, learned = order[: len(order) // 5], order[len(order) // 5 :]
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-STEPS // max(len(learned), 1)))
    steps, step = epochs * len(learned), 0
    for _ in range(epochs):
        for i in rng.permutation(learned):
            rate = RATE * (1 - step / steps)
            rows, share = bags[i]
            hidden = share @ embedding[rows]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            embedding[rows] -= rate * share[:, None] * (layer @ p)
            layer -= rate * 0.05 * np.outer(hidden, p)
            bias -= rate * 0.05 * p
            step += 1
    few = len(languages) <= DIM
    model = Model(languages, embedding @ layer if few else embedding, None if few else layer.astype(np.float64), bias.astype(np.float64))
    return calibrated(model, [bags[i] for i in calibration], y[calibration]) if len(calibration) else model


def calibrated(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """The temperature of least cross-entropy, and the threshold that rejects REJECTED of the right predictions."""
    z = np.stack([model.of_mean(share.astype(np.float64) @ model.table[rows]) for rows, share in bags])

    def softmax(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(t)[np.arange(len(y)), y] + 1e-12).mean()))
    p = softmax(model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.threshold = min(DOUBT, float(np.quantile(right, REJECTED))) if len(right) else 0.0
    return model


def learn(docs: DataFrame) -> Model:
    """Trains on the bounded sample of docs' labelled rows that are not held out, in a task. What comes to the driver is a row for
    each language, and the model."""
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    langs = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not langs:
        return train([], [])
    each = max(FEW, SAMPLE // len(langs))
    # a hash lets about twice as many rows through as are wanted, of each language its share; only those are ordered
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], int(min(1.0, 2 * each / r["count"]) * (1 << 30)))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                bags = [bag(t.as_py()) for t in part.column("text")]
                packed = [pa.array([x.astype(kind).tobytes() for x in c], pa.binary()) for c, kind in zip(zip(*bags, strict=True), ("<u2", "<f4"), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *packed], ["doc_id", "lang", "rows", "shares"])

    sample = labelled.filter(place < share[F.col("lang")]).mapInArrow(counted, "doc_id long, lang string, rows binary, shares binary")
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", F.xxhash64("rows", "shares"))
    drawn = sample.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= each).repartition(1).sortWithinPartitions("lang", "i").select("lang", "rows", "shares")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, langs = [], []
        for b in batches:
            bags += [(np.frombuffer(r.as_py(), "<u2").astype(np.int32), np.frombuffer(s.as_py(), "<f4")) for r, s in zip(b.column("rows"), b.column("shares"), strict=True)]
            langs += b.column("lang").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(bags, langs))], pa.binary())], ["model"])

    found = drawn.mapInArrow(trained, "model binary").head()
    return pickle.loads(found["model"]) if found else train([], [])


def predictions(docs: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """(docs with the prediction beside its own columns, the names of language, score and rejected); a narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = unused(docs, "lang_pred", "score", "rejected")
    # columns pass the workers under plain names, as not every name of a table can be asked for there
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = plain.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "rejected": F.lit(None).cast("boolean")}).schema
    at_text = [c.lower() for c in docs.columns].index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = [m.predict(t.as_py()) for t in part.column(at_text)]
                lang, score, rejected = zip(*found)
                extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], schema.names)

    return plain.mapInArrow(work, schema).toDF(*docs.columns, *names), names


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    rows, _ = predictions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with their own columns."""
    rows, (_, _, rejected) = predictions(docs, learn(docs))
    return rows.filter(~F.col(rejected)).select(own_columns(docs))
