import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.llm import quality, queries

from .conftest import DATA, DOCS, ODD, SMALL


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_held_out_labels(spark, size):
    d = str(DATA / size)
    rows = {r["doc_id"]: r for r in queries.queries()["op12_quality"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(rows) == docs and all(r["held_out"] == is_held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    told = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if is_held_out(r["doc_id"])]
    right = np.mean([r["predicted"] == q for r, q in told])
    good, bad = [r["score"] for r, q in told if q], [r["score"] for r, q in told if not q]
    wins = np.mean([a > b for a in good for b in bad])
    assert right >= (0.8 if size == "sf0.001" else 0.97) and wins >= (0.9 if size == "sf0.001" else 0.99)


def test_scores_are_the_models_and_blind_to_labels(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.learn(documents, labels)
    rows = quality.scored(documents, model).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in rows:
        x = quality.features(texts[r["doc_id"]]).astype(float)
        odds = (x @ model.weights - model.threshold) / model.spread + np.log(0.7 / 0.3)
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-9
    # neither held-out labels nor other columns change the model
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.learn(documents.withColumn("lang", F.lit("xx")), other.repartition(3))
    assert np.array_equal(again.weights, model.weights) and again.threshold == model.threshold


def test_pairs_are_ranked_and_the_quantile_parts_them():
    rng = np.random.default_rng(4)
    x = np.zeros((400, quality.BUCKETS + quality.MEASURES), np.float32)
    x[:, :5] = rng.standard_normal((400, 5))
    truth = x[:, 0] * 2 - x[:, 1]
    better = truth > np.quantile(truth, 0.3)
    model = quality.train(x, better)
    raw = np.array([model.raw(row) for row in x])
    assert ((raw >= model.threshold) == better).mean() > 0.97 and 0.2 < model.level < 0.4
    # the logistic loss of the pairs, by definition: its slope is about zero along the weights that were learned
    weights = quality.ranked(x, better)
    difference = (x[better][:, None] - x[~better][None]).reshape(-1, x.shape[1])
    loss = lambda w: np.log1p(np.exp(-difference @ w)).mean()
    assert loss(weights) < 0.1 * loss(np.zeros_like(weights))
    assert quality.parted(np.array([1.0, 1, 1, 2, 2]), np.array([False, False, True, True, True])) == (1.5, 0.6)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (5, 1), (6, 0), (7, None), (8, 7), (9, 1), (9, 1), (None, 1), (77, 0)], "doc_id long, quality int")
    clash = odd.withColumn("quality", F.lit(1)).withColumn("score", F.lit("x")).withColumn("buckets", F.lit(3)).withColumn("r", F.lit(0))
    rows = quality.classify(clash, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1  # null, empty and blank texts
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    none = quality.classify(odd, labels.filter("quality = 1")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert quality.classify(odd, labels.limit(0)).count() == len(ODD)
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abc XYZ.,!\n\t9é日"), 5000))
    whole = quality.runs(text)
    monkeypatch.setattr(quality, "SLICE", 7)
    assert np.array_equal(quality.runs(text), whole) and whole.sum() == 3 * (len(text) + 2) - 3
    assert not np.array_equal(quality.features("a b"), quality.features("a b" + " c" * 4000))
