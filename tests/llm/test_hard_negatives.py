import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.llm import hard_negatives as hn
from docindex.llm import queries

from .conftest import DATA

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3, every=50):
    """Sorted rows of the result, for [(vec_id, whole numbers, label)]."""
    out = []
    for i, x, label in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, y, other in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            hard = [r for r in scored if r[2] != label and -50 * s <= -100 * r[0] <= -95 * s][:negatives]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(hard)]
    return sorted(out)


def mined(df, **more):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 50 == 0, **more).select(cols).collect())


def numbers(rows):
    return [(i, [int(np.floor(256 * c)) for c in v], label) for i, v, label in rows]


def test_the_query_of_the_given_embeddings(spark):
    d = str(DATA / "sf0.1")
    got = queries.queries()["op13_hard_negatives"](spark, d).collect()
    given = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in given])
    label = np.array([(r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"] for r in given])
    x = np.floor(256 * np.array([r["embedding"] for r in given], float))
    want = []
    for a in np.flatnonzero(ids % 50 == 0):
        s = (x @ x[a]).astype(int)
        order = np.lexsort((ids, -s))
        order = order[ids[order] != ids[a]]
        for p in order[label[order] == label[a]][:5]:
            fit = order[(label[order] != label[a]) & (100 * s[order] >= 50 * s[p]) & (100 * s[order] <= 95 * s[p])][:3]
            want += [(ids[a], ids[p], k + 1, ids[n], s[p], s[n]) for k, n in enumerate(fit)]
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got) == sorted(map(tuple, want))


@pytest.mark.parametrize("kind", ["ties", "clustered", "opposite", "line"])
def test_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hn, "CELL", 8)
    monkeypatch.setattr(hn, "TILE", 64)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "FIRST", (20, 60, None))
    rng, n = np.random.default_rng(7), 400
    if kind == "ties":
        x = rng.integers(-1, 2, (n, 5)) / 256.0
        x[100:300] = x[3]  # half of all rows are one vector
    elif kind == "clustered":
        x = rng.standard_normal((12, 6))[rng.integers(0, 12, n)] * 3 + rng.standard_normal((n, 6)) * 0.2
    elif kind == "opposite":
        x = rng.standard_normal((n, 3)) * np.where(np.arange(n) % 50 == 0, -1, 1)[:, None] - 2
    else:
        x = np.arange(n)[:, None] / 50.0 - 2
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, rng.integers(0, 4, n), strict=True))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(numbers(rows))
    assert mined(df) == want and (want or kind == "opposite")
    assert mined(df, positives=2, negatives=7) == brute(numbers(rows), 2, 7)


def test_clustered_vectors_leave_most_cells_alone():
    rng, n = np.random.default_rng(8), 20_000
    centre = rng.standard_normal((40, 16)) * 1000
    x = np.floor(centre[rng.integers(0, 40, n)] + rng.standard_normal((n, 16)) * 20).astype(np.int64)
    half = [hn.codebook(x[:, :8].astype(float), 40), hn.codebook(x[:, 8:].astype(float), 40)]
    codes = [hn.nearest(h, c) for h, c in zip((x[:, :8], x[:, 8:]), half, strict=True)]
    far = [np.sqrt(((h - c[k]) ** 2).sum(axis=1)) for h, c, k in zip((x[:, :8], x[:, 8:]), half, codes, strict=True)]
    pairs, own = np.unique(np.stack(codes, axis=1), axis=0, return_inverse=True)
    cells = np.zeros(len(pairs), dtype=[("one", "i4"), ("two", "i4"), ("rows", "i8"), ("radius1", "f8"), ("radius2", "f8"), ("tile", "i8"), ("parts", "i8")])
    cells["one"], cells["two"], cells["rows"] = pairs[:, 0], pairs[:, 1], np.bincount(own)
    for r, f in zip(("radius1", "radius2"), far, strict=True):
        np.maximum.at(cells[r], own, f)
    index = hn.Index(16, tuple(half), cells)
    walk = hn.Visit(index, x[0])
    seen, bounds = [], []
    while (found := walk.next()) is not None:
        bounds.append(found[0])
        seen.append(found[1])
        assert (x[own == found[1]] @ x[0]).max() <= found[0] and (x[own == found[1]] @ x[0]).min() >= walk.least(found[1])
    assert sorted(seen) == list(range(len(cells))) and bounds == sorted(bounds, reverse=True)
    fifth = int(np.sort(x @ x[0])[-5])
    passed, met = hn.walked(index, x[0], 0, [hn.LEAST + 1], [hn.MOST], [fifth], None)
    assert cells["rows"][met].sum() < n / 5
    # a wave goes on where the one before it stopped
    first, a = hn.walked(index, x[0], 0, [hn.LEAST + 1], [hn.MOST], [hn.LEAST], 300)
    second, b = hn.walked(index, x[0], first, [hn.LEAST + 1], [hn.MOST], [hn.LEAST], None)
    assert a + b == seen and first == len(a)
    # cells with nothing but scores above a window are passed over, and nothing follows below it
    low = int(np.quantile(x @ x[0], 0.4))
    _, inside = hn.walked(index, x[0], 0, [low], [low + 1000], [hn.LEAST], None)
    score = x @ x[0]
    assert set(own[(score >= low) & (score <= low + 1000)]) <= set(inside) and len(inside) < len(cells) / 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(9)
    fine = [(i, v.tolist(), i % 3) for i, v in enumerate(rng.integers(0, 9, (120, 3)) / 256)]
    odd = [(150, None, 1), (200, [nan, 1.0, 1.0], 1), (250, [None, 1.0, 1.0], 1), (300, [1.0], 1), (350, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (400, [inf, 1.0, 1.0], 1), (450, [1e300, 1.0, 1.0], 1), (500, [], 2)]
    df = spark.createDataFrame(fine + odd, SCHEMA)
    for c in ("row", "x", "cell", "tile", "one", "goal", "score", "anchor"):
        df = df.withColumn(c, F.lit("c"))
    assert mined(df) == brute(numbers(fine))
    # equal rows are rows of their own, and a repeated anchor is told twice; its copy is no positive of it
    twice = fine + [fine[50], fine[7], fine[7]]
    got = mined(spark.createDataFrame(twice, SCHEMA))
    want = brute(numbers([r for k, r in enumerate(twice) if k != 120]))
    assert [r for r in got if r[0] == 50] == sorted(2 * [r for r in want if r[0] == 50])
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id = 150")) == [] and mined(df.filter("vec_id = 50")) == []
    assert mined(df.filter("vec_id in (0, 3, 1)")) == brute(numbers([r for r in fine if r[0] in (0, 1, 3)]))
    words = spark.createDataFrame([(i, v, f"l{c}") for i, v, c in fine], "vec_id long, embedding array<float>, label string")
    assert mined(words) == brute(numbers(fine))
