from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.llm import queries, vectors, whitening

from .conftest import DATA, SMALL


def brute(rows, components=4):
    """{vec_id: (deviation, whitened)}, n, explained: by exact sums and the eigenvectors of the covariance."""
    numbers = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in rows}
    distinct = sorted(set(map(tuple, numbers.values())))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    y = np.array([[float(c - m) for c, m in zip(x, mean, strict=True)] for x in distinct])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(sum(Fraction(sum(c * c for c in col), n) - m * m for col, m in zip(zip(*distinct, strict=True), mean, strict=True)))
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), np.array([float(c - m) for c, m in zip(x, mean, strict=True)]) @ axes / np.sqrt(values)) for i, x in numbers.items()}
    return out, n, values / trace


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_the_query_is_brute_force(spark, size):
    d = str(DATA / size)
    rows = queries.queries()["op11_whitening"](spark, d).collect()
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, n, explained = brute(given)
    assert len(rows) == 4 * len(given) and {r["n"] for r in rows} == {n}
    (error,) = {r["identity_error"] for r in rows}
    assert error < 1e-9
    for c in range(1, 5):
        own = {r["vec_id"]: r for r in rows if r["component"] == c}
        assert own.keys() == want.keys() and all(own[i]["deviation"] == want[i][0] for i in want)
        a, b = np.array([own[i]["whitened"] for i in want]), np.array([want[i][1][c - 1] for i in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert abs(next(iter(own.values()))["explained"] / explained[c - 1] - 1) < 1e-9


def made(spark, x, kind="double"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(6)


def test_ill_conditioned_vectors(spark):
    # standard deviations from 1e9 to 1, turned: the Gram matrix's condition is about 1e18
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    x = rng.standard_normal((400, 6)) * np.array([1e9, 1e7, 1e5, 1e3, 1e1, 1.0]) @ turn
    rows, w = whitening.whiten(made(spark, x), 6)
    got = np.array([r["whitened"] for r in rows.orderBy("vec_id").collect()])
    assert got.shape == (400, 6) and w.error < 1e-6 and np.all(np.diff(w.values) < 0)
    whole = np.floor(256 * x)
    y = whole - whole.mean(axis=0)
    singular = np.linalg.svd(y, compute_uv=False)
    assert np.abs(np.sqrt(w.values * w.n)[:4] / singular[:4] - 1).max() < 1e-6
    assert np.abs(w.axes.T @ w.axes - np.eye(6)).max() < 1e-12


def test_vectors_of_less_than_full_rank(spark):
    rng = np.random.default_rng(2)
    flat = np.floor(rng.standard_normal((200, 2)) * 50) @ np.array([[1.0, 2, 0, 1], [0, 1, 3, -1]])
    rows, w = whitening.whiten(made(spark, np.c_[flat, np.full(200, 7.0)]))
    got = np.array([r["whitened"] for r in rows.collect()])
    assert got.shape == (200, 2) and w.error < 1e-9 and abs(w.values.sum() / w.trace - 1) < 1e-12
    for same in (np.ones((5, 3)), np.ones((1, 3)), np.zeros((4, 2))):
        rows, w = whitening.whiten(made(spark, same))
        assert [r["whitened"] for r in rows.collect()] == [[]] * len(same) and w.n == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    fine = [(i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((30, 3)))]
    fine += [(3, fine[3][1], 1), (None, fine[4][1], 1), (90, [-0.0, 0.0, -0.001], 1)]
    odd = [(50, None, 0), (51, [nan, 1.0, 1.0], 0), (52, [1.0, None, 1.0], 0), (53, [inf, 1.0, 1.0], 0), (54, [1.0], 0), (55, [], 0)]
    df = spark.createDataFrame(fine + odd, "vec_id long, embedding array<double>, x int").withColumn("deviation", F.lit(1)).withColumn("whitened", F.lit("w"))
    rows, w = whitening.whiten(df)
    got = rows.collect()
    assert sorted(map(repr, (r["vec_id"] for r in got))) == sorted(repr(i) for i, _, _ in fine) and w.n == 31
    want = brute([(k, v) for k, (_, v, _) in enumerate(fine)], 3)[0]
    assert sorted(r["deviation"] for r in got) == sorted(v[0] for v in want.values())
    empty, w = whitening.whiten(df.limit(0))
    assert empty.count() == 0 and w.n == 0
    assert whitening.whiten(df.filter("vec_id = 50"))[0].count() == 0
    assert [r["whitened"] for r in whitening.whiten(df.filter("vec_id = 55"))[0].collect()] == [[]]


def test_numbers_beyond_64_bits(spark):
    x = np.array([[1e300, 1.0], [-1e300, 2.0], [3e10, 4.0], [0.0, -5.0]])
    rows, w = whitening.whiten(made(spark, x))
    got = {r["vec_id"]: r for r in rows.collect()}
    assert [got[i]["deviation"] is None for i in range(4)] == [True, True, False, False] or got[2]["deviation"] is None
    assert w.sums[0] == 2**63 - 1024 - 2**63 + int(256 * 3e10) and all(np.isfinite(got[i]["whitened"]).all() for i in got)


def test_reruns_agree_to_the_bit(spark):
    d = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    numbers = vectors.as_numbers(vectors.finite(d)[0].select("vec_id", "embedding"))
    table = whitening.cut(numbers.select("x").distinct())
    a, b = whitening.fit(table, 64), whitening.fit(table, 64)
    assert np.array_equal(a.axes, b.axes) and a.error == b.error


def test_packed_numbers_come_back():
    x = np.array([[0, 127], [-128, 5], [128, 0], [-(2**15), 1], [2**31, -1], [2**63 - 1, -(2**63)]])
    import pyarrow as pa

    column = pa.array(vectors.packed(x), pa.binary())
    assert np.array_equal(vectors.unpacked(column, 2), x) and [len(v) for v in column.to_pylist()] == [2, 2, 4, 4, 16, 16]
