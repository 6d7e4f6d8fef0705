"""Whole rankings of documents: no pair is sent, slices and blocks leave ranks as they are, and ties are those of SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.functions import scalars
from docindex.operators import search
from docindex.plans.queries import ORACLES, QUERIES
from tests_support import DATA


def embeddings(spark, path, vectors):
    rows = [(i, [float(x) for x in v], i % 10) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_pairs_are_not_sent(spark, tmp_path):
    d = embeddings(spark, tmp_path, np.random.default_rng(3).normal(size=(10_000, 4)))
    sc = spark.sparkContext
    sc.setJobGroup("pairs", "")
    try:
        pairs = len(QUERIES["v3_score_chunks"](spark, d).collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert pairs == 200 * 500
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("pairs")]
    sent = [sc._jsc.sc().statusStore().lastStageAttempt(i).shuffleWriteRecords() for i in {i for j in jobs for i in j.stageIds}]
    assert 10_000 <= sum(sent) < pairs / 2  # as rows each pair would be sent to its query's ranking


def test_ties_are_those_of_sql(spark, tmp_path):
    # a few directions in many lengths: their cosines are equal, or differ by their last bits
    r = random.Random(5)
    lines = [[r.randint(-9, 9) for _ in range(6)] + [1] for _ in range(8)]
    d = embeddings(spark, tmp_path, [np.multiply(r.choice(lines), r.choice((1, 3, 5, 7, 11, 13))) for _ in range(1000)])
    got = [tuple(r) for r in QUERIES["v3_score_chunks"](spark, d).orderBy("query_id", "rank").select("query_id", "rank", "chunk_no").collect()]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    for t in ("documents", "lineitem", "part", "orders", "events", "supplier", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    want = c.sql(f"SELECT query_id, rank, chunk_no FROM ({ORACLES['v3_score_chunks']}) ORDER BY 1, 2").fetchall()
    assert len(want) == 20 * 50 and got == want


def brute(queries, chunks):
    """Ranks pair by pair; a query's rows with its id are one query."""

    def cosine(a, b):
        if a is None or b is None or None in a or None in b:
            return None
        sums = [sum(x * x for x in a), sum(x * x for x in b)]
        if 0 in sums:
            return 0.0
        if len(a) != len(b):
            return None
        score = sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sums[0] * sums[1])
        return score if math.isnan(score) else min(1.0, max(-1.0, score))

    out, order = [], lambda s: 2 if s is None else -2 if math.isnan(s) else -s
    for q, k in sorted({(q, k) for q, k, _ in queries}, key=repr):
        found = [(cosine(v, w), n) for i, j, v in queries if (i, j) == (q, k) for at, n, w in chunks if at == k is not None]
        found.sort(key=lambda f: (order(f[0]), f[1]))
        out += [(q, n, s, i + 1) for i, (s, n) in enumerate(found)]
    return out


@pytest.mark.parametrize("bounds", [{}, {"PAIRS": 300}, {"PAIRS": 300, "WHOLE": 40}, {"WHOLE": 7, "SLICE": 3}])
def test_slices_and_blocks(spark, monkeypatch, bounds):
    for name, value in ({"SCORED": 50, "OUT": 64} | bounds).items():
        monkeypatch.setattr(search, name, value)
    r = random.Random(11)
    odd = [None, [], [0.0] * 5, [1.0, None, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0], [math.nan, 1.0, 1.0, 1.0, 1.0]]
    vector = lambda: r.choice([[float(r.randint(-3, 3)) for _ in range(5)]] * 8 + odd)
    sizes = {"a": 130, "b": 41, "c": 40, "d": 1, "no query": 5, None: 3}
    chunks = [(k, i, vector()) for k, n in sizes.items() for i in range(n)]
    queries = [(f"{k}{i}", k, vector()) for k, n in {"a": 9, "b": 30, "c": 1, "d": 4, "no chunk": 2, None: 1}.items() for i in range(n)]
    queries += [("a1", "a", vector()), ("b2", "b", [1.0, 2.0, 3.0, 4.0, 5.0]), (None, "a", vector())]
    some = spark.createDataFrame(queries, "query_id string, file_id string, dense array<double>").repartition(3)
    given = spark.createDataFrame(chunks, "file_id string, chunk_no int, dense array<double>").repartition(5)
    got = search.score_chunks(some, given)
    assert got.dtypes == [("query_id", "string"), ("chunk_no", "int"), ("score", "double"), ("rank", "int")]
    plain = lambda rows: sorted((str(q), i, n, s if s is None or s == s else "nan") for q, n, s, i in rows)
    told = [tuple(x) for x in got.collect()]
    want = brute(queries, chunks)
    assert [x[:3] for x in plain(told)] == [x[:3] for x in plain(want)]
    for (*_, a), (*_, b) in zip(plain(told), plain(want), strict=True):
        assert a == b or abs(a - b) < 1e-12


def test_rounding_is_that_of_sql(spark):
    some = [0.0078125, -0.0078125, 3e-7, -3e-7, 5e-7, -5e-7, 1.0, -1.0, 0.0, 0.12345649999999999, math.nan, None, 4.9999999999999994e-7]
    some += np.random.default_rng(2).uniform(-1, 1, 500).tolist() + [(i + 0.5) / 1e6 for i in range(500)]
    got = [x for (x,) in spark.createDataFrame([(i, x) for i, x in enumerate(some)], "i int, x double").orderBy("i").select(scalars.rounded(F.col("x"), 6)).collect()]
    c = duckdb.connect()
    want = [c.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in some]
    assert list(map(repr, got)) == list(map(repr, want))
