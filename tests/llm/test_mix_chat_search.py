import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.llm import chat_format, curve_search, source_mix
from docindex.llm.common import cut, release

from . import brute
from .conftest import DATA, DOCS, ODD


def test_mix_meets_its_targets(documents, texts):
    out, slots = source_mix.mix(documents)
    rows = out.collect()
    sizes = {}
    for r in texts.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    want = brute.targets(sizes, weights)
    taken = {}
    for r in rows:
        assert r["size"] == len(brute.words(texts[r["doc_id"]]["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, source_mix.mix(documents.repartition(5))[0].collect())) == sorted(map(tuple, rows))
    ranks = {}
    for r in slots.orderBy("slot").collect():
        ranks.setdefault(r["source"], []).append(r["rank"])
    assert all(x == list(range(len(x))) for x in ranks.values())


def test_mix_of_skewed_sources(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 400), "big" if i % 3 else rng.choice(["tiny", None, "b", "c"])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    order = sorted(s for s in sizes if s is not None) + [None]
    want = brute.targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = {}
    for r in source_mix.mix(df)[0].collect():
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    heavy = spark.createDataFrame([("tiny", 100.0), ("big", 1.0), (None, 1.0), ("b", 1.0), ("c", 1.0)], "source string, weight double")
    got = {r["source"]: r["target"] for r in source_mix.mix(df, heavy)[0].select("source", "target").distinct().collect()}
    assert got == pytest.approx(brute.targets(sizes, {"tiny": 100, "big": 1, None: 1, "b": 1, "c": 1}))


def test_mix_of_odd_rows(spark, odd):
    rows = source_mix.mix(odd)[0].collect()
    assert len(rows) == len(ODD) and {r["doc_id"]: r["taken"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3: 0, 4: 0, 5: 0}
    mixed = source_mix.mixed_documents(odd)
    assert mixed.columns == odd.columns
    whole = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in rows if r["size"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: n for d, n in whole.items() if n}
    assert source_mix.mix(spark.createDataFrame([], DOCS))[0].count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in source_mix.mix(blank)[0].collect()} == {(0.0, 0)}


MESSAGES = [
    (1, 0, "system", "be kind"),
    (1, 1, "assistant", '{"tool_calls":[{"id":"b","name":"add","arguments":{"y":2,"x":1.5},"after":"a"},{"id":"a","name":"add","arguments":{"x":1,"y":2}}]}'),
    (1, 2, "tool", '{"tool_call_id":"a","content":"3"}'),
    (1, 3, "tool", '{"tool_call_id":"a","content":"again"}'),
    (1, 4, "tool", '{"tool_call_id":"zz","content":"lost"}'),
    (1, 5, "assistant", '{"tool_calls":[{"id":"a","name":"add","arguments":{"x":1}}]}'),
    (1, 6, "assistant", '{"tool_calls":[{"id":"c1","name":"add","arguments":{"x":"no","y":1,"z":0},"after":"c2"},{"id":"c2","name":"what","arguments":{},"after":"c1"},{"id":"d","name":"add","arguments":[1],"after":"c2"}]}'),
    (2, 0, "user", None),
    (2, 1, "user", "{broken json"),
    (2, 2, "assistant", '{"tool_calls":[{"name":"add","arguments":{"x":1,"y":2},"after":"none"}]}'),
    (2, 2, "assistant", '{"tool_calls":[{"id":"a","name":"add","arguments":{"b":{"d":1,"c":[1,{"z":1,"a":2}]},"x":1,"y":2}}]}'),
]
SCHEMAS = {"add": {"x": ("number", True), "y": ("integer", True), "b": ("object", False)}}


def test_tool_calls(spark):
    df = spark.createDataFrame([(*m, "clash") for m in MESSAGES], "conv_id long, turn long, role string, text string, call_id string")
    rows = chat_format.linked(df, SCHEMAS).collect()
    calls = {(r["conv_id"], r["turn"], r["call_id"]): r for r in rows if r["kind"] == "call"}
    told = {k: (r["level"], r["status"], r["valid"]) for k, r in calls.items()}
    assert told == {
        (1, 1, "a"): (0, "linked", True), (1, 1, "b"): (1, "unanswered", True), (1, 5, "a"): (0, "duplicate", False), (1, 6, "c1"): (None, "cycle", False),
        (1, 6, "c2"): (None, "cycle", False), (1, 6, "d"): (None, "cycle", False), (2, 2, None): (0, "unanswered", True), (2, 2, "a"): (0, "unanswered", True),
    }
    assert calls[1, 6, "c1"]["errors"] == ["unknown z", "x is not number"] or sorted(calls[1, 6, "c1"]["errors"]) == ["unknown z", "x is not number"]
    assert calls[1, 5, "a"]["errors"] == ["missing y"] and calls[1, 6, "c2"]["errors"] == ["unknown tool"] and calls[1, 6, "d"]["errors"] == ["arguments are no object"]
    assert calls[1, 1, "a"]["json"] == '{"arguments":{"x":1,"y":2},"id":"a","level":0,"name":"add","result":"3","status":"linked","valid":true}'
    assert '"arguments":{"b":{"c":[1,{"a":2,"z":1}],"d":1},"x":1,"y":2}' in calls[2, 2, "a"]["json"]
    results = sorted((r["call_id"], r["status"], r["turn"]) for r in rows if r["kind"] == "result")
    assert results == [("a", "repeated", 3), ("zz", "orphan", 4)]
    plain = {(r["conv_id"], r["turn"]): r["json"] for r in rows if r["kind"] == "message"}
    assert plain == {(1, 0): '{"content":"be kind","role":"system"}', (2, 0): '{"content":null,"role":"user"}', (2, 1): '{"content":"{broken json","role":"user"}'}
    assert chat_format.linked(df.limit(0), SCHEMAS).count() == 0


def test_whole_numbers_of_any_size_are_integers(spark):
    kinds = {"1": True, "12345678901234567890123": True, "-9223372036854775809": True, "1.0": False, "1.5": False, "true": False, '"1"': False, "null": False}
    rows = [(i, 1, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"n":%s}}]}' % v) for i, v in enumerate(kinds)]
    got = chat_format.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {"n": ("integer", True)}}).collect()
    assert {r["conv_id"]: r["valid"] for r in got} == dict(enumerate(kinds.values()))


def test_equal_rows_and_rows_without_a_conversation(spark):
    call = '{"tool_calls":[{"id":"a","name":"add","arguments":{"x":1,"y":2}}]}'
    rows = [(1, 1, "assistant", call)] * 2 + [(1, 2, "tool", '{"tool_call_id":"a","content":"3"}')] * 3 + [(None, 1, "assistant", call), (None, 2, "tool", '{"tool_call_id":"a","content":"3"}')]
    rows += [(2, 1, "assistant", '{"tool_calls":[{"id":"a","name":"add","arguments":{"x":1,"x":2,"y":1}}]}'), (3, 1, "user", "z" * 400_000), (3, 1, "user", "z" * 400_000)]
    rows += [(4, 1, "tool", '{"tool_call_id":"none","content":"c"}')] * 2
    got = chat_format.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), SCHEMAS).collect()
    told = sorted(((r["conv_id"], r["turn"], r["kind"], r["status"]) for r in got), key=repr)
    assert told == sorted([
        (1, 1, "call", "linked"), (1, 1, "call", "duplicate"), (1, 2, "result", "repeated"), (1, 2, "result", "repeated"), (None, 1, "call", "unanswered"), (None, 2, "result", "orphan"),
        (2, 1, "call", "unanswered"), (3, 1, "message", "message"), (3, 1, "message", "message"), (4, 1, "result", "orphan"), (4, 1, "result", "orphan"),
    ], key=repr)
    assert next(r for r in got if r["conv_id"] == 2)["errors"] == ["arguments are no object"]


def test_long_chains_take_few_rounds(spark):
    calls = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("after"))
    assert {int(r["call_id"]): r["level"] for r in chat_format.levels(calls).collect()} == {i: i for i in range(700)}


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij")
        cells = np.stack([a.ravel() for a in axes], axis=1)
        keys = curve_search.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def nearest(ids, x, q, k=5):
    """[(id, cosine)] of the k nearest rows to row q by every pair, ties to the smaller id."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    s = [float(np.dot(x[q], y) / (np.sqrt(np.dot(x[q], x[q])) * np.sqrt(np.dot(y, y)))) for y in x]
    order = sorted((i for i in range(len(x)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))
    return [(ids[i], s[i]) for i in order[:k]]


def searched(df, asks="vec_id % 50 = 0"):
    got = {}
    for r in curve_search.search(df, F.expr(asks)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall_and_scores(ids, x, got):
    """The share of the true neighbours that was found; every score has to be the pair's."""
    hits, where = 0, {int(i): n for n, i in enumerate(ids)}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in got.items():
        for v, score in found:
            assert abs(score - float(unit[where[q]] @ unit[where[v]])) < 1e-12
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hits += len({v for v, _ in found} & {v for v, _ in nearest(ids, x, where[q])})
    return hits / sum(map(len, got.values()))


def test_search_recall(spark):
    rng = np.random.default_rng(2)
    for kind in ("alike", "clustered"):
        n = 3000
        x = rng.standard_normal((n, 32))
        if kind == "clustered":
            x = x * 0.4 + rng.standard_normal((30, 32))[rng.integers(0, 30, n)]
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = searched(df)
        assert set(got) == set(range(0, n, 50)) and all(len(v) == 5 for v in got.values())
        assert recall_and_scores(np.arange(n), x.astype(float), got) >= 0.9
        shares = curve_search.Plan(curve_search.unit(x.astype(float)))
        assert shares.share < (1.0 if kind == "alike" else 0.35)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_search_of_the_given_embeddings(spark, size):
    df = spark.read.parquet(str(DATA / size / "embeddings.parquet"))
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = searched(df)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    assert recall_and_scores(ids, x, got) >= 0.9


def test_search_gives_ties_to_the_smaller_id(spark):
    # 30 multiples of the query by powers of two have scores that are equal to the bit
    rows = [(0, [1.0, 2.0, 4.0])] + [(i, [c * 2.0**i for c in (1.0, 2.0, 4.0)]) for i in range(1, 31)]
    rng = np.random.default_rng(5)
    more = rows + [(i, (rng.standard_normal(3)).tolist()) for i in range(51, 400) if i % 50]
    for table in (rows, more):
        got = searched(spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(5))
        assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and all(abs(s - 1) < 1e-12 for _, s in got[0])
    got = searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len({s for _, s in got[0]}) == 1


def test_search_orders_by_exact_scores(spark):
    # cosines that differ by about 1e-14 only: the nearest ones have the largest ids
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, 0.01 - 1e-12 * i]) for i in range(1, 8)]
    found = searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0]
    assert [v for v, _ in found] == [7, 6, 5, 4, 3] and all(a > b for (_, a), (_, b) in zip(found, found[1:], strict=False))
    # multiples by other factors than powers of two: as the last bits of their scores have it
    factors = np.linspace(1, 9, 31).tolist()
    x = np.array([[c * f for c in (1.0, 2.0, 4.0)] for f in factors])
    found = searched(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))[0]
    assert found == sorted(found, key=lambda p: (-p[1], p[0])) and all(abs(s - 1) < 1e-12 for _, s in found)


def test_search_of_large_and_tiny_doubles(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 8))
    scale = 10.0 ** rng.choice([-300, -200, 0, 200, 300], 120)
    df = spark.createDataFrame([(i, (v * f).tolist()) for i, (v, f) in enumerate(zip(x, scale, strict=True))], "vec_id long, embedding array<double>")
    got = searched(df)
    assert set(got) == {0, 50, 100}
    for q, found in got.items():
        want = nearest(np.arange(120), x, q)
        assert len({v for v, _ in want} & {v for v, _ in found}) >= 4
        for v, s in found:
            assert abs(s - dict(nearest(np.arange(120), x, q, 119))[v]) < 1e-12
    tiny = spark.createDataFrame([(0, [5e-324, 0.0]), (1, [5e-324, 0.0]), (2, [1.7e308, 1.7e308])], "vec_id long, embedding array<double>")
    assert [v for v, _ in searched(tiny)[0]] == [1, 2]


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i)], 0.0) for i in range(1, 8)] + [(50, [1.0, 1.0], 0.0), (100, [0.0, 0.0], 0.0), (150, None, 0.0), (200, [nan, 1.0], 0.0), (250, [inf, 1.0], 0.0), (300, [None, 1.0], 0.0), (350, [1.0], 0.0), (400, [1.0, 2.0], 0.0), (None, [1.0, 1.0], 0.0)] + [(i, [3.0, 4.0], 0.0) for i in range(1000, 1100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = searched(df)
    assert set(got) == {50, 400, 1000, 1050}
    assert got[50][0][0] == 1 and got[400][0][0] == 2
    assert [v for v, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005]
    assert [v for v, _ in got[1050]] == [1000, 1001, 1002, 1003, 1004]
    few = df.filter("vec_id in (50, 1, 2)").select("vec_id", "embedding", F.lit(1).alias("class"), F.lit(2).alias("node"), F.lit(3).alias("rank"))
    assert [v for v, _ in searched(few, "vec_id = 50")[50]] == [1, 2]
    assert curve_search.search(df.limit(0), F.lit(True)).count() == 0
    assert curve_search.search(df.filter("vec_id = 50"), F.lit(True)).count() == 0


def test_cut_tables_live_in_the_shared_folder(spark):
    t = cut(spark.range(5))
    assert t.count() == 5 and t._cut_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    release(t)
