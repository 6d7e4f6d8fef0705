import random

import numpy as np
import pyarrow as pa
import pytest

from docindex.llm import common, exact_dedup, ngram_join, substring_dedup
from docindex.llm.components import components

from . import brute
from .conftest import DOCS, ODD


def pairs(texts):
    return [(d, r["text"]) for d, r in texts.items()]


def made(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_fuse_filter_has_all_keys_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        f = exact_dedup.fuse(keys)
        assert exact_dedup.maybe_in(keys, *f).all()
        others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
        assert exact_dedup.maybe_in(others, *f).mean() < 0.02
        assert n < 1000 or len(f[3]) < 1.6 * n


def test_exact_dedup_is_brute_force(documents, texts):
    got = made(exact_dedup.dedup(documents), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(brute.dedup(pairs(texts)), key=repr)


def test_exact_dedup_of_odd_rows(spark, odd):
    rows = exact_dedup.dedup(odd).collect()
    assert len(rows) == len(ODD)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in rows})
    blank = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert {r["keep_id"] for r in blank} == {5} and {r["group_size"] for r in blank} == {4} and sum(r["kept"] for r in blank) == 1
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 2)} == {2}
    left = exact_dedup.distinct_texts(odd)
    assert left.columns == odd.columns and left.count() == len(kept)
    assert exact_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_a_saved_snapshot_screens_later_batches(spark, documents, tmp_path):
    rows = exact_dedup.cut(exact_dedup.digests(documents))
    first, second, third = (exact_dedup.cut(exact_dedup.grouped(rows.filter(f"doc_id % 3 = {i}"))) for i in range(3))
    exact_dedup.snapshot_of(first).save(str(tmp_path / "a"))
    kept = exact_dedup.load(spark, str(tmp_path / "a"))
    both = exact_dedup.merged(kept, second)
    whole = exact_dedup.merged(exact_dedup.snapshot_of(both), third).select("digest", "n", "best.n_points")
    assert made(whole, "digest", "n", "n_points") == made(exact_dedup.grouped(rows).select("digest", "n", "best.n_points"), "digest", "n", "n_points")
    plan = exact_dedup.met_and_new(kept, second)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") <= 1  # the snapshot's groups stay in their buckets
    again = exact_dedup.screen(first, kept.filters)
    assert again.filter("maybe").count() == first.count() and again.columns == [*first.columns, "maybe"]


def test_substring_dedup_is_brute_force(documents, texts):
    got = made(substring_dedup.remove_repeats(documents), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.remove_repeats(pairs(texts)), key=repr)


@pytest.mark.parametrize("window", [1, 3, 8, 35, 60])
def test_covers(window):
    period, places = substring_dedup.cover(window)
    assert {(a - b) % period for a in places for b in places} == set(range(period))
    assert window - period + 1 >= 1


def test_substring_dedup_of_planted_passages(spark, odd):
    rng = random.Random(2)
    word = lambda: "w%d" % rng.randint(0, 400)
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 70, 120)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 90))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = s
        rows.append((i, " ".join(w)))
    rows += [(100, " ".join(["again"] * 80)), (101, " ".join(shared[1] + shared[1])), (102, rows[3][1]), (103, rows[3][1] + " "), (104, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for window in (35, 8):
        got = made(substring_dedup.remove_repeats(df, window), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(brute.remove_repeats(rows, window), key=repr)
    got = made(substring_dedup.remove_repeats(odd), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.remove_repeats([(r[0], r[1]) for r in ODD]), key=repr)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    kept = substring_dedup.remove_repeats(df, texts=True).filter("doc_id = 102").head()
    assert kept["kept_text"] is not None


def test_texts_of_one_hash_are_told_apart(spark):
    rows = [(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 2), (5, 7, 3)]
    got = {r["doc_id"]: r["doc"] for r in substring_dedup.by_text(spark.createDataFrame(rows, "doc_id long, doc long, doc2 long")).collect()}
    assert got[1] == got[2] == 7 and got[4] == 8 and len(set(got.values())) == 4


def test_word_hashes_are_those_of_the_words(monkeypatch):
    texts = [None, b"", b" a  b\tC ", b"a", b"a", b" \n", b"AB ab", "é É x".encode(), b"z" * 300, b"w " * 500]
    want = [(t or b"").split() for t in texts]
    for size in (4_000_000, 64, 1):
        monkeypatch.setattr(common, "SLICE_BYTES", size)
        monkeypatch.setattr(common, "RUN_BYTES", size)
        for column in (pa.array(texts, pa.binary()), pa.array([b"q", *texts, b"r"], pa.large_binary()).slice(1, len(texts))):
            for lower in (False, True):
                known, n = {}, 0
                for first, hashes, firsts in common.hashed_words(column, lower):
                    for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
                        own = [w.lower() if lower else w for w in want[first + i]]
                        assert len(own) == b - a
                        n += 1
                        for w, h in zip(own, hashes[a:b].tolist(), strict=True):
                            assert known.setdefault(w, h) == h
                assert n == len(texts) and len(set(known.values())) == len(known)


def test_ngram_join_is_brute_force(documents, texts):
    got = made(ngram_join.linked(documents), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.linked(pairs(texts)), key=repr)


def near_copies(n, length, seed):
    rng = random.Random(seed)
    base = ["b%d" % rng.randint(0, 5000) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, max(1, length // 25))):
            w[rng.randrange(length)] = "e%d" % rng.randint(0, 9999)
        out.append(" ".join(w))
    return out


def test_ngram_join_of_families(spark, monkeypatch):
    texts = [t for k, (n, m) in enumerate(((40, 150), (30, 20), (30, 9), (10, 700), (25, 66))) for t in near_copies(n, m, k)]
    passage = " ".join("p%d" % i for i in range(45))
    rng = random.Random(9)
    texts += [" ".join(["u%d" % rng.randint(0, 10**6) for _ in range(rng.randint(3, 100))]) + " " + passage for _ in range(60)]
    texts += ["one", "one two", "ONE Two", "one two three four", "one two three four five", "one two three four five six", "", None, " \n "]
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)]
    want = sorted(brute.linked(rows), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert made(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)
    assert made(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(ngram_join, "HEAVY", 0)
    assert made(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == want


def test_ngram_join_of_odd_rows(spark, odd):
    rows = ngram_join.linked(odd).collect()
    assert len(rows) == len(ODD)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert by[2, 6] == 1 and by[9, 1] == 8 and by[5, 0] == 5 and by[3, 0] == 3 and by[None, 1] is None
    left = ngram_join.representatives(odd)
    assert left.columns == odd.columns and left.filter("doc_id in (2, 9)").count() == 0
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [-3, 0, 1, 3, 4, 5, 6, 7, 8, 10]
    twice = odd.filter("doc_id in (1, 6, 7)")
    rows = ngram_join.linked(twice.unionByName(twice))
    assert rows.count() == 6 and rows.filter("kept").count() == 3
    assert sorted(r["doc_id"] for r in ngram_join.representatives(twice.unionByName(twice).unionByName(odd.filter("doc_id = 2"))).collect()) == [1, 6, 7]
    assert ngram_join.linked(spark.createDataFrame([], DOCS)).count() == 0


def test_rtree_drops_no_near_point():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, (20, 16))
    points = np.concatenate([base + (rng.random((20, 16)) < 0.05) for _ in range(10)]).astype(np.int32)
    sizes = points.sum(axis=1)
    tree = ngram_join.RTree(points, sizes)
    for i in range(len(points)):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = set(np.flatnonzero((9 * bound >= 4 * (sizes + sizes[i])) & (5 * sizes >= 4 * sizes[i])))
        assert want <= set(tree.within(points[i], int(sizes[i])).tolist())


def test_group_contents_keep_the_prefix_promise():
    rng = np.random.default_rng(4)
    for n in (4, 10, 63, 64, 100, 130, 500, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = a[rng.random(len(a)) > 0.05]
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(n * 0.04)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 9 * both < 4 * (len(a) + len(b)) or np.array_equal(a, b):
                continue
            chosen = lambda s: {x for bits, k in ngram_join.levels(len(s)) for x in np.sort(ngram_join.group_contents(s, bits))[:k].tolist()}
            assert chosen(a) & chosen(b)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randint(0, 400), 1000 + rng.randint(0, 400)) for _ in range(250)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent if root(x) != x}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_task_tells_once_what_repeats():
    told, rng = substring_dedup.Heads(), np.random.default_rng(3)
    often, sent = rng.integers(0, 1 << 62, 50).astype(np.uint64), 0
    for batch in range(12):
        own = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        keys = np.concatenate([own, often, often if batch == 0 else often[:0]])
        rows = substring_dedup.counted(keys, mixed_second(keys), np.full(len(keys), batch), np.arange(len(keys)), told).to_pydict()
        sent += sum(k in set(often.view(np.int64).tolist()) for k in rows["key"])
        # every occurrence goes out: by itself, or in a run that is known to repeat
        assert sum(1 for r, d in zip(rows["run"], rows["doc"], strict=True) if r == 1) == 200
        assert -sum(r for r in rows["run"] if r < 0) == len(keys) - 200
    assert sent == 50
    assert not told.has(often, often).any() and told.has(often, mixed_second(often)).all()


def mixed_second(keys):
    return common.mixed(keys)


def test_substring_dedup_with_small_batches_and_a_short_memory(documents, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", 700)
    monkeypatch.setattr(substring_dedup, "HEADS", 40)
    got = made(substring_dedup.remove_repeats(documents.coalesce(2)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.remove_repeats(pairs(texts)), key=repr)


def test_ngram_join_of_a_key_that_most_documents_share(spark, monkeypatch):
    # no content counts as common, so one key has a row of each document
    monkeypatch.setattr(ngram_join, "HEAVY", 0)
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(12))
    rows = [(i, shared + " " + " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(rng.choice([1, 2, 60])))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert made(ngram_join.linked(df), "doc_id", "n_shingles", "component_id") == sorted(brute.linked(rows), key=repr)


def test_large_groups_and_filters_that_let_all_through(spark, documents, texts, monkeypatch):
    want = sorted(brute.dedup(pairs(texts)), key=repr)
    told = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    monkeypatch.setattr(exact_dedup, "HOT", 60)  # groups of a few rows count as large
    assert made(exact_dedup.dedup(documents), *told) == want
    monkeypatch.setattr(exact_dedup, "maybe_in", lambda keys, *f: np.ones(len(keys), bool))
    monkeypatch.setattr(exact_dedup, "HOT", 1)
    assert made(exact_dedup.dedup(documents), *told) == want
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert made(exact_dedup.dedup(df), *told) == sorted(brute.dedup(rows), key=repr)
