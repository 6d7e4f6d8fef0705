"""Keyed updates that repeat, pages by key, models kept by workers, checksums, rules by their literals, and exact search that passes pieces over."""

import fnmatch
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docindex.functions import paths
from docindex.operators import inference, jobs, ledger, reports, routing, search, upserts, verify
from docindex.plans.queries import upserted_chunks
from docindex.sources import layout
from tests_support import DATA, rows

SMALL = str(DATA / "sf0.001")


def test_updates_that_name_a_key_twice(spark):
    chunks = spark.createDataFrame([(1, "f", ["a"], None), (2, "f", ["a"], None), (3, "g", ["a"], 7)], "id long, file_id string, root_ids array<string>, tombstoned_at long")
    updates = spark.createDataFrame([("f", ["x"], 5), ("f", [], 9), ("g", ["z"], 3), ("g", ["z"], 3)], "file_id string, new_roots array<string>, at long")
    assert rows(upserts.set_chunk_roots(chunks, updates)) == [(1, "f", [], 9), (2, "f", [], 9), (3, "g", ["z"], None)]
    schema = "file_id string, size long, mime string, parser_version string, indexed_at long"
    old = spark.createDataFrame([("f", 1, "m", "v", 1, 4, 2)], schema + ", tombstoned_at long, vector_count long")
    new = spark.createDataFrame([("f", 2, "n", "v", 5), ("f", 3, "o", "v", 6), ("n", 4, "p", "v", 1), ("n", 4, "p", "v", 1)], schema)
    assert rows(upserts.upsert_records(old, new)) == [("f", 3, "o", "v", 6, None, 2), ("n", 4, "p", "v", 1, None, 0)]
    table = spark.createDataFrame([(i, None, None, 3) for i in range(3)], "id long, done_at long, last_error string, attempts int").withColumn("locked_until", F.lit(1).cast("long"))
    outcomes = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, None)], "id long, error string")
    assert rows(jobs.apply_outcomes(table, outcomes, 9).select("id", "done_at", "last_error", "attempts", "locked_until")) == [(0, None, "b", 4, None), (1, 9, None, 3, None), (2, None, None, 3, 1)]


@pytest.mark.parametrize(("sort", "descending"), [("size", True), ("size", False), ("indexed_at", True), ("path", False), ("path", True)])
def test_pages_by_key_are_pages_by_offset(spark, sort, descending):
    rng = random.Random(2)
    records = spark.createDataFrame([(f"f{i:03d}", rng.choice([None, 1, 2, 3]), rng.choice([None, 5]), None, None) for i in range(60)], "file_id string, size long, indexed_at long, tombstoned_at long, last_error string")
    none = spark.createDataFrame([], "root_id string, path string, file_id string, mtime_ms long")
    work = spark.createDataFrame([], "root_id string, path string, done_at long")
    key = "file_id" if sort == "path" else sort
    order = [F.desc(c) if descending else F.asc(c) for c in dict.fromkeys((key, "file_id"))]
    ids = lambda **at: [r["file_id"] for r in reports.list_files(records, none, work, sort, descending, 13, **at)[0].orderBy(*order).collect()]
    whole = {r["file_id"]: r[key] for r in records.collect()}
    after, seen = None, []
    while page := ids(after=after):
        assert page == ids(offset=len(seen))
        seen += page
        after = (whole[page[-1]], page[-1])
    assert sorted(seen) == sorted(whole) and len(seen) == 60


def counting_encoder(folder):
    def make():
        with open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}", "w"):
            pass
        return lambda texts: [([float(len(t)), float(max(map(len, texts)) - min(map(len, texts)))], {len(t): 1.0}) for t in texts]

    return make


def test_a_worker_keeps_its_model(spark, tmp_path):
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), (F.col("id") * 7 % 100).cast("int")).alias("text")).repartition(24)
    out = inference.embed(df, counting_encoder(str(tmp_path)), 8)
    for _ in range(2):
        got = {r["id"]: (r["dense"][0], r["sparse"]["indices"]) for r in out.collect()}
    assert got == {i: (float(i * 7 % 100), [i * 7 % 100]) for i in range(4000)}
    loads = [n.split("-")[0] for n in os.listdir(tmp_path)]
    assert len(loads) == len(set(loads)) < 24  # one load a worker over 48 tasks
    # batches hold texts of about one length
    assert out.agg(F.avg(F.col("dense")[1])).head()[0] < 10
    order = []
    assert inference.by_length(["ccc", "a", "bb", ""], lambda t: order.append(t) or [x.upper() for x in t], 3) == ["CCC", "A", "BB", ""] and order == [["", "a", "bb"], ["ccc"]]


def test_models_of_one_factory_have_one_name_and_old_ones_go(tmp_path):
    a, b = inference.hash_encoder(4), inference.hash_encoder(5)
    assert inference.named_model(a)[0] == inference.named_model(inference.hash_encoder(4))[0] != inference.named_model(b)[0]
    made = []
    for name in "aabcab":
        inference.model((name, lambda name=name: made.append(name) or (lambda: name)))
    assert made == ["a", "b", "c", "a", "b"] and len(inference._models) <= inference.MODELS


INVENTORY = "root_id string, path string, mtime_ms long"


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_checksums_leave_out_what_is_alike(spark, ranges, monkeypatch):
    here = [(f"r{i % 3}", f"/p{i}", i * 10_000) for i in range(3000)] + [("r9", "/only", 1)]
    up = [r for r in here if r[1] not in ("/p5", "/p77") and r[0] != "r9"] + [("r0", "/new", 1), ("r8", "/x", 2)]
    up = [(r, p, m + (5000 if p == "/p100" else 400 if p == "/p200" else 0)) for r, p, m in up]
    a, b = spark.createDataFrame(up, INVENTORY), spark.createDataFrame(here, INVENTORY)
    whole = rows(verify.diff_ledger(a, b).filter("class <> 'same'"))
    assert rows(verify.diff_unlike(a, b, ranges=ranges).filter("class <> 'same'")) == whole and len(whole) == 6
    joined = []
    real = verify.diff_ledger
    monkeypatch.setattr(verify, "diff_ledger", lambda x, y, t: joined.append((x.count(), y.count())) or real(x, y, t))
    verify.diff_unlike(a, b, ranges=ranges)
    assert joined[0][0] < (2500 if ranges != 1 else 3001)
    assert verify.diff_unlike(b, b.repartition(5), ranges=ranges).count() == 0 and joined[1] == (0, 0)  # equal sides join no row
    assert rows(verify.diff_unlike(a.limit(0), b.filter("root_id = 'r9'"), ranges=ranges).select("path", "class")) == [("/only", "extra")]
    # a row that comes twice on one side is no equal side
    assert not verify.unlike_ranges(b, b.unionByName(b.limit(1)), ranges or 3).isEmpty()


def test_roots_and_paths_go_in_one_pass(spark):
    records = spark.createDataFrame([(f, None) for f in "abcd"], "file_id string, tombstoned_at long")
    where = spark.createDataFrame([("r1", "/1", "a", 1), ("r2", "/2", "a", 1), ("r1", "/3", "b", 1), ("r2", "/4", "c", 1), ("r3", "/5", "c", 1), ("r3", "/6", "d", 1)], "root_id string, path string, file_id string, mtime_ms long")
    chunks = records.select("file_id", F.array(F.lit("x")).alias("root_ids"), "tombstoned_at")
    led = ledger.Ledger(records, where, chunks, spark.createDataFrame([], "id long, root_id string, path string, op string, done_at long"))
    gone, more = spark.createDataFrame([("r1",)], "root_id string"), spark.createDataFrame([("r2", "/4"), ("r2", "/2"), ("zz", "/")], "root_id string, path string")
    one, counts = ledger.retire_roots(led, gone, 9, more)
    two = ledger.delete_paths(ledger.retire_roots(led, gone, 9)[0], more, 9)
    for t in ("records", "paths", "chunks"):
        assert rows(getattr(one, t)) == rows(getattr(two, t))
    assert rows(counts) == rows(ledger.retire_roots(led, gone, 9)[1]) == [("r1", 2, 1, 1, 0)]


def test_an_upsert_leaves_a_bucketed_table_where_it_is(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = upserted_chunks(spark, SMALL)
        join = out._jdf.queryExecution().executedPlan().toString().split("LeftAnti")[1].split("\n   +- Project")[0]
        assert "Exchange" not in join.split(":     +-")[0] and "Bucketed: true" in join
        # opened in another session by its path alone
        t = layout.clustered(spark.range(100).withColumn("s", F.struct(F.lit(1).alias("x"))), "id", 4)
        path = t.inputFiles()[0].rsplit("/", 1)[0]
        again = layout.open_clustered(spark, path, t.schema, ["id"], 4)
        assert "Exchange" not in again.groupBy("id").count()._jdf.queryExecution().executedPlan().toString() and again.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


GLOBS = ["*.md", "*", "?", "/a/*", "/a/b/c.md", "/a/b/*.md", "*/b/*", "/a?/b*", "[ab]*", "*/c.m[de]", "*/[ab]/c.md", "a*b", "/data-1/x_y/*", "*/n.txt", "**/b/c*", "*.tar.gz", "/a/b", "b", ".md", "*/", "/", "x[", "/a/[!b]/*", "*.m?", "*/a b/*"]
PATHS = ["/a/b/c.md", "/a/b/c.me", "/a/b", "b", "a/b/c", "/a1/bx", "/data-1/x_y/z", "/q/n.txt", "/x.tar.gz", ".md", "/", "", "/a/c/d", "x[", "/a/a b/c", "/b/", "c.md", "/a/[ab]/c.md"]


def test_a_path_has_the_key_of_every_glob_that_matches_it(spark):
    rng = random.Random(4)
    more = ["".join(rng.choice("ab/.*?-") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    where = PATHS + ["".join(rng.choice("ab/.-") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    keys = {r["path"]: set(r["k"]) | {""} for r in spark.createDataFrame([(p,) for p in dict.fromkeys(where)], "path string").select("path", paths.path_keys(F.col("path")).alias("k")).collect()}
    for g in GLOBS + more:
        key = paths.glob_key(g)
        assert all(key in keys[p] for p in keys if fnmatch.fnmatchcase(p, g)), g
    assert [paths.glob_key(g) for g in ("/data/src1/docs/d12.*", "*/d12.mov", "*/src1/*", "*.mov", "*ab*", "/a/b.md")] == ["p:/data/src1/docs/d12.", "n:d12.mov", "f:src1", "e:mov", "", "n:b.md"]


def test_many_rules_are_few_rules(spark, monkeypatch):
    rng = random.Random(5)
    made = [(f"r{rng.randint(0, 2)}", rng.choice(GLOBS), rng.choice(["deny", "allow"])) for _ in range(60)] + [("r0", None, "deny")]
    where = spark.createDataFrame([(f"r{i}", p) for p in PATHS for i in range(4)] * 2, "root_id string, path string")
    rules, exts = spark.createDataFrame(made, "root_id string, path_glob string, action string"), spark.createDataFrame([(".md", True), (".txt", False)], "ext string, enabled boolean")
    want = rows(routing.indexable(where, exts, rules.filter("path_glob is not null")))
    for few in (0, 4):  # none, or some, of the rules without a key as an expression
        monkeypatch.setattr(routing, "RULES", few)
        assert rows(routing.indexable(where, exts, rules)) == want
    plan = routing.indexable(where, exts, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "_key" in plan


def test_pieces_that_cannot_win_are_passed_over():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = rng.standard_normal((30, 24))
    m = unit(centre[rng.integers(0, 30, 6000)] + rng.standard_normal((6000, 24)) * 0.1)
    flat = unit(rng.standard_normal((3000, 24)))
    same = np.repeat(unit(rng.standard_normal((1, 24))), 1500, axis=0)
    for rows_, least in ((m, 0.5), (flat, 0.0), (same, 0.0), (np.concatenate([m, same, np.zeros((5, 24))]), 0.5), (m[:3], 0.0)):
        q = np.concatenate([rows_[:: max(1, len(rows_) // 90)], unit(rng.standard_normal((10, 24)))])
        i, j, met, whole = search.candidates(q, rows_, 5)
        assert whole >= met and 1 - met / whole >= least
        score = q @ rows_.T
        for n in range(len(q)):
            kth = np.sort(score[n])[-min(5, len(rows_))]
            assert set(np.flatnonzero(score[n] >= kth)) <= set(j[i == n].tolist())
