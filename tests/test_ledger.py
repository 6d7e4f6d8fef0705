import pytest
from pyspark.sql import functions as F

from tests_support import rows
from docindex.operators import inference, jobs, ledger, reports, routing, upserts, verify

RECORD = "file_id string, sha256_full string, size long, mime string, modalities_done string, parser_version string, indexed_at long, tombstoned_at long, vector_count long, last_error string"
PATH = "root_id string, path string, file_id string, mtime_ms long"
CHUNK = "file_id string, chunk_no int, root_ids array<string>, tombstoned_at long, mtime_ms long"
JOB = "id long, root_id string, path string, op string, priority int, attempts long, last_error string, locked_until long, created_at long, picked_at long, done_at long"


def record(f, dead=None, version="v1", error=None, mime="text/plain", models="{}"):
    return (f, "s" + f, 10, mime, models, version, 100, dead, 1, error)


def job(i, root="r1", path="/a", op="index", priority=100, attempts=0, error=None, locked=None, done=None):
    return (i, root, path, op, priority, attempts, error, locked, 1, None, done)


@pytest.fixture
def led(spark):
    make = spark.createDataFrame
    return ledger.Ledger(
        make([record("a"), record("shared"), record("gone", dead=50)], RECORD),
        make([("r1", "/a.md", "a", 1), ("r1", "/mnt/b.md", "shared", 1), ("r2", "/DATA/b.md", "shared", 2)], PATH),
        make([("a", 0, ["r1"], None, 0), ("shared", 0, ["r1", "r2"], None, None), ("gone", 0, [], 50, 5)], CHUNK),
        make([job(1, path="/a.md"), job(2, root="r2"), job(3, op="retire_root", path="")], JOB),
    )


def chunk_state(out):
    return {r["file_id"]: (r["root_ids"], r["tombstoned_at"]) for r in out.chunks.collect()}


def test_delete_path(spark, led):
    keys = spark.createDataFrame([("r1", "/a.md"), ("r1", "/mnt/b.md"), ("r9", "/none")], "root_id string, path string")
    out = ledger.delete_paths(led, keys, 999)
    assert dict(out.records.select("file_id", "tombstoned_at").collect()) == {"a": 999, "shared": None, "gone": 50}
    assert chunk_state(out) == {"a": ([], 999), "shared": (["r2"], None), "gone": ([], 50)}
    assert rows(out.paths.select("path")) == [("/DATA/b.md",)]


def test_retire_root(spark, led):
    out, counts = ledger.retire_roots(led, spark.createDataFrame([("r1",)], "root_id string"), 999)
    assert rows(counts) == [("r1", 2, 1, 1, 1)]
    assert rows(out.jobs.select("id")) == [(2,), (3,)]
    assert chunk_state(out)["shared"] == (["r2"], None)


def test_gc_is_strict(led):
    assert "gone" in chunk_state(ledger.sweep_tombstones(led, 150, 100))
    assert "gone" not in chunk_state(ledger.sweep_tombstones(led, 151, 100))


def test_reindex_reasons(spark, led):
    records = led.records.unionByName(spark.createDataFrame([record("orphan")], RECORD))
    after, todo, skipped = ledger.reindex(records, led.paths, 7, file_ids=["a", "a", "gone", "no", "orphan", "shared"])
    assert rows(skipped) == [(1, "a", "already_tombstoned"), (2, "gone", "already_tombstoned"), (3, "no", "not_found"), (4, "orphan", "no_paths_orphan")]
    assert todo.count() == 3 and {r["op"] for r in todo.collect()} == {"reindex"}
    assert dict(after.select("file_id", "tombstoned_at").collect()) == {"a": 7, "shared": 7, "gone": 50, "orphan": None}
    with pytest.raises(ValueError):
        ledger.reindex(records, led.paths, 7)
    with pytest.raises(ValueError):
        ledger.reindex(records, led.paths, 7, file_ids=["x"] * 501)


def test_identity(spark):
    make = spark.createDataFrame
    batch = make([("r1", "/new1", "n", "n", 100, 1), ("r1", "/new2", "n", "n", 100, 2), ("r1", "/same", "k", "k", 100, 3), ("r1", "/dead", "d", "d", 100, 4), ("r1", "/changed", "k", "k", 100, 5), ("r2", "/two", "k", "k", 100, 6)], "root_id string, path string, sha256_full string, file_id string, priority int, id long")
    records = make([record("k", version="v", models='{"text":"m"}'), record("d", dead=1, version="v", models='{"text":"m"}')], RECORD)
    paths = make([("r1", "/same", "k", 0), ("r1", "/changed", "old", 0), ("r2", "/two", "part", 0), ("r3", "/three", "part", 0)], PATH)
    out = {r["path"]: (r["action"], r["old_file_id"], r["orphaned"], r["root_lost"]) for r in ledger.resolve_identity(batch, records, paths, "v", {"text": "m"}).collect()}
    assert out == {
        "/new1": ("FULL_INDEX", None, False, False), "/new2": ("APPEND_ROOT_ONLY", None, False, False), "/same": ("APPEND_ROOT_ONLY", None, False, False),
        "/dead": ("REVIVE", None, False, False), "/changed": ("APPEND_ROOT_ONLY", "old", True, False), "/two": ("APPEND_ROOT_ONLY", "part", False, True),
    }


def test_diff_classes(spark):
    up = spark.createDataFrame([("r", "a", 1000), ("r", "b", 5000), ("r", "c", 9000)], "root_id string, path string, mtime_ms long")
    here = spark.createDataFrame([("r", "b", "f", 3000), ("r", "c", "f", 9500), ("r", "d", "f", 1)], "root_id string, path string, file_id string, mtime_ms long")
    assert dict(verify.diff_ledger(up, here).select("path", "class").collect()) == {"a": "missing", "b": "stale", "c": "same", "d": "extra"}


def test_verify_guards(spark, led):
    exts = spark.createDataFrame([(".md", True)], "ext string, enabled boolean")
    rules = spark.createDataFrame([], "root_id string, path_glob string, action string")
    inventory = spark.createDataFrame([], "root_id string, path string, mtime_ms long")
    none = spark.createDataFrame([], "id string, enabled boolean")
    out = verify.verify(led, inventory, none, exts, rules, 9)
    assert out.error and out.ledger is led
    roots = spark.createDataFrame([("r1", True), ("r2", False)], "id string, enabled boolean")
    out = verify.verify(led, inventory, roots, exts, rules, 9)
    assert rows(out.report.select("root_id", "status", "extra", "extra_skipped")) == [("r1", "verified", 2, 2), ("r2", "disabled", 0, 0)]
    assert out.ledger.paths.count() == 3 and out.jobs.count() == 0
    out = verify.verify(led, inventory, roots, exts, rules, 9, served=spark.createDataFrame([("zz",)], "root_id string"))
    assert out.error == "upstream files endpoint unavailable" and out.ledger.paths.count() == 3
    only = verify.verify(led, inventory, roots.filter("id = 'r1'"), exts, rules, 9, requested=["r1", "nope"])
    assert rows(only.unknown) == [("nope",)] and rows(only.retired) == []


def test_jobs(spark):
    j = spark.createDataFrame([job(1, priority=200), job(2, priority=50), job(3, locked=99), job(4, locked=5), job(5, done=1), job(6, done=1, error="x", attempts=5)], JOB)
    assert [r["id"] for r in jobs.next_batch(j, 10, 3).collect()] == [2, 4, 1]
    assert {r["id"]: r["attempts"] for r in jobs.next_batch(j, 10, 3).collect()} == {2: 1, 4: 1, 1: 1}
    left, refused = jobs.delete_jobs(j, spark.createDataFrame([(1,), (3,), (77,)], "id long"), 10)
    assert rows(refused) == [(3, "running"), (77, "not_found")] and left.count() == 5
    assert rows(jobs.retry_failed(j).filter("id = 6").select("done_at", "attempts", "last_error")) == [(None, 0, None)]
    assert jobs.clear_failed(j).count() == 5
    told = spark.createDataFrame([(1, "e"), (2, None)], "id long, error string")
    assert rows(jobs.apply_outcomes(j, told, 10, max_attempts=1).filter("id < 3").select("id", "done_at", "last_error")) == [(1, 10, "e"), (2, 10, None)]
    run, skipped = jobs.split_gated(spark.createDataFrame([(1, "index", "/x/@eaDir/a"), (2, "delete", "/x/@eaDir/a"), (3, "index", "/x/a")], "id long, op string, path string"))
    assert rows(run.select("id")) == [(2,), (3,)] and rows(skipped.select("id")) == [(1,)]


def test_events(spark):
    ev = spark.createDataFrame([("r", "/a.md", "create", 0, 1, 1), ("r", "/b.mov", "modify", 0, 2, 2), ("r", "/c.mov", "delete", 0, 3, 3), ("r", "/d", "create", 1, 4, 4), ("r", "/x", "root_removed", 1, 5, 5)], "root_id string, path string, op string, is_dir int, detected_at long, seq long")
    exts = spark.createDataFrame([(".md", True), (".mov", False)], "ext string, enabled boolean")
    rules = spark.createDataFrame([], "root_id string, path_glob string, action string")
    got = routing.events_to_jobs(ev, exts, rules).select("path", "op", "priority")
    assert rows(got) == [("", "retire_root", 50), ("/a.md", "index", 100), ("/c.mov", "delete", 100)]


def test_many_rules_are_joined(spark, monkeypatch):
    p = spark.createDataFrame([("r1", "/a/x.md"), ("r1", "/b/y.mov"), ("r2", "/a/x.md")], "root_id string, path string")
    exts = spark.createDataFrame([(".md", True)], "ext string, enabled boolean")
    few = [("r1", "/a/*", "deny"), ("r1", "*.mov", "allow")]
    many = few + [("r1", f"/none{i}/*", "deny") for i in range(routing.RULES)]
    make = lambda x: spark.createDataFrame(x, "root_id string, path_glob string, action string")
    want = [("r1", "/a/x.md", False), ("r1", "/b/y.mov", True), ("r2", "/a/x.md", True)]
    assert rows(routing.indexable(p, exts, make(few))) == want == rows(routing.indexable(p, exts, make(many)))
    # any number of different globs is taken
    monkeypatch.setattr(routing, "RULES", 3)
    assert rows(routing.indexable(p, exts, make(many))) == want


def test_sparse_weights():
    assert inference.sparse_weights([(7, 0.5), (7, 0.2), (7, 0.9), (8, 0.0), (9, -0.1), (1, 0.4)], (1,)) == {7: 0.9}


def test_rerank_refuses_too_many(spark):
    pairs = spark.range(130).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("candidate_id"), F.lit("a b").alias("query_text"), F.lit("a").alias("text"))
    with pytest.raises(Exception, match="more than 128"):
        inference.rerank(pairs, inference.overlap_scorer()).collect()
    assert inference.rerank(pairs.limit(100), inference.overlap_scorer(), 3).count() == 3


def test_last_row_of_a_key_wins(spark):
    new = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "point_id string, text string, n int")
    assert rows(upserts.last_per_key(new, ["point_id"], ["n"])) == [("k", "b", 2)]


def test_empty_tables(spark, led):
    nothing = ledger.Ledger(*(t.limit(0) for t in (led.records, led.paths, led.chunks, led.jobs)))
    assert ledger.sweep_tombstones(nothing, 5).records.count() == 0
    assert reports.queue_stats(nothing.jobs, nothing.records).head()["done"] == 0
    assert reports.throughput(nothing.jobs, 5).head()["eta_s"] is None
    assert ledger.delete_paths(nothing, led.paths.select("root_id", "path"), 5).paths.count() == 0


def test_search_of_a_hot_key(spark, monkeypatch):
    import numpy as np

    from docindex.operators import search

    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8))
    make = lambda n, name: spark.createDataFrame([(i, 0 if i % 3 else i % 7, x[i].tolist()) for i in range(n)], f"{name} long, user_id long, dense array<double>")
    want = search.top_k(make(60, "query_id"), make(400, "chunk_no"), 4, "user_id", "chunk_no").select("query_id", "chunk_no", "rank")
    want = rows(want)
    monkeypatch.setattr(search, "BLOCK", 30)
    monkeypatch.setattr(search, "SLICE", 7)
    assert rows(search.top_k(make(60, "query_id"), make(400, "chunk_no"), 4, "user_id", "chunk_no").select("query_id", "chunk_no", "rank")) == want
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    key = lambda i: 0 if i % 3 else i % 7
    for q in (0, 1, 30):
        mine = [i for i in range(400) if key(i) == key(q)]
        best = sorted(mine, key=lambda i: (-float(u[i] @ u[q]), i))[:4]
        assert [c for i, c, _ in sorted(want, key=lambda r: (r[0], r[2])) if i == q] == best
