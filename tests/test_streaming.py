"""The ledger that follows a stream, bucketed tables, the feed as a source, and gaps whose state lives in a stream."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQueryException

from docindex.operators.ledger import Ledger
from docindex.operators.routing import events_to_jobs
from docindex.plans.indexing import apply_jobs
from docindex.sources import io, layout
from docindex.streaming import feed, store, stream
from ledger_support import FILE, FILES, before, control, name  # noqa: F401  fixtures
from tests_support import rows

JOB = "root_id string, path string, op string, priority int, detected_at long, seq long"
EVENT = "root_id string, path string, op string, is_dir int, detected_at long, seq long"


def told(ledger):
    return (rows(ledger.paths.select("root_id", "path", "file_id")), rows(ledger.records.select("file_id", "mime", "tombstoned_at", "vector_count")), rows(ledger.chunks.select("point_id", "root_ids", "tombstoned_at")), rows(ledger.jobs.select("id")) if ledger.jobs is not None else None)


class Followed:
    """A stream of jobs over FILES, in a folder of its own."""

    def __init__(self, spark, before, control, tmp_path):  # noqa: F811
        self.spark, self.before, self.control = spark, before, control
        self.src, self.folder, self.state = (str(tmp_path / x) for x in ("in", "ledger", "state"))
        self.files = spark.createDataFrame(FILES, FILE)
        self.fetched = []

    def fetch(self, keys):
        self.fetched.append(rows(keys))
        return self.files.join(keys, ["root_id", "path"], "left_semi")

    def change(self, led, batch, files):
        return apply_jobs(led, batch, files, *self.control, "v", "m", 99)

    def add(self, jobs):
        self.spark.createDataFrame(jobs, JOB).coalesce(1).write.mode("append").parquet(self.src)

    def run(self):
        jobs = self.spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(self.src)
        stream.stream_ledger(jobs, self.before, self.fetch, self.change, self.folder, self.state, 8).awaitTermination()
        return store.read(self.spark, self.folder)


@pytest.fixture
def followed(spark, before, control, tmp_path):  # noqa: F811
    before.jobs = spark.createDataFrame([(1, "r2", "/b2.txt", "index", None), (2, "r1", "/b.txt", "index", None), (3, "r2", "", "retire_root", None), (4, "r2", "/b2.txt", "index", 5)], "id long, root_id string, path string, op string, done_at long")
    return Followed(spark, before, control, tmp_path)


FIRST = [(r, p, "index", 100, 10 + i, i) for i, (r, p, *_) in enumerate(FILES)] + [("r1", "/nowhere.txt", "index", 100, 50, 50)]
SECOND = [("r1", "/b.txt", "delete", 100, 900, 900), ("r2", "", "retire_root", 50, 901, 901), ("r1", "/a.txt", "delete", 100, 902, 902), ("r1", "/a.txt", "index", 100, 899, 899)]


def wanted(f):
    out = f.before
    for batch in (FIRST, SECOND):
        jobs = stream.latest_per_path(f.spark.createDataFrame(batch, JOB))
        out = f.change(out, jobs, f.files)
    return told(out)


def test_the_ledger_follows_a_stream(followed):
    want = wanted(followed)
    followed.add(FIRST)
    followed.run()
    followed.add(SECOND)
    assert told(followed.run()) == want
    assert want[3] == [(2,), (3,), (4,)] and not any(p in ("/b.txt", "/a.txt") or r == "r2" for r, p, _ in want[0])
    assert followed.fetched[-1] == []  # nothing of the second batch is indexed: the later job of a path counts
    n = len(followed.fetched)
    assert told(followed.run()) == want and len(followed.fetched) == n  # a run without new jobs does nothing


def test_a_batch_that_dies_is_never_read(followed, monkeypatch):
    want = wanted(followed)
    followed.add(FIRST)
    first = told(followed.run())
    followed.add(SECOND)
    whole = store.commit
    for at in ("records", "owners", "mark"):
        if at == "mark":
            monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        else:
            real = store.replace_buckets
            monkeypatch.setattr(store, "replace_buckets", lambda old, new, folder, gone, at=at, real=real: (_ for _ in ()).throw(OSError("killed")) if folder.endswith(at) else real(old, new, folder, gone))
        with pytest.raises(StreamingQueryException):
            followed.run()
        assert told(store.read(followed.spark, followed.folder)) == first and store.committed(followed.spark, followed.folder)["number"] == 0
        monkeypatch.undo()
    assert store.commit is whole and told(followed.run()) == want
    # the mark was written, but the stream's own note of the batch was lost: the batch is run again
    commits = __import__("pathlib").Path(followed.state) / "commits"
    (commits / "1").unlink()
    (commits / ".1.crc").unlink(missing_ok=True)
    assert told(followed.run()) == want


def test_a_batch_reads_and_writes_its_own_buckets(spark, tmp_path, monkeypatch, control):  # noqa: F811
    n, buckets = 3000, 64
    ids = spark.range(n).withColumn("file_id", F.concat(F.lit("f"), F.col("id") % 2500))
    records = ids.select("file_id").distinct().select("file_id", F.col("file_id").alias("sha256_full"), F.lit(1).cast("long").alias("size"), F.lit("m").alias("mime"), F.lit("{}").alias("modalities_done"), F.lit("v").alias("parser_version"), F.lit(1).cast("long").alias("indexed_at"), F.lit(None).cast("long").alias("tombstoned_at"), F.lit(0).cast("long").alias("vector_count"), F.lit(None).cast("string").alias("last_error"))
    paths = ids.select(F.concat(F.lit("r"), F.col("id") % 3).alias("root_id"), F.concat(F.lit("/p"), "id").alias("path"), "file_id", F.lit(1).cast("long").alias("mtime_ms"))
    chunks = records.select(F.concat(F.lit("c"), "file_id").alias("point_id"), "file_id", F.array(F.lit("r0")).alias("root_ids"), F.lit(0).alias("chunk_no"), F.lit("t").alias("text"), F.lit(None).cast("long").alias("tombstoned_at"))
    folder = str(tmp_path)
    store.create(Ledger(records, paths, chunks), folder, buckets)
    was = store.committed(spark, folder)["tables"]
    jobs = spark.createDataFrame([(f"r{i % 3}", f"/p{i}", "delete", 100, i, i) for i in range(0, 2000, 200)], JOB)
    opened = {}
    real = layout.read_buckets

    def watched(spark, path, only=None):
        out = real(spark, path, only)
        opened.setdefault(path, set()).update(out.inputFiles())
        return out

    monkeypatch.setattr(store, "read_buckets", watched)
    monkeypatch.setattr(layout, "read_buckets", watched)
    none = spark.createDataFrame([], FILE)
    store.apply_batch(spark, folder, 0, jobs, lambda keys: none, lambda led, batch, files: apply_jobs(led, batch, files, *control, "v", "m", 99))
    now = store.committed(spark, folder)["tables"]
    for table, path in was.items():
        a, b = io.manifest(spark, path), io.manifest(spark, now[table])
        changed = {k for k in a if a[k] != b[k]}
        assert 1 <= len(changed) <= 10 and len(a) == len(b) == buckets
        # files of other buckets were neither opened nor written
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in opened[path]} <= changed
        written = {int(x.split("=")[1]) for x in layout.names_in(spark, f"{now[table]}/data") if "=" in x}
        assert written <= changed
    after = store.read(spark, folder)
    assert after.paths.count() == n - 10 and after.records.count() == 2500 and after.records.filter("tombstoned_at = 99").count() == 7
    # old states go, and nothing that the last ones name
    store.forget(spark, folder, 1)
    assert store.read(spark, folder).paths.count() == n - 10 and len(layout.names_in(spark, f"{folder}/marks")) == 1
    assert len(layout.names_in(spark, f"{folder}/paths")) == 2


def test_untouched_buckets_stay_where_they_are(spark, tmp_path):
    old = spark.createDataFrame([(f"k{i}", i, i) for i in range(50)], "k string, v long, bucket long")
    for buckets in (8, 32):
        a = io.write_table(old, str(tmp_path), "k", buckets)
        b = io.replace_buckets(a, spark.createDataFrame([(5, "k3", -1), (5, "new", -2)], "bucket long, k string, v long"), str(tmp_path))
        was, now = io.manifest(spark, a), io.manifest(spark, b)
        assert len(now) == buckets and 1 <= sum(was[x] != now[x] for x in was) <= 2
        got = {r["k"]: (r["v"], r["bucket"]) for r in io.read_buckets(spark, b).collect()}
        assert len(got) == io.read_buckets(spark, b).count() == 51 and got["k3"] == (-1, 5) and got["new"] == (-2, 5) and got["k4"] == (4, 4)
        assert io.read_buckets(spark, a).count() == 50
        c = io.replace_buckets(b, old.limit(0), str(tmp_path), old.select("k"))
        assert [r["k"] for r in io.read_buckets(spark, c).collect()] == ["new"]
    # all new keys of one thousand are there once, whatever the number of buckets
    many = spark.range(1000).withColumn("v", F.lit(0))
    a = io.write_table(many, str(tmp_path), "id", 32)
    b = io.replace_buckets(a, many.filter("id % 14 = 0").withColumn("v", F.lit(1)), str(tmp_path))
    assert io.read_buckets(spark, b).count() == 1000 and io.read_buckets(spark, b).filter("v = 1").count() == 72
    assert io.read_buckets(spark, io.write_table(many.limit(0), str(tmp_path), "id")).count() == 0
    with pytest.raises(Exception, match="layout.json"):
        layout.delete_folder(spark, f"{b}/layout.json")
        io.read_buckets(spark, b)


def followed_feed(spark, tmp_path):
    exts = spark.createDataFrame([(".md", True)], "ext string, enabled boolean")
    rules = spark.createDataFrame([], "root_id string, path_glob string, action string")
    src, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))
    query = stream.stream_events_to_jobs(feed.read_feed(spark, src), exts, rules, out, state)
    query.awaitTermination()
    return src, out, events_to_jobs, exts, rules


def test_the_feed_as_a_source(spark, tmp_path):
    # many events in one millisecond, so that pages end and begin inside it; also the page at which the stream stops
    at = lambda i: 7 if 3 <= i < 40 else i
    events = [("r", f"/{i}.md", "create", 0, at(i), i) for i in range(60)]
    for part in (events[:25], events[25:31], events[31:]):
        feed.publish(spark.createDataFrame(part, EVENT).repartition(3), str(tmp_path / "feed"), 4)
        src, out, *_ = followed_feed(spark, tmp_path)
    got = spark.read.parquet(out)
    assert sorted(r["seq"] for r in got.select("seq").collect()) == list(range(60))
    by = {r["batch"]: (r["lo"], r["hi"], r["n"]) for r in got.groupBy("batch").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n")).collect()}
    assert by == {0: (0, 24, 25), 1: (25, 30, 6), 2: (31, 59, 29)}
    followed_feed(spark, tmp_path)
    assert spark.read.parquet(out).count() == 60
    reader = feed.EventFeedReader(src)
    assert reader.latestOffset() == {"detected_at": 59, "seq": 59} and all(r["events"] <= 4 for r in reader._index())
    # cursors inside a page and inside a millisecond
    seqs = lambda lo, hi: sorted(s for p in reader.partitions({"detected_at": 7, "seq": lo}, {"detected_at": 7, "seq": hi}) for b in reader.read(p) for s in b.column("seq").to_pylist())
    assert seqs(9, 22) == list(range(10, 23)) and seqs(5, 5) == [] and seqs(24, 30) == list(range(25, 31))
    parts = reader.partitions(feed.START, reader.latestOffset())
    assert sum(len(p.files) for p in parts) == len(reader._index()) and all(len(p.files) <= feed.PAGES for p in parts)


def test_a_feed_that_has_nothing_yet(spark, tmp_path):
    feed.publish(spark.createDataFrame([], EVENT), str(tmp_path / "feed"))
    _, out, *_ = followed_feed(spark, tmp_path)
    assert feed.EventFeedReader(str(tmp_path / "feed")).latestOffset() == feed.START and feed.EventFeedReader(str(tmp_path / "none")).partitions(feed.START, {"detected_at": 1, "seq": 1}) == []


def poll(at, since, cutoff, told=True, started=False, seq=1):
    return {"at": at, "since_ms": since, "last_seq": seq, "archive_cutoff_ms": cutoff, "has_archived": told, "started": started}


def walk(*polls):
    gap, out = None, []
    for p in polls:
        gap, step, fire = stream.gap_step(gap, p)
        out.append((step, fire))
    return gap, out


def test_every_transition_of_a_gap():
    # a cursor behind the archive's line is recorded once, and fires
    assert walk(poll(1, 1000, 5000)) == ((1, 1000, 1, 5000, False), [("recorded", True)])
    # a cursor that was never set is no gap, nor is one inside the horizon, nor a feed that tells no horizon
    assert walk(poll(1, 0, 5000), poll(2, 9000, 5000), poll(3, 10, None), poll(4, 10, 5000, told=False), poll(5, 5000, 5000)) == (None, [(None, False)] * 5)
    # while its verify is refused or fails it fires again at every poll, and is still the first one's record
    assert walk(poll(1, 1000, 5000), poll(2, 2000, 6000), poll(3, 2000, 7000)) == ((1, 1000, 1, 5000, False), [("recorded", True), ("retried", True), ("retried", True)])
    # once started it doesn't fire again; a word without a gap, or a second one, changes nothing
    assert walk(poll(0, None, None, started=True), poll(1, 1000, 5000), poll(1, None, None, started=True), poll(2, 2000, 6000), poll(3, None, None, started=True))[1] == [(None, False), ("recorded", True), ("started", False), (None, False), (None, False)]
    # back inside the horizon it is cleared, and the next one is recorded anew
    gap, steps = walk(poll(1, 1000, 5000), poll(1, None, None, started=True), poll(2, 5000, 5000), poll(3, 5001, 9000))
    assert steps == [("recorded", True), ("started", False), ("cleared", False), ("recorded", True)] and gap == (3, 5001, 1, 9000, False)
    # a poll that tells no horizon leaves the record as it is
    assert walk(poll(1, 1000, 5000), poll(2, 9000, 5000, told=False))[0] == (1, 1000, 1, 5000, False)


def test_gaps_live_in_the_stream(spark, tmp_path):
    schema = "feed string, at long, since_ms long, last_seq long, archive_cutoff_ms long, has_archived boolean, started boolean"
    batches = [[("a", 2, 2000, 2, 5000, True, False), ("a", 1, 1000, 1, 5000, True, False), ("b", 1, 0, 1, 5000, True, False)], [("a", 2, None, None, None, None, True), ("b", 2, 10, 1, 5000, True, None)], [("a", 3, 3000, 1, 6000, True, False), ("b", 3, 9000, 1, 5000, True, False)]]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in batches:  # stopped and started again after each
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream.stream_gaps(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(stream.TRANSITION).parquet(out).select("feed", "at", "step", "detected_at", "since_ms", "triggered", "fire").collect())
    assert got == [("a", 1, "recorded", 1, 1000, False, True), ("a", 2, "retried", 1, 1000, False, True), ("a", 2, "started", 1, 1000, True, False), ("b", 2, "recorded", 2, 10, False, True), ("b", 3, "cleared", 2, 10, False, False)]
