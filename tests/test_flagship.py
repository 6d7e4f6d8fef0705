"""The flagship plan, the ledger that follows a stream, and recall by point, on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests_support import rows
from docindex.operators import inference, search
from docindex.operators.ledger import Ledger
from docindex.plans.indexing import converted, index_batch
from docindex.sources import io
from docindex.streaming import stream

from ledger_support import FILE, FILES, LONG, before, control, name  # noqa: F401  fixtures


def test_a_batch_goes_through_the_whole_plan(spark, before, control):
    out = index_batch(before, spark.createDataFrame(FILES, FILE), *control, "v", "m", 99, encoder=inference.hash_encoder(8))
    did = {r["path"]: (r["action"], r["old_file_id"], r["orphaned"], r["root_lost"]) for r in out.actions.collect()}
    assert did["/a.txt"] == ("FULL_INDEX", "old", True, False) and did["/b.txt"] == ("APPEND_ROOT_ONLY", "both", False, True) and did["/c.txt"][0] == "REVIVE"
    assert did["/m.txt"][0] == "FULL_INDEX" and did["/m.mov"][0] == "APPEND_ROOT_ONLY" and "/DATA/@eaDir/g.txt" not in did
    r = {x["file_id"]: x for x in out.ledger.records.collect()}
    mime = lambda c: r[name(c)]["mime"]
    assert [mime(FILES[i][2]) for i in (0, 3, 4, 5, 6)] == ["text/plain", "text/markdown+docling/html", "application/octet-stream/pdf", "application/legacy-office/doc", "application/x-too-large/log"]
    # a file that no path lets in has a provisional record, and what was dead lives again with its own columns
    assert (r[name("movie " + LONG)]["mime"], r[name("movie " + LONG)]["modalities_done"]) == ("video/quicktime", "{}")
    dead = r[name("dead " + LONG)]
    assert (dead["tombstoned_at"], dead["vector_count"], dead["last_error"]) == (None, 3, "err") and r["old"]["tombstoned_at"] == 99 and r["both"]["tombstoned_at"] is None
    chunks = {}
    for c in out.ledger.chunks.collect():
        chunks.setdefault(c["file_id"], []).append(c)
    assert chunks["old"][0]["root_ids"] == [] and chunks["old"][0]["tombstoned_at"] == 99 and chunks["both"][0]["root_ids"] == ["r2"]
    assert chunks[name("dead " + LONG)][0]["root_ids"] == ["r2"] and chunks[name("dead " + LONG)][0]["tombstoned_at"] is None
    assert chunks[name(LONG)][0]["root_ids"] == ["r1"] and len(chunks[name(LONG)][0]["dense"]) == 8
    page = chunks[name(FILES[3][2])]
    assert page[0]["text"].startswith("# T") and "script" not in page[0]["text"] and "<" not in page[0]["text"]
    assert chunks[name("two " + LONG)][0]["root_ids"] == ["r1", "r3"]
    for content in (FILES[4][2], FILES[5][2], FILES[6][2], "short", "movie " + LONG):
        assert name(content) not in chunks and r[name(content)]["vector_count"] == 0
    assert all(r[f]["vector_count"] == len(c) for f, c in chunks.items() if f not in ("old", "both", name("dead " + LONG)))
    # the same batch again changes nothing but adds roots
    again = index_batch(Ledger(*(io.write_table(t, f"{spark.conf.get('spark.checkpoint.dir')}/again") and t for t in (out.ledger.records, out.ledger.paths, out.ledger.chunks))), spark.createDataFrame(FILES, FILE), *control, "v", "m", 100)
    assert {x["action"] for x in again.actions.filter("indexable").collect()} == {"APPEND_ROOT_ONLY"}
    assert rows(again.ledger.chunks.select("point_id", "text", "root_ids")) == rows(out.ledger.chunks.select("point_id", "text", "root_ids"))


def test_a_failing_page_has_no_text(spark):
    def broken(_):
        raise ValueError("no")

    got = {r["path"]: r for r in converted(spark.createDataFrame([("/a.html", "x", 1), ("/b.txt", "y", 1), ("/c.docx", "z", 1)], "path string, content string, size long"), broken).collect()}
    assert (got["/a.html"]["text"], got["/a.html"]["stored_mime"], got["/a.html"]["error"]) == (None, "application/octet-stream/html", "ValueError: no")
    assert got["/b.txt"]["text"] == "y" and got["/c.docx"]["text"] is None and got["/c.docx"]["stored_mime"] == "application/octet-stream/docx"


def test_throughput_as_a_stream_counts_late_rows_in_time(spark, tmp_path):
    minute = 60_000
    for i, done in enumerate(([100 * minute, 101 * minute], [130 * minute], [95 * minute, 125 * minute], [160 * minute])):
        spark.createDataFrame([(t,) for t in done], "done_at long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        feed = spark.readStream.schema("done_at long").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        stream.stream_throughput(feed).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r["start_ms"] // minute: r["completed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 95 came when the watermark was past its windows; 125 was late but in time
    assert got[100] == 2 and got[92] == 2 and got[91] == 1 and got[121] == 2 and 90 not in got


def test_recall_goes_by_point(spark):
    point = [(f"u1:{s}:{n}", 1, s, n, f"{s}{n}", 0, [1.0, float(n)] if s == "a" else [float(n), 1.0]) for s in "ab" for n in range(3)]
    memory = spark.createDataFrame(point, "point_id string, user_id long, session_id string, chunk_no long, text string, created_at long, dense array<double>")
    queries = spark.createDataFrame([(7, 1, [1.0, 0.0])], "query_id long, user_id long, dense array<double>")
    got = search.query_memory(queries, memory, 5).orderBy("rank").collect()
    assert [(r["session_id"], r["chunk_no"], r["text"]) for r in got] == [("a", 0, "a0"), ("b", 2, "b2"), ("a", 1, "a1"), ("b", 1, "b1"), ("a", 2, "a2")]
    notes = memory.withColumnRenamed("session_id", "note_id").withColumns({"type": F.lit("fact"), "status": F.when(F.col("note_id") == "a", "open").otherwise("done"), "updated_at": F.col("chunk_no") + 40})
    got = search.query_notes(queries, notes, 10, ["open"]).orderBy("rank").collect()
    assert [(r["note_id"], r["chunk_no"], r["text"], r["updated_at"]) for r in got] == [("a", 0, "a0", 40), ("a", 1, "a1", 41), ("a", 2, "a2", 42)]
    assert rows(search.candidate_counts(queries, memory)) == [(7, 6)]
