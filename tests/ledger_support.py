"""A small ledger, and files that come to it."""

import hashlib

import pytest

from docindex.operators.ledger import Ledger

RECORD = "file_id string, sha256_full string, size long, mime string, modalities_done string, parser_version string, indexed_at long, tombstoned_at long, vector_count long, last_error string"
PATH = "root_id string, path string, file_id string, mtime_ms long"
CHUNK = "point_id string, file_id string, root_ids array<string>, chunk_no int, text string, tombstoned_at long, mtime_ms long, dense array<float>"
FILE = "root_id string, path string, content string, size long, mtime_ms long, priority int, id long"
LONG = "some words that go on and on " * 6


def name(content):
    return hashlib.sha256(content.encode()).hexdigest()[:32]


def file(i, root, path, content, size=None):
    return (root, path, content, size or len(content), i * 10, 100, i)


@pytest.fixture
def control(spark):
    exts = spark.createDataFrame([(e, True) for e in (".md", ".txt", ".html", ".pdf", ".doc", ".log")], "ext string, enabled boolean")
    return exts, spark.createDataFrame([], "root_id string, path_glob string, action string")


@pytest.fixture
def before(spark):
    dead, old, both = name("dead " + LONG), "old", "both"
    return Ledger(
        spark.createDataFrame([(dead, dead, 1, "text/plain", '{"text":"m"}', "v", 1, 5, 3, "err"), (old, old, 1, "text/plain", '{"text":"m"}', "v", 1, None, 1, None), (both, both, 1, "text/plain", '{"text":"m"}', "v", 1, None, 1, None)], RECORD),
        spark.createDataFrame([("r1", "/a.txt", old, 1), ("r1", "/b.txt", both, 1), ("r2", "/b2.txt", both, 1)], PATH),
        spark.createDataFrame([("p0", dead, [], 0, "d", 5, 1, None), ("p1", old, ["r1"], 0, "o", None, 1, None), ("p2", both, ["r1", "r2"], 0, "b", None, 1, None)], CHUNK),
    )


FILES = [
    file(1, "r1", "/a.txt", LONG), file(2, "r1", "/b.txt", LONG), file(3, "r2", "/c.txt", "dead " + LONG), file(4, "r1", "/page.html", f"<h1>T</h1><p>{LONG}</p><script>x</script>"),
    file(5, "r1", "/x.pdf", "%PDF raw " + LONG), file(6, "r1", "/x.doc", "OLE raw " + LONG), file(7, "r1", "/big.log", "big " + LONG, 5 << 20), file(8, "r1", "/DATA/@eaDir/g.txt", "gated " + LONG),
    file(9, "r1", "/n.mov", "movie " + LONG), file(10, "r1", "/m.mov", "two " + LONG), file(11, "r3", "/m.txt", "two " + LONG), file(12, "r1", "/s.txt", "short"),
]
