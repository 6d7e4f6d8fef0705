import fnmatch
import posixpath
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests_support import rows
from docindex.functions import ids, paths

PATHS = ["/a/b.md", "/a//b/./c/../d.TXT", "//a/b", "///a/b", "a/../../b", "../../x", "", ".", "/", "..", "/..", "/../a", "a/..", "./.", "/DATA/Notes/x.md", "/DATA/NotesArchive/a.md", "/DATA/docs/lost+found/x.md", "/DATA/docs/lost+found", "//DATA/Notes/x.md", "/x/.Trash-1000/y", "/DATA/a/../Notes/z", "/x/@eaDir/y.txt"]


def test_normalize_path_is_posix(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    for p, n in df.select("path", paths.normalize_path(F.col("path"))).collect():
        assert n == posixpath.normpath(p), p


@settings(max_examples=1, deadline=None)
@given(st.just(None))
def test_random_paths(_):
    import random

    from pyspark.sql import SparkSession

    rng = random.Random(3)
    made = ["".join(rng.choice(["/", "..", ".", "a", ".b", "c.d"]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    df = SparkSession.getActiveSession().createDataFrame([(p,) for p in made], "path string")
    for p, n, e in df.select("path", paths.normalize_path(F.col("path")), paths.path_ext(F.col("path"))).collect():
        assert n == posixpath.normpath(p), p
        assert e == posixpath.splitext(posixpath.basename(p))[1].lower(), p


def test_gate(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    gated = {p for p, g in df.select("path", paths.is_gated(F.col("path"))).collect() if g}
    assert gated == {"/DATA/Notes/x.md", "/DATA/docs/lost+found/x.md", "/x/.Trash-1000/y", "/DATA/a/../Notes/z", "/x/@eaDir/y.txt"}


def test_globs_match_like_fnmatch(spark):
    globs = ["*.md", "/a/*", "a?c", "[ab]*", "[!ab]*", "x[", "*.[ch]pp", "a.b", "*"]
    names = ["x.md", "/a/b/c.md", "abc", "a/c", "bcd", "xyz", "x[", "m.hpp", "a.b", "axb", ""]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for g in globs:
        got = {r[0] for r in df.filter(F.col("path").rlike(paths.glob_regex(g))).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, g)}, g


def test_uuid5(spark):
    df = spark.createDataFrame([("x",), ("é:body:0",), ("",)], "n string")
    for n, u in df.select("n", ids.uuid5(ids.OID, F.col("n"))).collect():
        assert u == str(uuid.uuid5(uuid.NAMESPACE_OID, n))
    assert re.fullmatch(r"[0-9a-f-]{36}", u)


def test_mime(spark):
    df = spark.createDataFrame([("/a.HTML",), ("/b.nothing",), ("/c",)], "path string")
    assert rows(paths.guess_mime(df)) == [("/a.HTML", "text/html"), ("/b.nothing", "application/octet-stream"), ("/c", "application/octet-stream")]
