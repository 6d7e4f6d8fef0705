import pytest

from tests_support import rows
from docindex.sources import io
from docindex.streaming import stream


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo\n".encode() + b"\xff")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "big.log").write_bytes(b"x" * 2000)
    got = {r["path"].rsplit("/", 1)[1]: r for r in io.read_files(spark, str(tmp_path), 1000).collect()}
    assert got["a.txt"]["text"] == "héllo\n�" and got["a.txt"]["mime"] is None and got["a.txt"]["size"] == 8
    assert got["big.log"]["text"] is None and got["big.log"]["mime"] == "application/x-too-large/log"


def test_html(spark):
    df = spark.createDataFrame([(1, "<h1>T</h1><p>a <b>b</b> &amp; c</p><script>x</script>"), (2, None)], "id long, content string")
    got = {r["id"]: r["text"] for r in io.to_markdown(df).collect()}
    assert got == {1: "# T\n\na **b** & c", 2: None}

    def broken(_):
        raise RuntimeError("no")

    bad = io.to_markdown(df, broken).filter("id = 1").head()
    assert bad["text"] is None and bad["error"] == "RuntimeError: no"


def test_roots_without_ids(spark):
    with pytest.raises(ValueError):
        io.normalize_roots(spark.createDataFrame([(None, "/x")], "id string, path string"))
    assert rows(io.normalize_roots(spark.createDataFrame([("a", "/x"), (None, "/y")], "ID string, Path string"))) == [("a", "/x", True)]


def test_events_of_one_millisecond(spark):
    ev = spark.createDataFrame([(5, i) for i in range(100, 103)] + [(4, 999)], "detected_at long, seq long")
    page = io.read_events_after(ev, 5, 100, 10)
    assert rows(page) == [(5, 101), (5, 102)] and rows(io.cursor_of(page)) == [(5, 102)]


def test_gap_transitions(spark):
    cursors = spark.createDataFrame([("new", 1000, 1), ("fresh", 0, 0), ("back", 9000, 1), ("retry", 10, 1), ("untold", 10, 1)], "feed string, since_ms long, last_seq long")
    horizons = spark.createDataFrame([(f, 5000, True) for f in ("new", "fresh", "back", "retry")] + [("untold", 5000, False)], "feed string, archive_cutoff_ms long, has_archived boolean")
    gaps = spark.createDataFrame([("back", 1, 2, 3, 4, True), ("retry", 1, 2, 3, 4, False), ("untold", 1, 2, 3, 4, False)], "feed string, detected_at long, since_ms long, last_seq long, archive_cutoff_ms long, triggered boolean")
    after = stream.cursor_gap_transition(cursors, horizons, gaps, 77)
    assert rows(after.select("feed", "detected_at", "fire")) == [("new", 77, True), ("retry", 1, True), ("untold", 1, False)]
    started = stream.set_triggered(after, spark.createDataFrame([("new",)], "feed string"))
    assert rows(started.select("feed", "triggered")) == [("new", True), ("retry", False), ("untold", False)]


def test_stream_rerun_adds_nothing(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    ev = spark.createDataFrame([("r", f"/a{i}.md", "create", 0, i, i) for i in range(20)], "root_id string, path string, op string, is_dir int, detected_at long, seq long")
    ev.repartition(5).write.parquet(src)
    exts = spark.createDataFrame([(".md", True)], "ext string, enabled boolean")
    rules = spark.createDataFrame([], "root_id string, path_glob string, action string")
    for _ in range(2):
        feed = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(src)
        stream.stream_events_to_jobs(feed, exts, rules, out, state).awaitTermination()
        assert spark.read.parquet(out).count() == 20


def test_files_above_the_readers_limit_have_their_row(spark, tmp_path):
    (tmp_path / "ok.txt").write_bytes(b"fine")
    (tmp_path / "edge.txt").write_bytes(b"x" * 100)
    (tmp_path / "large.log").write_bytes(b"x" * 150)
    (tmp_path / "huge.log").write_bytes(b"x" * 500)
    key = "spark.sql.sources.binaryFile.maxLength"
    for limit, most in ((100, 200), (1 << 20, 120)):
        spark.conf.set(key, most)
        try:
            df = io.read_files(spark, str(tmp_path), limit)
            got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["mime"], r["text"]) for r in df.collect()}
            plan = df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset(key)
        assert got == {"ok.txt": (4, None, "fine"), "edge.txt": (100, None, "x" * 100), "large.log": (150, "application/x-too-large/log", None), "huge.log": (500, "application/x-too-large/log", None)}
        scans = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
        assert len(scans) == 2 and sum("content" in line.split("Batched")[0] for line in scans) == 1
        assert all("length" in line.split("PushedFilters")[1] for line in scans)


def brute_markdown(html):
    """The converter's rules by regular expressions over the page's tags."""
    import re
    from html import unescape

    blocks = "p|div|article|section|ul|ol|table|tr|br|blockquote|pre|header|footer|main"
    html = re.sub(r"(?s)<!--.*?-->|<!.*?>", "", html)
    for tag in ("script", "style", "nav", "noscript", "template"):
        html = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\x00", html)
    out = []
    for part in re.split(r"(<[^>]*>)", html.replace("\x00", "<skipped>")):
        tag = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)", part)
        if not tag:
            data = unescape(part)
            if data:
                out.append(" " * data[:1].isspace() + " ".join(data.split()) + " " * data[-1:].isspace() if data.strip() else " ")
            continue
        end, name = tag[1], tag[2].lower()
        if re.fullmatch("h[1-6]", name):
            out.append("\n\n" if end else "\n\n" + "#" * int(name[1]) + " ")
        elif name == "li" and not end:
            out.append("\n- ")
        elif name in ("b", "strong"):
            out.append("**")
        elif re.fullmatch(blocks, name):
            out.append("\n\n")
    text = re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(out)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def test_pages_are_converted_like_brute_force(spark):
    import hashlib

    from docindex.operators import chunking
    from docindex.plans.queries import QUERIES
    from tests_support import DATA

    d = str(DATA / "sf0.01")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["s2_to_markdown"](spark, d).collect()}
    assert got.keys() == pages.keys() and len(got) > 200
    for i, html in pages.items():
        text = brute_markdown(html)
        assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest(), i
        assert got[i]["n_chunks"] == len(chunking.chunk_markdown(text, least=20)) and got[i]["error"] is None
