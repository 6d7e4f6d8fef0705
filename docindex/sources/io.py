"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_ext
from ..operators.routing import MAX_FILE_BYTES
from .layout import manifest, read_buckets, replace_buckets, write_table  # noqa: F401  S7

PREVIEW = 40_000
#: Rows of a page of captions, and events of a page, at most.
PAGE = 1024


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, **options) -> DataFrame:
    """Path, size, mtime_ms, mime, text (UTF-8, broken bytes replaced) of the files below path.

    A file above max_bytes, or above what the reader takes (spark.sql.sources.binaryFile.maxLength), has its row without text. Its
    size is a filter of the scan that reads contents, so no byte of it is read; its row comes from a scan without contents."""
    raw = spark.read.format("binaryFile").options(recursiveFileLookup=True, **options).load(path)
    most = min(max_bytes, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    own = ["path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")]
    none = F.lit(None).cast("string")
    small = raw.filter(F.col("length") <= most).select(*own, none.alias("mime"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))
    mime = F.concat(F.lit("application/x-too-large/"), F.regexp_replace(path_ext(F.col("path")), r"^\.", ""))
    return small.unionByName(raw.filter(F.col("length") > most).select(*own, mime.alias("mime"), none.alias("text")))


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists and emphasis of a page as markdown; scripts, styles and navigation are left out."""

    SKIPPED = {"script", "style", "nav", "noscript", "template"}
    BLOCKS = {"p", "div", "article", "section", "ul", "ol", "table", "tr", "br", "blockquote", "pre", "header", "footer", "main"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif self.skip:
            return
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in self.BLOCKS or tag[:1] == "h" and tag[1:].isdigit():
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(" " * data[:1].isspace() + " ".join(data.split()) + " " * data[-1:].isspace() if data.strip() else " ")


def html_to_markdown(html: str) -> str:
    import re

    p = _Markdown()
    p.feed(html)
    p.close()
    text = re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", "".join(p.out)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(df: DataFrame, converter: Callable[[str], str] = html_to_markdown, content: str = "content", only: str | None = None) -> DataFrame:
    """Df with `text` and `error`. A row that fails keeps its error and no text; raw bytes are never taken as text.

    only: a boolean column; rows where it doesn't hold keep their content as text."""
    schema = df.withColumns({c: F.lit(None).cast("string") for c in ("text", "error")}).schema

    def one(html: str | None) -> tuple[str | None, str | None]:
        try:
            return (converter(html) if html is not None else None), None
        except Exception as e:  # noqa: BLE001  a converter may fail in any way
            return None, f"{type(e).__name__}: {e}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                chosen = part.column(only).to_pylist() if only else [True] * part.num_rows
                made = [one(h) if c else (h, None) for h, c in zip(part.column(content).to_pylist(), chosen, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t for t, _ in made], pa.string()), pa.array([e for _, e in made], pa.string())], [*part.schema.names, "text", "error"])

    return df.mapInArrow(work, schema)


def converted_mime(df: DataFrame) -> DataFrame:
    """stored_mime of converted files: those that failed are octet streams without chunks."""
    bare = F.regexp_replace(path_ext(F.col("path")), r"^\.", "")
    return df.withColumn("stored_mime", F.concat(F.when(F.col("error").isNull(), "text/markdown+docling/").otherwise("application/octet-stream/"), bare))


def extract_preview(df: DataFrame, max_chars: int = PREVIEW) -> DataFrame:
    """S3: text cut to max_chars, and whether it was."""
    return df.withColumn("truncated", F.char_length("text") > max_chars).withColumn("text", F.substring("text", 1, max_chars))


def read_events_after(events: DataFrame, since_ms: int, seq: int, limit: int) -> DataFrame:
    """The first `limit` events behind the cursor (since_ms, seq), in its order."""
    behind = (F.col("detected_at") > since_ms) | ((F.col("detected_at") == since_ms) & (F.col("seq") > seq))
    return events.filter(behind).orderBy("detected_at", "seq").limit(limit)


def cursor_of(page: DataFrame) -> DataFrame:
    """The cursor behind a page: one row, null for an empty page."""
    return page.agg(F.max(F.struct("detected_at", "seq")).alias("c")).select("c.detected_at", "c.seq")


def normalize_roots(df: DataFrame) -> DataFrame:
    """Id, path, enabled of a listing with either spelling of its fields. Rows without id go; if all go, it is an error."""
    have = {c: c for c in df.columns}
    pick = lambda *names: F.coalesce(*[F.col(f"`{have[n]}`").cast("string") for n in names if n in have], F.lit(None).cast("string"))
    enabled = F.coalesce(F.col("enabled").cast("boolean"), F.lit(True)) if "enabled" in have else F.lit(True)
    rows = df.select(F.nullif(pick("id", "ID"), F.lit("")).alias("id"), pick("path", "Path").alias("path"), enabled.alias("enabled"))
    counts = rows.agg(F.count("*").alias("n"), F.count("id").alias("known")).head()
    if counts["n"] and not counts["known"]:
        raise ValueError("no root of the listing has an id")
    return rows.filter("id is not null")


def export_captions(chunks: DataFrame, source: str, after_id: str | None, limit: int) -> DataFrame:
    """A page of a source's captions by point id: point_id, asset_id, text, mtime_ms. The limit counts points, of which those
    of other names are then left out."""
    rows = chunks.filter(F.array_contains("root_ids", source) & (F.col("kind") == "caption") & F.col("tombstoned_at").isNull())
    if after_id:
        rows = rows.filter(F.col("point_id") > after_id)
    page = rows.orderBy("point_id").limit(max(1, min(limit, PAGE)))
    prefix = source + ":"
    return page.filter(F.startswith("file_id", F.lit(prefix))).select("point_id", F.substring("file_id", len(prefix) + 1, 1 << 30).alias("asset_id"), "text", "mtime_ms")
