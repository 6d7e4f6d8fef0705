"""Chunking (C1-C5, W5): texts become chunks with offsets, sections and numbers, in one narrow pass.

A buffer is always one stretch of the text, so packing works on the ends of the segments alone: the next end that still fits is
found by bisection, and text is sliced once per chunk. Offsets count code points and belong to the unstripped stretch."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.scalars import rough_tokens
from .routing import route_files

TARGET, OVERLAP = 600, 80
#: Least tokens of a chunk by the kind of text.
LEAST = {"markdown": 20, "source": 10, "plain": 20}
CHUNK = "array<struct<chunk_no:int,text:string,offset_start:int,offset_end:int,section:string,section_no:int>>"
# Blank lines, headings, the line starts that begin a block of source code, and the length of its title.
BLANK = re.compile(r"\n\s*\n")
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)
BLOCK = re.compile(r"^(?=def |class |async def |func |fn |type |impl )", re.MULTILINE)
TITLE = 120

Chunk = dict


def tokens(n: int) -> int:
    return max(1, n // 4)


def segment_ends(text: str) -> list[int]:
    """Ends of the paragraphs, or else of the lines, or else of the text; separators belong to what they end."""
    ends = [m.end() for m in BLANK.finditer(text)] or [i + 1 for i, c in enumerate(text) if c == "\n"]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def stretches(ends: list[int], target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the packed buffers. A buffer takes one segment at least; the next starts with its tail."""
    start, taken, keep = 0, 0, 4 * overlap
    while taken < len(ends):
        taken = max(taken + 1, bisect_left(ends, start + 4 * (target + 1), lo=taken))
        end = ends[taken - 1]
        yield start, end
        # without overlap the whole buffer stays, as a slice of the last 0 characters is everything
        if keep and end - start > keep:
            start = end - keep


def packed(text: str, first: int, end: int, target: int, overlap: int, least: int) -> list[Chunk]:
    """Chunks of text[first:end], with offsets in the whole text; too short ones are left out and take no number."""
    body, out = text[first:end], []
    if not body:
        return out
    spans = list(stretches(segment_ends(body), target, overlap))
    for k, (a, b) in enumerate(spans):
        last = k == len(spans) - 1
        piece = body[a:b].rstrip("\n").strip() if last else body[a:b].strip()
        if piece and tokens(len(piece)) >= least:
            out.append({"chunk_no": len(out), "text": piece, "offset_start": first + a, "offset_end": end if last else first + b})
    return out


def chunk_plain(text: str, target: int = TARGET, overlap: int = OVERLAP, least: int = 5) -> list[Chunk]:
    """Every chunk is a section of its own, without a title."""
    return [c | {"section": "", "section_no": c["chunk_no"]} for c in packed(text, 0, len(text), target, overlap, least)]


def section_chunks(text: str, start: int, end: int, target: int, least: int) -> list[Chunk]:
    """A section that fits is one chunk; a longer one is packed."""
    body = text[start:end].strip()
    if not body or tokens(len(body)) < least:
        return []
    if tokens(len(body)) <= target:
        return [{"chunk_no": 0, "text": body, "offset_start": start, "offset_end": end}]
    return packed(text, start, end, target, OVERLAP, least)


def chunk_sections(text: str, sections: list[tuple[int, int, str]], target: int, least: int, count_empty: bool) -> list[Chunk]:
    """Chunks of (start, end, title) sections. count_empty: sections without chunks take a number too."""
    out, number = [], 0
    for start, end, title in sections:
        made = section_chunks(text, start, end, target, least)
        out += [c | {"chunk_no": len(out) + i, "section": title, "section_no": number} for i, c in enumerate(made)]
        number += bool(made) or count_empty
    return out


def chunk_markdown(text: str, target: int = TARGET, least: int = 2) -> list[Chunk]:
    """Sections by heading, titled by the path of headings above them; text before the first heading is one without title."""
    found = list(HEADING.finditer(text))
    if not found:
        return chunk_plain(text, target, OVERLAP, least)
    sections = [(0, found[0].start(), "")] if text[: found[0].start()].strip() else []
    path: dict[int, str] = {}
    for m, end in zip(found, [*(m.start() for m in found[1:]), len(text)], strict=True):
        depth = len(m[1])
        path = {d: t for d, t in path.items() if d < depth} | {depth: m[2].strip()}
        sections.append((m.start(), end, " > ".join(path.values())))
    return chunk_sections(text, sections, target, least, count_empty=True)


def chunk_source(text: str, target: int = TARGET, least: int = 5) -> list[Chunk]:
    """Sections by block, titled by their first line."""
    starts = [m.start() for m in BLOCK.finditer(text)]
    if not starts:
        return chunk_plain(text, target, OVERLAP, least)
    edges = sorted({0, *starts, len(text)})
    titled = [(a, b, text[a:b].lstrip().split("\n", 1)[0].strip()[:TITLE]) for a, b in zip(edges, edges[1:], strict=False)]
    return chunk_sections(text, titled, target, least, count_empty=False)


def chunks_of(kind: str, text: str | None, target: int = TARGET, overlap: int = OVERLAP, least: int | None = None) -> list[Chunk]:
    if not text:
        return []
    least = LEAST.get(kind, LEAST["plain"]) if least is None else least
    if kind == "markdown":
        return chunk_markdown(text, target, least)
    return chunk_source(text, target, least) if kind == "source" else chunk_plain(text, target, overlap, least)


def checked(target: int, overlap: int, least: int) -> None:
    if not (50 <= target <= 4000 and 0 <= overlap <= 400 and overlap < target and 1 <= least <= 200):
        raise ValueError("target 50..4000, overlap 0..400 and under target, min 1..200")


def chunk_texts(df: DataFrame, kind=None, target: int = TARGET, overlap: int = OVERLAP, least: int | None = None) -> DataFrame:
    """df (text and any columns) with `chunks`. kind: a column expression (markdown, source, plain); None: plain.

    The most rows that a worker holds are those of one Arrow batch, taken in slices; a chunk list is as long as its text."""
    if least is not None:
        checked(target, overlap, least)
    rows = df.withColumn("_kind", F.lit("plain") if kind is None else kind)
    schema = rows.drop("_kind").withColumn("chunks", F.lit(None).cast(CHUNK)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [chunks_of(k, t, target, overlap, least) for k, t in zip(part.column("_kind").to_pylist(), part.column("text").to_pylist(), strict=True)]
                own = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "_kind"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(made, fields.field("chunks").type)], schema=fields)

    return rows.mapInArrow(work, schema)


def chunk_plain_texts(df: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = 5) -> DataFrame:
    return chunk_texts(df, None, target, overlap, least)


def chunk_markdown_texts(df: DataFrame, target: int = TARGET, least: int = 2) -> DataFrame:
    return chunk_texts(df, F.lit("markdown"), target, OVERLAP, least)


def chunk_source_texts(df: DataFrame, target: int = TARGET, least: int = 5) -> DataFrame:
    return chunk_texts(df, F.lit("source"), target, OVERLAP, least)


def chunk_routed(files: DataFrame) -> DataFrame:
    """C4: files (route, text) with chunks by their route; those without text, and too large ones, have none."""
    kind = F.when(F.col("route").isin("markdown", "docling", "legacy"), "markdown").when(F.col("route") == "source", "source").otherwise("plain")
    return chunk_texts(files.withColumn("text", F.when(F.col("route") != "too_large", F.col("text"))), kind)


def chunk_files(files: DataFrame) -> DataFrame:
    """C4: files (path, size, text) with route, stored_mime and chunks. The text of a format that needs a converter has to be what
    that made of it."""
    return chunk_routed(route_files(files))


def build_chunks(files: DataFrame, paths: DataFrame, parser_version: str, model_version: str, now_ms: int) -> DataFrame:
    """The chunk table. files: file_id, stored_mime, mtime_ms and chunks, or route and text to make them of; one row per file.
    paths: root_id, path, file_id.

    root_ids are gathered per file from the (narrow) paths before they meet the chunks."""
    from .reports import root_ids

    made = files if "chunks" in files.columns else chunk_routed(files)
    rows = made.select("file_id", "stored_mime", "mtime_ms", F.explode("chunks").alias("c"))
    rows = rows.join(root_ids(paths), "file_id", "left")
    return rows.select(
        ids.point_id(F.col("file_id"), F.col("c.chunk_no")).alias("point_id"), "file_id", F.coalesce("root_ids", F.array().cast("array<string>")).alias("root_ids"), F.lit("body").alias("kind"),
        F.col("stored_mime").alias("mime"), F.col("c.chunk_no").alias("chunk_no"), ids.parent_id(F.col("file_id"), F.col("c.section_no")).alias("parent_id"),
        F.col("c.section").alias("section"), F.col("c.section_no").alias("section_no"), F.col("c.text").alias("text"), F.col("c.offset_start").alias("offset_start"),
        F.col("c.offset_end").alias("offset_end"), F.lit("auto").alias("lang"), F.lit(parser_version).alias("parser_version"), F.lit(model_version).alias("embed_model_version"),
        F.lit(now_ms).cast("long").alias("indexed_at"), "mtime_ms", F.lit(None).cast("long").alias("tombstoned_at"),
    )


def preview_chunks(df: DataFrame) -> DataFrame:
    """V5: chunk rows with token_count, and the first eight dimensions of `dense` and the top terms of `sparse` if present."""
    from ..functions.scalars import top_sparse_terms

    out = df.withColumn("token_count", rough_tokens(F.col("text")))
    if "dense" in df.columns:
        out = out.withColumn("dense_head", F.transform(F.slice("dense", 1, 8), lambda x: F.round(x.cast("double"), 4)))
    if "sparse" in df.columns:
        out = out.withColumn("top_terms", top_sparse_terms(F.col("sparse.indices"), F.col("sparse.values")))
    return out
