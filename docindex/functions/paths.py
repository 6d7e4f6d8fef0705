"""Path functions as Column expressions (P1, P3, P4 and the globs of P5)."""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are indexed by default, directories that never are, and absolute prefixes that never are.
DEFAULT_EXTENSIONS = (
    ".md", ".txt", ".rst", ".pdf", ".docx", ".doc", ".wps", ".pptx", ".ppt", ".xlsx", ".xls", ".odt", ".html", ".htm", ".xml",
    ".py", ".go", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".rb", ".rs", ".php",
    ".sh", ".bash", ".zsh", ".fish", ".json", ".yaml", ".yml", ".toml", ".ini", ".env", ".csv", ".tsv", ".sql", ".log",
)
CONTAINER_DIRS = (
    "@eaDir", "#recycle", "@__thumb", ".AppleDouble", ".fseventsd", ".Spotlight-V100", ".Trashes", ".DocumentRevisions-V100",
    "__MACOSX", "Network Trash Folder", "Temporary Items", "lost+found", ".snapshots", "immich", ".system_data",
)
CONTAINER_PREFIXES = (".Trash-",)
GATED_PREFIXES = ("/DATA/Notes/",)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)\z", 1)


def dirname(path: Column) -> Column:
    """What is left of the last slash; `/` where nothing is."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1), F.lit("")), F.lit("/"))


def path_ext(path: Column) -> Column:
    """Lower-cased last suffix of the basename, its leading dots ignored: `.env` has none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1))


def path_segments(path: Column) -> Column:
    """Segments after `.`, empty ones and `..` are resolved; `..` stays where a relative path climbs out."""
    absolute = F.startswith(path, F.lit("/"))
    named = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        up = F.size(done) > 0
        climbs = (s == "..") & ~absolute & (~up | (F.element_at(F.concat(F.array(F.lit("")), done), -1) == ".."))
        return F.when((s != "..") | climbs, F.concat(done, F.array(s))).when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(empty)

    return F.aggregate(named, empty, step)


def normalize_path(path: Column) -> Column:
    """POSIX normalisation: exactly two leading slashes stay two, an empty result is `.`."""
    lead = F.when(path.rlike(r"\A//(?!/)"), "//").when(F.startswith(path, F.lit("/")), "/").otherwise("")
    return F.coalesce(F.nullif(F.concat(lead, F.array_join(path_segments(path), "/")), F.lit("")), F.lit("."))


def is_gated(path: Column) -> Column:
    """True where a directory above the file is a container directory or the path lies below a gated prefix."""
    segments = path_segments(path)
    above = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    container = F.exists(above, lambda s: s.isin(*CONTAINER_DIRS) | F.startswith(s, F.lit(CONTAINER_PREFIXES[0])))
    normal = normalize_path(path)
    prefixed = F.lit(False)
    for p in GATED_PREFIXES:
        prefixed = prefixed | F.startswith(normal, F.lit(p))
    return container | prefixed


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored Java pattern: case counts, `*` and `?` match slashes too."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = glob[i + 1 : end]
            negate, inside = inside[0] == "!", inside.removeprefix("!")
            out.append("[" + "^" * negate + "".join("\\" + x if x in "\\[]^&" else x for x in inside) + "]")
            i = end
        else:
            out.append("\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


#: A path's pieces, each up to a sign: what prefixes of paths and globs are cut at.
PIECE = r"[A-Za-z0-9]*[^A-Za-z0-9]"


def glob_key(glob: str) -> str:
    """A literal that every path the glob matches has, as one of its path_keys(): the whole name (n:), the longest literal prefix (p:), a
    folder (f:) or the extension (e:); empty if the glob has none of these. Names come first, as many rules share a folder."""
    start = re.split(r"[*?\[]", glob, maxsplit=1)[0]
    if name := re.search(r"/([^/*?\[\]]+)$", glob) or (start == glob and re.search(r"([^/]+)$", glob)):
        return "n:" + name[1]
    prefix = "".join(re.findall(PIECE, start))
    if len(prefix) > 1:
        return "p:" + prefix
    if "[" not in glob and (folders := re.findall(r"(?<=/)[^/*?]+(?=/)", glob)):
        return "f:" + max(folders, key=len)
    if ext := re.search(r"\.([^./*?\[\]]+)$", glob):
        return "e:" + ext[1]
    return ""


def path_keys(path: Column) -> Column:
    """All keys that a glob which matches the path may have, but the empty one; as many as the path has signs and folders."""
    pieces, parts = F.regexp_extract_all(path, F.lit(PIECE), 0), F.split(path, "/")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
    prefixes = F.transform(upto(F.size(pieces)), lambda i: F.concat(F.lit("p:"), F.array_join(F.slice(pieces, F.lit(1), i), "")))
    folders = F.transform(F.filter(parts, lambda _, i: (i > 0) & (i < F.size(parts) - 1)), lambda x: F.concat(F.lit("f:"), x))
    name = F.array(F.concat(F.lit("n:"), F.element_at(parts, -1)), F.concat(F.lit("e:"), F.regexp_extract(path, r"\.([^./]*)\z", 1)))
    return F.array_distinct(F.concat(prefixes, folders, name))


def mime_types(spark: SparkSession) -> DataFrame:
    """(ext, mime) of the standard library's table."""
    return spark.createDataFrame(sorted(mimetypes.types_map.items()), "ext string, mime string")


def guess_mime(files: DataFrame) -> DataFrame:
    """files with `mime` by their path's extension; the table of types has a few hundred rows."""
    types = F.broadcast(mime_types(files.sparkSession).withColumnRenamed("ext", "_ext"))
    return files.withColumn("_e", path_ext(F.col("path"))).join(types, F.col("_e") == F.col("_ext"), "left").withColumn("mime", F.coalesce("mime", F.lit("application/octet-stream"))).drop("_e", "_ext")
