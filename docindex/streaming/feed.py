"""The event feed as a stream source (T1, S4): offsets are the keyset cursor (detected_at, seq), and what is read is read in pages.

publish() lays a table of events out as a feed: files of at most `limit` events, one page each, in the order of the cursor, and an
index with a row for each page. EventFeed follows such a folder: a micro-batch takes all pages between two cursors, PAGES of them
to a task, and each is read and filtered by itself, so a page that begins inside a millisecond, or behind the cursor, loses and repeats
nothing. The source keeps nothing between polls; the stream's checkpoint has the cursor.

The source's own processes read the folder through pyarrow, so its path is one that pyarrow knows (a local or shared folder, hdfs,
s3); events that only Spark can read are published first."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Events of a page, and pages of a task, at most.
LIMIT, PAGES = 200, 64
NAME = "event_feed"
SCHEMA = "root_id string, path string, op string, is_dir int, detected_at long, seq long"
#: Orders before every event.
START = {"detected_at": -(2**63), "seq": -(2**63)}


def publish(events: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Adds events (SCHEMA) to the feed in folder: sorted by the cursor, a file a page. The index is written after the pages; what has
    no row there isn't part of the feed. Events that come later have later cursors, as in any keyset feed."""
    spark = events.sparkSession
    from ..sources.layout import names_in

    part = f"{folder.rstrip('/')}/pages/{len(names_in(spark, f'{folder}/pages')):06d}"
    rows = events.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], SCHEMA).schema])
    rows.repartitionByRange("detected_at", "seq").sortWithinPartitions("detected_at", "seq").write.option("maxRecordsPerFile", limit).parquet(part)
    at = F.struct("detected_at", "seq")
    pages = spark.read.schema(SCHEMA).parquet(part).groupBy(F.input_file_name().alias("page")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"))
    pages.select("page", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in ("detected_at", "seq")], "events").coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/index")


def register(spark: SparkSession) -> None:
    """Makes the source known to a session. Its code travels with it, so no process needs the package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(EventFeed)


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The feed in folder as a stream."""
    register(spark)
    return spark.readStream.format(NAME).option("path", folder).load()


class Pages(InputPartition):
    """Pages (their files) between two cursors: behind start, up to end."""

    def __init__(self, files: list[str], start: tuple[int, int], end: tuple[int, int]):
        self.files, self.start, self.end = files, start, end


class EventFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EventFeedReader(self.options["path"])


class EventFeedReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _index(self) -> list[dict]:
        """The pages in the order of their cursors."""
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector, FileType

        fs, folder = located(f"{self.folder}/index")
        found = [f.path for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.type == FileType.File and f.path.endswith(".parquet")]
        rows = ds.dataset(found, filesystem=fs, format="parquet").to_table().to_pylist() if found else []
        return sorted(rows, key=lambda r: (r["first_detected_at"], r["first_seq"]))

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        last = max(((r["last_detected_at"], r["last_seq"]) for r in self._index()), default=None)
        return {"detected_at": last[0], "seq": last[1]} if last else START

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        low, high = ((o["detected_at"], o["seq"]) for o in (start, end))
        own = [r["page"] for r in self._index() if (r["last_detected_at"], r["last_seq"]) > low and (r["first_detected_at"], r["first_seq"]) <= high]
        return [Pages(own[i : i + PAGES], low, high) for i in range(0, len(own), PAGES)] if low < high else []

    def read(self, partition: Pages) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for file in partition.files:
            fs, path = located(file)
            page = pq.read_table(path, filesystem=fs, partitioning=None)
            at, seq = page.column("detected_at"), page.column("seq")

            def behind(cursor, at=at, seq=seq):
                return pc.or_(pc.greater(at, cursor[0]), pc.and_(pc.equal(at, cursor[0]), pc.greater(seq, cursor[1])))

            yield from page.filter(pc.and_(behind(partition.start), pc.invert(behind(partition.end)))).to_batches()


def located(path: str) -> tuple:
    """(file system, path in it) by the path's scheme."""
    from urllib.parse import unquote

    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:"):
        return LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).lstrip("/")
    return FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
