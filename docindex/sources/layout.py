"""Tables laid out by buckets of a key (S7): snapshots that share the folders of the buckets that didn't change.

A snapshot is a folder with a small layout file, which is written last: its key, its number of buckets, its schema, and where the
rows of each bucket are. A write that fails half-way leaves folders that no layout names, so it is never read. Nothing that a plan
still reads is overwritten; expire() takes away what no kept snapshot names."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

LAYOUT = "layout.json"


@dataclass(frozen=True)
class Layout:
    """key columns, number of buckets, schema of the rows, and the folder of every bucket that has rows."""

    key: list[str]
    buckets: int
    schema: StructType
    folders: dict[int, str]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all; one of that name is replaced."""
    fs, target = _fs(spark, path)
    _, part = _fs(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, p = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def layout(spark: SparkSession, path: str) -> Layout:
    told = json.loads(read_text(spark, f"{path}/{LAYOUT}"))
    return Layout(told["key"], told["buckets"], StructType.fromJson(told["schema"]), {int(b): p for b, p in told["folders"].items()})


def manifest(spark: SparkSession, path: str) -> dict[int, str | None]:
    """Where each bucket of a snapshot is; None for those without rows."""
    found = layout(spark, path)
    return {b: found.folders.get(b) for b in range(found.buckets)}


def bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.hash(*key), F.lit(buckets)).cast("int")


def buckets_of(rows: DataFrame, key: list[str], buckets: int) -> list[int]:
    """The buckets that rows fall into: as many as there are buckets at most."""
    return sorted(r[0] for r in rows.select(bucket(key, buckets)).distinct().collect())


def _written(rows: DataFrame, path: str, key: list[str], buckets: int) -> dict[int, str]:
    """Writes rows by bucket below path. Spark's rebalancing gives a large bucket several writers, and small ones one together."""
    name = next(n for n in ("bucket", *(f"bucket{i}" for i in range(len(rows.columns) + 1))) if n.lower() not in {c.lower() for c in rows.columns})
    rows.withColumn(name, bucket(key, buckets)).hint("rebalance", name).write.partitionBy(name).parquet(f"{path}/data")
    return {int(n.split("=")[1]): f"{path}/data/{n}" for n in names_in(rows.sparkSession, f"{path}/data") if n.startswith(f"{name}=")}


def _commit(spark: SparkSession, path: str, done: Layout) -> str:
    told = {"key": done.key, "buckets": done.buckets, "schema": json.loads(done.schema.json()), "folders": done.folders}
    write_text(spark, f"{path}/{LAYOUT}", json.dumps(told))
    return path


def write_table(df: DataFrame, folder: str, key: str | list[str] | None = None, buckets: int = 8) -> str:
    """A new snapshot of a table below folder, and its path. With a key, rows are laid out by `buckets` buckets of it."""
    path = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    if key is None:
        df.write.parquet(path)
        return path
    key = [key] if isinstance(key, str) else list(key)
    return _commit(df.sparkSession, path, Layout(key, buckets, df.schema, _written(df, path, key, buckets)))


def read_buckets(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The rows of a bucketed snapshot, or of some of its buckets: no file of the others is opened."""
    found = layout(spark, path)
    there = [p for b, p in sorted(found.folders.items()) if only is None or b in set(only)]
    return spark.read.schema(found.schema).parquet(*there) if there else spark.createDataFrame([], found.schema)


def replace_buckets(old_path: str, new: DataFrame, folder: str, gone: DataFrame | None = None, touched: list[int] | None = None) -> str:
    """S7 for upserts: a new snapshot in which the rows of new keys, and of the keys of `gone`, are replaced by `new`. Only
    their buckets are read and written, as many as the old snapshot has; the layout names the folders of the others where they are.
    touched: the buckets of `gone`, told by a caller whose `gone` holds all keys of `new`, which is then evaluated once."""
    spark, old = new.sparkSession, layout(new.sparkSession, old_path)
    if touched is None:
        keys = new.select(*old.key) if gone is None else new.select(*old.key).unionByName(gone.select(*old.key))
        touched, keys = buckets_of(keys, old.key, old.buckets), keys.distinct()
    else:
        keys = gone.select(*old.key)
    rest = read_buckets(spark, old_path, touched).join(keys, old.key, "left_anti").select(old.schema.names)
    path = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    written = _written(rest.unionByName(new.select(old.schema.names)), path, old.key, old.buckets) if touched else {}
    return _commit(spark, path, Layout(old.key, old.buckets, old.schema, {b: p for b, p in old.folders.items() if b not in touched} | written))


def clustered(df: DataFrame, key: str | list[str], buckets: int) -> DataFrame:
    """df as a table of the shared folder that Spark knows to be bucketed and sorted by key: a join or aggregation by the key reads it
    where it is, and only the other side is shuffled (into as many buckets)."""
    key = [key] if isinstance(key, str) else list(key)
    spark, name = df.sparkSession, f"docindex_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *key).write.format("parquet").bucketBy(buckets, *key).sortBy(*key)
    rows.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def open_clustered(spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int) -> DataFrame:
    """What clustered() left at path, in another session."""
    name = f"docindex_{uuid.uuid4().hex}"
    quoted = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    keys = ", ".join(f"`{k}`" for k in key)
    spark.sql(f"CREATE TABLE {name} ({quoted}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def expire(spark: SparkSession, folder: str, kept: list[str]) -> list[str]:
    """Deletes the snapshots below folder that are not kept, and those of their buckets that no kept one names; what went."""
    used = {p.rsplit("/data/", 1)[0] for path in kept for p in layout(spark, path).folders.values()} | set(kept)
    used = {p.rstrip("/").rsplit("/", 1)[1] for p in used}
    gone = [n for n in names_in(spark, folder) if n.startswith("snapshot-") and n not in used]
    for n in gone:
        delete_folder(spark, f"{folder.rstrip('/')}/{n}")
    return gone
