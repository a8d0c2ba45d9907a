"""Listings as a streaming source: snapshots that walks have written, each given to a stream once.

A snapshot is Parquet under a number, complete once its manifest is there. The number is the stream's offset, so a stream that is
restarted goes on behind the last snapshot it has taken; snapshots are never written over, so what is read again is the
same. Every file is a partition. A snapshot tells of each folder whether its walk was incomplete.

The store is a local or shared file system, or one that pyarrow knows. As a batch source a filter on folder or snapshot is
taken to the files: others are not opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from .walk import Walk

NAME = "folder_snapshots"
SNAPSHOT = "folder string, name string, type int, size long, modified_s long, modified_ns int, mode int, ignored boolean, rule string, incomplete boolean, snapshot long"


def write_snapshot(spark: SparkSession, walks: list[Walk], root: str, number: int) -> bool:
    """Writes the walks of some folders as one snapshot; one that is there already stays as it is, and False is returned."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    at = path(f"{root}/manifest/{number:012d}.json")
    if fs.exists(at):
        return False
    to, rows, bad = f"{root}/data/{number}-{uuid.uuid4().hex[:8]}", None, None
    for w in walks:
        rows = w.entries if rows is None else rows.unionByName(w.entries)
        bad = w.incomplete() if bad is None else bad.unionByName(w.incomplete())
    bad = bad.distinct().withColumn("incomplete", F.lit(True))
    rows = rows.join(F.broadcast(bad), "folder", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
    rows.withColumn("at_folder", F.col("folder")).repartition("folder", F.pmod(F.xxhash64("name"), F.lit(16))).write.partitionBy("at_folder").parquet(to)
    files = [(r["f"], r["folder"]) for r in spark.read.parquet(to).select(F.input_file_name().alias("f"), "folder").distinct().collect()]
    draft = path(f"{root}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps([{"file": f, "folder": folder} for f, folder in sorted(files)]).encode()))
    out.close()
    return fs.rename(draft, at)


class _File(InputPartition):
    def __init__(self, file: str, snapshot: int):
        self.file, self.snapshot = file, snapshot


class _Store:
    """The manifests, read with no session at hand."""

    def __init__(self, root: str):
        from pyarrow import fs

        if "://" in root or root.startswith("file:"):
            root = root.replace("s3a://", "s3://", 1) if "://" in root else "file://" + root[5:]
            self.fs, self.at = fs.FileSystem.from_uri(root)
        else:
            self.fs, self.at = fs.LocalFileSystem(), root

    def numbers(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.at}/manifest", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))

    def files(self, number: int) -> list[dict]:
        with self.fs.open_input_file(f"{self.at}/manifest/{number:012d}.json") as f:
            return json.loads(f.read())


def _rows(part: _File) -> Iterator:
    from urllib.parse import unquote

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    if part.file.startswith("file:"):
        store, at = fs.LocalFileSystem(), "/" + unquote(part.file[5:]).lstrip("/")
    else:
        store, at = fs.FileSystem.from_uri(part.file.replace("s3a://", "s3://", 1))
    names = [c.split()[0] for c in SNAPSHOT.split(", ")][:-1]
    with store.open_input_file(at) as f:
        for b in pq.ParquetFile(f).iter_batches(columns=names):
            b = b.select(names)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part.snapshot] * b.num_rows, pa.int64())], [*names, "snapshot"])


class _Stream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.store = root

    def initialOffset(self) -> dict:
        return {"snapshot": -1}

    def latestOffset(self) -> dict:
        return {"snapshot": max(_Store(self.store).numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        store = _Store(self.store)
        return [_File(f["file"], n) for n in store.numbers() if start["snapshot"] < n <= end["snapshot"] for f in store.files(n)]

    def read(self, partition: _File) -> Iterator:
        return _rows(partition)


class _Batch(DataSourceReader):
    def __init__(self, root: str):
        self.store, self.only = root, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("folder",), ("snapshot",)):
                self.only.setdefault(f.attribute[0], set()).add(f.value)
            # Spark still checks every row: a filter on a folder chooses files, which hold one folder each.
            yield f

    def partitions(self) -> list[_File]:
        store = _Store(self.store)
        fits = lambda k, v: all(v == x for x in self.only.get(k, ()))
        return [_File(f["file"], n) for n in store.numbers() if fits("snapshot", n) for f in store.files(n) if fits("folder", f["folder"])]

    def read(self, partition: _File) -> Iterator:
        return _rows(partition)


class FolderSnapshots(DataSource):
    """Format ``folder_snapshots``, with the root that ``write_snapshot`` writes to."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SNAPSHOT

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])


def snapshots(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """The snapshots as rows of SNAPSHOT. Sets the session to hand filters to Python sources, which ``FolderSnapshots`` needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSnapshots)
    return (spark.readStream if stream else spark.read).format(NAME).load(root)
