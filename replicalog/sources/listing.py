"""Folder listings, contents and archives from any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content
from ..functions.paths import archived_original, is_reserved
from .walk import walk

#: Larger files are hashed in ranges, not as one value.
MOST_BYTES = 1 << 30


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)


def _relative(root: str):
    """The path below the root, whatever scheme the source puts before it."""
    bare = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    return F.expr("substring(path, locate('{0}', path) + {1})".format((bare + "/").replace("'", "\\'"), len(bare) + 1))


def read_listing(spark: SparkSession, root: str, folder: str, reserved: bool = False) -> DataFrame:
    """folder, name, type, size, modified_s, modified_ns, mode of all that ``walk`` finds below a root; a walk that could not
    read everything is an error here, as a listing without its errors would read as deletions."""
    found = walk(spark, root, folder, reserved=reserved)
    first = found.errors.first()
    if first:
        raise OSError(f"the listing of {root} is incomplete: {first['name'] or 'the root'}: {first['error']}")
    return found.entries.drop("ignored", "rule")


def read_content(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """folder, name, content, path of the listed files; one that is gone or empty is left out. All contents below the root
    are read, whatever is listed: to hash what changed, ``changed.hash_changed`` reads no more than that.

    Files beyond MOST_BYTES have a null content and a path, by which ``hash_ranges`` reads them; others have no path.
    """
    wanted = listing.where("type = 0").select("folder", "name")
    small = _files(spark, root).where(F.col("length") <= MOST_BYTES).select(_relative(root).alias("name"), "content", F.lit(None).cast("string").alias("path"))
    large = _files(spark, root).where(F.col("length") > MOST_BYTES).select(_relative(root).alias("name"), F.lit(None).cast("binary").alias("content"), "path")
    return small.unionByName(large).join(wanted, "name").select("folder", "name", "content", "path")


def hash_ranges(ranges: DataFrame) -> DataFrame:
    """``ranges``: folder, name, path, idx, offset, size, of files too large for one value. Adds hash; null if the file is gone.

    Each row is read on its own, through the file system that pyarrow finds for the path as Spark's listing
    gives it; a store that pyarrow does not know is an error.
    """
    import hashlib
    from urllib.parse import quote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            hashes = []
            for path, offset, size in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if path.startswith("file:"):
                    store, at = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
                else:
                    store, at = fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe="/:@"))
                try:
                    with store.open_input_file(at) as f:
                        f.seek(offset)
                        hashes.append(hashlib.sha256(f.read(size)).hexdigest())
                except FileNotFoundError:
                    hashes.append(None)
            yield pa.record_batch([*b.columns, pa.array(hashes, pa.string())], [*b.schema.names, "hash"])

    d = ranges.select("folder", "name", "path", F.col("idx").cast("int").alias("idx"), F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"))
    return d.mapInArrow(run, "folder string, name string, path string, idx int, offset long, size long, hash string")


def block_ranges(files: DataFrame) -> DataFrame:
    """A row per block of files (folder, name, path, size): the requests that ``hash_ranges`` takes."""
    block = content.block_size("size")
    last = F.ceil(F.col("size") / block).cast("int") - 1
    d = files.where("size > 0").withColumn("block", block).withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
    offset, size = content.block_range("size", "block", "idx")
    return d.select("folder", "name", "path", "idx", offset.alias("offset"), size.alias("size"))


def read_archive(spark: SparkSession, root: str, folder: str, strategy: str) -> DataFrame:
    """folder, strategy, archive_path, path, size, modified_s of every archived version."""
    d = _files(spark, root).select(_relative(root).alias("archive_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_s"))
    return d.select(F.lit(folder).alias("folder"), F.lit(strategy).alias("strategy"), "archive_path", archived_original(F.lit(strategy), "archive_path").alias("path"), "size", "modified_s")


def stale_temporaries(listing: DataFrame, now_s: int, most_age_s: int) -> DataFrame:
    """Reserved files, of a listing that has them, which nobody has touched for so long."""
    return listing.where(is_reserved("name") & (F.col("type") == 0) & (F.col("modified_s") < now_s - most_age_s))
