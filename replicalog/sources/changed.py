"""Reads of what changed and of nothing else: ranges of files, packed into tasks of even size and opened by path.

The changes are known before a byte is read. Each changed file is cut into ranges of whole blocks; ranges are laid out in
a row and the row is cut into equal parts, one a task, so that a thousand small files are one task's work and a huge file that
of many. Rows move between tasks as paths and offsets; contents are read where they are hashed, one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import content
from ..storage import checkpointed
from .walk import bare_path

#: Bytes of a range, a whole number of blocks of any size, and of a task.
RANGE = 64 << 20
TASK = 256 << 20
#: What opening a file costs, in bytes that could be read meanwhile.
OPEN = 1 << 20
RANGES = "folder string, name string, path string, size long, block int, part int, parts int, offset long, length long"


def ranges(changes: DataFrame, root: str, range_bytes: int = RANGE) -> DataFrame:
    """RANGES of the changed files that have contents. ``changes``: folder, name, kind, now."""
    files = changes.where("kind IN ('added', 'modified') AND now.type = 0 AND now.size > 0").select("folder", "name", F.col("now.size").alias("size"))
    block = content.block_size("size")
    # A range holds one block at least.
    step = F.greatest(F.floor(F.lit(range_bytes) / F.col("block")), F.lit(1)) * F.col("block")
    d = files.withColumn("block", block.cast("int")).withColumn("step", step.cast("long")).withColumn("parts", F.ceil(F.col("size") / F.col("step")).cast("int"))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("offset", F.col("part") * F.col("step"))
    path = F.concat(F.lit(bare_path(root).rstrip("/") + "/"), F.col("name"))
    return d.select("folder", "name", path.alias("path"), "size", "block", F.col("part").cast("int").alias("part"), "parts", "offset", F.least("step", F.col("size") - F.col("offset")).alias("length"))


def packed(rows: DataFrame, task_bytes: int = TASK, open_bytes: int = OPEN) -> DataFrame:
    """The rows in partitions of some ``task_bytes`` each, by length and what opening costs.

    The row of all ranges has no task to itself: each partition adds up its own, the few sums of partitions say where each
    begins, and a range goes to the partition that its place falls into.
    """
    weighed = checkpointed(rows.withColumn("__in", F.spark_partition_id()).withColumn("__bytes", F.col("length") + open_bytes))
    sums = [tuple(r) for r in weighed.groupBy("__in").agg(F.sum("__bytes")).orderBy("__in").collect()]
    if not sums:
        return rows
    total = sum(n for _, n in sums)
    begins, at = {}, 0
    for part, n in sums:
        begins[part], at = at, at + n
    # As many rows as the input has partitions.
    begin = rows.sparkSession.createDataFrame(sorted(begins.items()), "__in int, __begin long")
    inside = W.partitionBy("__in").orderBy("folder", "name", "part").rowsBetween(W.unboundedPreceding, -1)
    tasks = max(1, -(-total // task_bytes))
    place = F.col("__begin") + F.coalesce(F.sum("__bytes").over(inside), F.lit(0)) + F.col("__bytes") / 2
    d = weighed.join(F.broadcast(begin), "__in").withColumn("__to", F.least(F.floor(place * tasks / total), F.lit(tasks - 1)).cast("int"))
    return d.repartitionById(tasks, F.col("__to")).select(rows.columns)


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("/"):
        return open(path, "rb", buffering=0)
    store, at = fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe="/:@"))
    return store.open_input_file(at)


def _block(f, n: int) -> bytes:
    parts = []
    while n > 0 and (b := f.read(n)):
        parts.append(b)
        n -= len(b)
    return b"".join(parts)


def read_hashes(rows: DataFrame) -> DataFrame:
    """Adds hashes, read and error to RANGES, each opened and read where the row is. A file that is gone or has become
    shorter has no hashes, and no error: the next scan sees it as it is then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, read, errors = [], [], []
            for path, block, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "block", "offset", "length")), strict=True):
                got, n, error = [], 0, None
                try:
                    with _opened(path) as f:
                        f.seek(offset)
                        while n < length:
                            data = _block(f, min(block, length - n))
                            n += len(data)
                            if len(data) < block and n < length:
                                break
                            got.append(hashlib.sha256(data).hexdigest())
                except FileNotFoundError:
                    pass
                except OSError as e:
                    error = f"{type(e).__name__}: {e.strerror or e}"
                hashes.append(got if n == length else None)
                read.append(n)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.list_(pa.string())), pa.array(read, pa.int64()), pa.array(errors, pa.string())], [*b.schema.names, "hashes", "read", "error"])

    return rows.select([c.split()[0] for c in RANGES.split(", ")]).mapInArrow(run, f"{RANGES}, hashes array<string>, read long, error string")


def hash_changed(changes: DataFrame, root: str, task_bytes: int = TASK, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """The changes with block_size and blocks, and the errors (folder, name, error) of files that could not be read.

    Added and modified files are read from ``root``, and only these; one that is gone by now, or that could not be read, is no
    change any more. Hashes are checkpointed, as no byte is to be read twice.
    """
    done = checkpointed(read_hashes(packed(ranges(changes, root, range_bytes), task_bytes)))
    whole = done.groupBy("folder", "name").agg(F.array_sort(F.collect_list(F.when(F.col("hashes").isNotNull(), F.struct("part", "hashes")))).alias("x"), F.first("parts").alias("parts"), F.first("block").alias("block_size"))
    whole = whole.where(F.size("x") == F.col("parts")).select("folder", "name", "block_size", F.flatten(F.transform("x", lambda p: p["hashes"])).alias("blocks"))
    has_bytes = "kind IN ('added', 'modified') AND now.type = 0 AND now.size > 0"
    file = F.expr("kind IN ('added', 'modified') AND now.type = 0")
    rest = changes.where(f"NOT ({has_bytes})").withColumns({"block_size": F.when(file, content.block_size("now.size")).otherwise(0).cast("int"), "blocks": F.array().cast("array<string>")})
    return rest.unionByName(changes.where(has_bytes).join(whole, ["folder", "name"])), done.where("error IS NOT NULL").select("folder", "name", "error").distinct()
