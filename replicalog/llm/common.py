"""Small helpers shared by the operators: inputs, words, checkpoints, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpointed, collect_garbage, released_after, stored

__all__ = ["broadcast_if_small", "checkpointed", "collect_garbage", "hinted", "let_go", "packed", "released_after", "stored", "table", "text_of", "words_of"]

#: White space that separates words, as a Java character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Of frames whose rows (small ones: a few numbers, or a word) have been counted: rows to a partition, and the fewest partitions of what is more than one.
PART_ROWS, LEAST_PARTS = 200_000, 6


def let_go() -> None:
    """At a task's end: what Python and Arrow have freed goes back to the system, as workers live on beside the executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library: nothing to ask for
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null being an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than the six white-space characters, in order."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hints a broadcast where the counted rows stay within ``limit``; beyond it Spark shuffles."""
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df


def hinted(df: DataFrame, rows: int, limit: int, whole: int | None = None) -> DataFrame:
    """Hints a broadcast where the rows, counted before, stay within ``limit``. ``whole``: the rows by which both sides of the join are
    ``packed``; in one partition they are joined by a hash table there, without the driver."""
    if whole is not None and whole <= PART_ROWS:
        return df.hint("shuffle_hash")
    return F.broadcast(df) if rows <= limit else df


def packed(df: DataFrame, rows: int) -> DataFrame:
    """As many partitions as ``rows``, counted before, are worth, if there are more: rounds over a few rows are not to
    cost a task and a file for each shuffle partition. Partitions still grow with the rows. What one partition holds is
    grouped and joined without a shuffle; each shuffle costs the driver a thread, which lives on for a minute."""
    return df.coalesce(1 if rows <= PART_ROWS else max(LEAST_PARTS, -(-rows // PART_ROWS)))
