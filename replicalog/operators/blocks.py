"""Blocks of files: manifests, what is missing, verification, extraction.

``blocks`` frames have folder, name, idx, size, hash (hex).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content

KEY = ["folder", "name", "idx"]
#: The outcome of a request for a block.
OK, UNAVAILABLE = 0, 2


def explode_blocks(contents: DataFrame, column: str, block: int) -> DataFrame:
    """A row per block of every content."""
    cut = F.posexplode(content.pieces(column, block)).alias("idx", "piece")
    return contents.select("folder", "name", cut).select("folder", "name", "idx", F.length("piece").alias("size"), F.sha2("piece", 256).alias("hash"))


def manifest(blocks: DataFrame) -> DataFrame:
    """The ordered hashes of every file."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    d = blocks.groupBy("folder", "name").agg(rows.alias("rows"), F.sum("size").alias("size"))
    return d.select("folder", "name", "size", F.size("rows").alias("n_blocks"), F.transform("rows", lambda r: r["hash"]).alias("blocks"))


def missing_blocks(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.join(have.select(*KEY, "hash"), [*KEY, "hash"], "left_anti")


def verify_blocks(received: DataFrame, expected: DataFrame) -> DataFrame:
    """``received``: key and data. Adds ok: false for a wrong hash and for an index that is not expected."""
    e = expected.select(*KEY, F.col("hash").alias("expected"))
    return received.join(e, KEY, "left").withColumn("ok", F.coalesce(F.sha2("data", 256) == F.col("expected"), F.lit(False)))


def complete_files(expected: DataFrame, verified: DataFrame) -> DataFrame:
    """Files of which every block has arrived and is right."""
    got = verified.where("ok").select(*KEY).distinct().withColumn("got", F.lit(1))
    d = expected.join(got, KEY, "left").groupBy("folder", "name").agg(F.count("*").alias("n_blocks"), F.count("got").alias("n_ok"))
    return d.where("n_blocks = n_ok").select("folder", "name", "n_blocks")


def read_blocks(contents: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: folder, name, offset, size. A short read or a missing file is unavailable."""
    d = requests.join(contents.select("folder", "name", "content"), ["folder", "name"], "left")
    bad = F.col("content").isNull() | (F.col("offset") + F.col("size") > F.length("content"))
    # Within a content places fit into an int.
    data = F.expr("substring(content, CAST(least(offset, length(content)) AS INT) + 1, CAST(least(size, length(content)) AS INT))")
    return d.select("folder", "name", "offset", "size", F.when(~bad, data).alias("data"), F.when(bad, UNAVAILABLE).otherwise(OK).alias("code"))
