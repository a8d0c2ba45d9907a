"""Index messages: JSON batches of a peer's catalog rows, full or as updates; and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = """
folder string,
files array<struct<name: string, size: bigint, modified_s: bigint, modified_ns: int, mode: int, type: int, deleted: boolean, invalid: boolean,
                   version: map<string, bigint>, block_size: int, blocks: array<string>, sequence: bigint>>,
update boolean, index_id string, max_seq long"""


def rows_of(messages: DataFrame, replica: str) -> DataFrame:
    """Catalog rows of messages, with is_update. Block hashes come in base64."""
    d = messages.select("folder", F.coalesce("update", F.lit(False)).alias("is_update"), F.explode("files").alias("f"))
    hashes = F.transform(F.coalesce("f.blocks", F.array().cast("array<string>")), lambda b: F.lower(F.hex(F.unbase64(b))))
    zero = lambda c, kind: F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast(kind).alias(c)
    no = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(False)).alias(c)
    version = F.coalesce("f.version", F.expr("CAST(map() AS map<string, bigint>)"))
    return d.select(
        "folder", F.lit(replica).alias("replica"), "f.name", zero("size", "long"), zero("modified_s", "long"), zero("modified_ns", "int"), zero("mode", "int"), zero("type", "int"),
        no("deleted"), no("invalid"), version.alias("version"), zero("sequence", "long"), zero("block_size", "int"), hashes.alias("blocks"), "is_update",
    )


def read_index_messages(spark: SparkSession, path: str, replica: str) -> DataFrame:
    return rows_of(spark.read.schema(MESSAGE).json(path), replica)


def stream_index_messages(spark: SparkSession, path: str, replica: str) -> DataFrame:
    return rows_of(spark.readStream.schema(MESSAGE).json(path), replica)


def export_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, column ``json``."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
