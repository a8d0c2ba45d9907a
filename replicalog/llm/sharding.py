"""Shards of near equal bytes through fixed virtual slots.

A record's slot is the hash of its id and text modulo SLOTS, a number that never changes. A map names the shard of every
slot. It is stored as edits (version, slot, shard): the first version deals the slots out in turn, and every later one
holds only the slots that moved, so that any version can be read back. Rebalancing looks at the bytes a slot holds, takes
slots from shards beyond their share and gives the largest of these to the emptiest shard, one by one. Growing does the
same, but slots move to the added shards alone. What is planned on the driver has SLOTS rows, whatever the input.

Places inside a shard are gapless from 0: rows are numbered inside their slot, slots are laid one after another. So no
task orders more than a slot's rows, which carry an id, a size and a checksum but no text.

Defined cases: a null text has no bytes and the checksum of none; rows with a null doc_id are told apart by their text;
repeated rows share a slot, and with it a shard, and each has a place of its own; a record, or a slot of repeated ones,
larger than a shard's share has a shard to itself and the others are equal among themselves; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stored

SHARDS = 24
#: Fixed for the life of a data set: some 700 slots a shard, so that moving one shifts little.
SLOTS = 16_384
#: Bytes that every row counts beside its text.
ROW_BYTES = 8
MAP = "version int, slot int, shard int"


def slot_of(slots: int = SLOTS) -> Column:
    """The virtual slot of a row with doc_id and text."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot_of(slots).alias("virtual_slot"))


def loads(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows of every slot that has any."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: the slots in turn."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % shards).cast("int").alias("shard"))


def map_at(edits: DataFrame, version: int | None = None) -> DataFrame:
    """slot, shard as of a version, the latest if none is named."""
    known = edits if version is None else edits.where(F.col("version") <= version)
    return known.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))


def rebalanced(edits: DataFrame, used: DataFrame, shards: int, grow: bool = False) -> DataFrame:
    """The next version's edits: slots that move so that ``shards`` shards hold near equal bytes; with ``grow`` they move
    to shards that the map does not know yet. ``used``: ``loads``."""
    spark = edits.sparkSession
    last = edits.agg(F.max("version")).first()[0]
    now = map_at(edits).join(used, F.col("slot") == F.col("virtual_slot"), "left").select("slot", "shard", F.coalesce("bytes", F.lit(0)))
    held = [tuple(r) for r in now.collect()]
    only = sorted(set(range(shards)) - {shard for _, shard, _ in held}) if grow else None
    moves = moved(held, shards, only)
    return spark.createDataFrame([(last + 1, slot, shard) for slot, shard in sorted(moves.items())], MAP)


def moved(held: list[tuple[int, int, int]], shards: int, only: list[int] | None = None) -> dict[int, int]:
    """New shards of the slots that have to move, to any shard or to those in ``only``. ``held``: slot, shard, bytes of
    every slot, of which there are SLOTS."""
    total, left = sum(b for _, _, b in held), shards
    heavy: dict[int, int] = {}
    # Slots beyond a fair share stand alone: what is left is shared by the other shards.
    for slot, _, b in sorted(held, key=lambda x: (-x[2], x[0])):
        if left == 1 or b * left <= total:
            break
        heavy[slot] = b
        total, left = total - b, left - 1
    share = total / left
    alone: dict[int, int] = {}
    at, loose = [0] * shards, []
    for slot, shard, _ in held:
        if slot in heavy and shard < shards and shard not in alone:
            alone[shard] = slot
    for slot, shard, b in sorted(held, key=lambda x: (-x[2], x[0])):
        if alone.get(shard) == slot or shard < shards and shard not in alone and slot not in heavy and at[shard] + b <= share:
            at[shard] += b
        else:
            loose.append((slot, shard, b))
    free = [(at[s], s) for s in (range(shards) if only is None else only)]
    heapq.heapify(free)
    moves = {}
    for slot, shard, b in loose:
        load, to = heapq.heappop(free)
        if to != shard:
            moves[slot] = to
        heapq.heappush(free, (load + b, to))
    return moves


def save_map(edits: DataFrame, path: str) -> None:
    """Appends edits to the stored map; a version that is written again replaces itself."""
    edits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).selectExpr("int(version) version", "slot", "shard")


def placed(rows: DataFrame, slot_map: DataFrame, used: DataFrame) -> DataFrame:
    """Adds shard and slot, the row's place in its shard, to ``sized`` rows. ``slot_map``: slot, shard of SLOTS rows."""
    known = slot_map.withColumnRenamed("slot", "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = used.join(known, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    d = rows.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(starts), "virtual_slot")
    return d.select(*rows.columns, "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of every row.

    The map of this run is stored with its two versions; law is `bytes`, under which a further shard moves rows as
    their sizes ask for, so that grown_shard is null.
    """
    spark = docs.sparkSession
    rows = stored(sized(docs, slots), "shard-rows")
    used = stored(loads(rows).coalesce(1), "slot-loads")
    first = first_map(spark, shards, slots)
    edits = stored(first.unionByName(rebalanced(first, used, shards)), "slot-map")
    out = placed(rows, map_at(edits), used)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(2).alias("map_version"))
