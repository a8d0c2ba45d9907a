"""Catalog tables: reads, upserts, markers and one-pass statistics.

A catalog row is keyed by (folder, replica, name). Nothing is updated in place: an upsert is a union of which the latest
row of a key stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.paths import CONFLICT, is_conflict_copy
from ..storage import checkpointed

KEY = ["folder", "replica", "name"]


def type_label(column: str = "type"):
    return F.element_at(F.array(F.lit("file"), F.lit("dir"), F.lit("symlink")), F.col(column) + 1)


def read_catalog(spark: SparkSession, path: str, include_deleted: bool = False) -> DataFrame:
    d = spark.read.parquet(path)
    return d if include_deleted else d.where(~F.col("deleted"))


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Parquet by folder and replica, sorted by name, so that scans of one folder and of a name read little."""
    catalog.repartition("folder", "replica").sortWithinPartitions("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "replica").parquet(path)


def list_after(catalog: DataFrame, sequence: int) -> DataFrame:
    """Rows later than a sequence number, tombstones too."""
    return catalog.where(F.col("sequence") > sequence)


def get(catalog: DataFrame, folder: str, replica: str, name: str) -> DataFrame:
    return catalog.where((F.col("folder") == folder) & (F.col("replica") == replica) & (F.col("name") == name))


def numbered(updates: DataFrame, last: DataFrame) -> DataFrame:
    """Gives rows without a sequence the next numbers of their (folder, replica), in order of name.

    ``last``: folder, replica, max_sequence. Numbers come from counts of ranges of names and places inside them,
    so that no partition holds a whole folder. The ranges are drawn from a sample, and another run may draw others:
    they are checkpointed with their numbers, so that counts and places speak of the same ranges.
    """
    parts = checkpointed(updates.where("sequence IS NULL").repartitionByRange("folder", "replica", "name").withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy("__part", "folder", "replica").orderBy("name")
    places = parts.withColumn("__place", F.row_number().over(inside))
    sizes = parts.groupBy("__part", "folder", "replica").agg(F.count("*").alias("rows"))
    before = W.partitionBy("folder", "replica").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", "folder", "replica", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__start"))
    d = places.join(starts, ["__part", "folder", "replica"]).join(last.withColumnRenamed("max_sequence", "__last"), ["folder", "replica"], "left")
    given = d.withColumn("sequence", F.coalesce("__last", F.lit(0)) + F.col("__start") + F.col("__place"))
    return updates.where("sequence IS NOT NULL").unionByName(given.select(updates.columns))


def put(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """The catalog with the updates taken in; an update without a sequence gets the next one."""
    last = max_sequence(catalog)
    both = catalog.withColumn("__new", F.lit(0)).unionByName(numbered(updates, last).withColumn("__new", F.lit(1)))
    newest = W.partitionBy(*KEY).orderBy(F.desc("__new"), F.desc("sequence"))
    return both.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank", "__new")


def delete_entries(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Hard delete; ``names`` has some or all of the key columns."""
    on = [c for c in KEY if c in names.columns]
    return catalog.join(names.select(on).distinct(), on, "left_anti")


def set_marker(markers: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` replace rows of the same folder and peer."""
    keys = ["folder", "peer"]
    return markers.join(updates.select(keys), keys, "left_anti").unionByName(updates)


def get_marker(markers: DataFrame, folder: str, peer: str) -> DataFrame:
    return markers.where((F.col("folder") == folder) & (F.col("peer") == peer))


def max_sequence(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("folder", "replica").agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("max_sequence"))


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """Per folder and replica, in one pass. ``entries`` counts tombstones too, ``live_files`` does not."""
    live = ~F.col("deleted")
    copy = live & F.col("name").ilike(f"%{CONFLICT}%")
    return catalog.groupBy("folder", "replica").agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
        F.count_if(F.col("deleted")).alias("tombstones"),
        F.count_if(live).alias("live_files"),
        F.count_if(copy).alias("conflicts"),
        F.coalesce(F.sum(F.when(copy, F.col("size"))), F.lit(0)).alias("conflict_bytes"),
    )


def live_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("folder", "replica").agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("tombstones"))


def files(catalog: DataFrame, replica: str) -> DataFrame:
    """Live entries with a label of their type, in order of name."""
    d = catalog.where((F.col("replica") == replica) & ~F.col("deleted"))
    return d.select("folder", "name", "size", "modified_s", type_label().alias("type")).orderBy("folder", "name")


def conflicts(catalog: DataFrame, replica: str) -> DataFrame:
    return files(catalog, replica).where(is_conflict_copy("name"))
