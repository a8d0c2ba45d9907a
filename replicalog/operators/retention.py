"""Archived versions: where they go, which stay, and what they take up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.paths import archive_path, archived_original, utc_day

DAY = 86400
STRATEGIES = ("", "none", "trashcan", "simple", "staggered")


def archive_rows(plan: DataFrame, strategy: str) -> DataFrame:
    """Where the overwritten files of a plan (folder, name, modified_s, modified_ns, size, archive) go."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown versioning type {strategy!r}")
    if strategy in ("", "none"):
        return plan.limit(0).select("folder", F.col("name").alias("path"), F.lit("").alias("archive_path"), "size", "modified_s")
    to = archive_path(F.lit(strategy), "name", "modified_s", "modified_ns")
    return plan.where("archive").select("folder", F.col("name").alias("path"), to.alias("archive_path"), "size", "modified_s")


def prune_keep(archive: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` of every path (simple), path and day (staggered); trashcans hold one. 0 keeps all."""
    day = F.when(F.col("strategy") == "staggered", utc_day(F.col("modified_s"))).otherwise("")
    w = W.partitionBy("folder", "strategy", "path", day).orderBy(F.desc("stamp"))
    most = F.when(F.col("strategy") == "trashcan", 1).otherwise(keep if keep > 0 else 1 << 30)
    return archive.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def latest_per_path(archive: DataFrame) -> DataFrame:
    w = W.partitionBy("folder", "path").orderBy(F.desc("modified_s"), F.desc("stamp"))
    return archive.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prune_age(archive: DataFrame, days: int, now_s: int) -> DataFrame:
    """What is younger than so many days by its own time; 0 keeps all."""
    return archive.where(F.col("modified_s") >= now_s - days * DAY) if days > 0 else archive


def archive_stats(archive: DataFrame) -> DataFrame:
    return archive.groupBy("folder").agg(F.count("*").alias("versions"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def clean_archive(archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emptied archive, and what that freed."""
    return archive.limit(0), archive_stats(archive)


def list_versions(archive: DataFrame) -> DataFrame:
    """Versions under their original paths. ``archive``: folder, strategy, archive_path, size, modified_s."""
    return archive.select("folder", archived_original("strategy", "archive_path").alias("path"), "archive_path", "size", "modified_s").orderBy("folder", "path", "modified_s")
