"""Guards against mass deletions and mass changes, and names that differ in case only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.paths import is_conflict_copy, parent
from .catalog import live_counts
from .reconcile import need_pulls

#: No guard below so many deletions; shares in per cent.
LEAST_DELETIONS, DELETE_PCT, MASS_PCT = 100, 25, 50


def tripped(live: Column, deletions: Column, pct: Column, files: Column) -> Column:
    share = deletions * 100 >= live * F.when(F.coalesce(pct, F.lit(0)) > 0, pct).otherwise(DELETE_PCT)
    count = (F.coalesce(files, F.lit(0)) > 0) & (deletions >= files)
    return (live > 0) & (deletions >= LEAST_DELETIONS) & (share | count)


def deletion_guard(catalog: DataFrame, folders: DataFrame, local: str) -> DataFrame:
    """Per folder: live, deletions and blocked. ``folders``: id, max_delete_pct, max_delete_files."""
    live = live_counts(catalog).where(F.col("replica") == local).select("folder", "live")
    dels = need_pulls(catalog, local).where("reason = 'delete'").groupBy("folder").agg(F.count("*").alias("deletions"))
    d = live.join(dels, "folder", "left").join(folders.select(F.col("id").alias("folder"), "max_delete_pct", "max_delete_files"), "folder", "left")
    n = F.coalesce("deletions", F.lit(0))
    return d.select("folder", "live", n.alias("deletions"), tripped(F.col("live"), n, F.col("max_delete_pct"), F.col("max_delete_files")).alias("blocked"))


def unblocked_pulls(pulls: DataFrame, guard: DataFrame) -> DataFrame:
    """Pulls without the deletions of blocked folders."""
    blocked = guard.where("blocked").select("folder").withColumn("reason", F.lit("delete"))
    return pulls.join(blocked, ["folder", "reason"], "left_anti")


def mass_change(catalog: DataFrame, markers: DataFrame, local: str, peer: str) -> DataFrame:
    """Per folder that has synced with the peer before: how many of the live entries the peer would change, and alarm."""
    live = live_counts(catalog).where(F.col("replica") == local).select("folder", "live")
    key = ["folder", "name"]
    mine = catalog.where((F.col("replica") == local) & ~F.col("deleted")).select(*key, F.col("version").alias("v"))
    theirs = catalog.where(F.col("replica") == peer).select(*key, F.col("version").alias("w"))
    changed = mine.join(theirs, key).where(vectors.dominates("w", "v")).groupBy("folder").agg(F.count("*").alias("changed"))
    known = markers.where(F.col("peer") == peer).select("folder")
    d = live.join(known, "folder", "left_semi").join(changed, "folder", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    return d.withColumn("alarm", (F.col("live") > 0) & (F.col("changed") > 0) & (F.col("changed") * 100 >= F.col("live") * MASS_PCT))


def case_collisions(catalog: DataFrame, replica: str) -> DataFrame:
    """Live names that are equal but for case. Conflict copies are left out; each set of names is a condition of its own."""
    live = catalog.where((F.col("replica") == replica) & ~F.col("deleted") & ~is_conflict_copy("name"))
    d = live.groupBy("folder", F.lower("name").alias("key")).agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    return d.select("folder", "key", parent("key").alias("dir"), F.array_join("names", " / ").alias("names"))


def clear_conditions(previous: DataFrame, current: DataFrame, on: list[str]) -> DataFrame:
    """Conditions that were there and are no more."""
    return previous.join(current.select(on).distinct(), on, "left_anti")
