"""Listings against catalogs: what a scan found, and what it does to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content, vectors
from ..functions.paths import is_reserved
from ..functions.rules import with_rules
from ..sources.listing import block_ranges, hash_ranges


def scan_diff(listing: DataFrame, catalog: DataFrame, rules: DataFrame | None = None, incomplete: DataFrame | None = None) -> DataFrame:
    """folder, name, kind, rule, reason and the listed entry, for every change.

    ``catalog`` is one replica's. Kinds: added, modified, deleted, skipped; unchanged entries are left out. A file is
    unchanged if size and time are; a directory or link is only ever added. What lies below an ignored directory is as
    good as not there: live entries of it are deleted. ``incomplete`` names folders whose listing failed: there nothing
    is deleted. A listing that a walk has marked by the rules already (ignored, rule) is taken at its word.
    """
    seen = listing.where(~is_reserved("name"))
    if "ignored" in listing.columns:
        pass
    elif rules is not None:
        seen = with_rules(seen, rules).where(~F.col("pruned")).drop("pruned")
    else:
        seen = seen.withColumns({"ignored": F.lit(False), "rule": F.lit(None).cast("string")})
    seen = seen.select("folder", "name", F.struct("type", "size", "modified_s", "modified_ns", "mode", "ignored", "rule").alias("now"))
    had = catalog.select("folder", "name", F.struct("type", "size", "modified_s", "modified_ns", "deleted").alias("had"))
    d = seen.join(had, ["folder", "name"], "full_outer")
    is_file = F.col("now.type") == 0
    same = (F.col("now.size") == F.col("had.size")) & (F.col("now.modified_s") == F.col("had.modified_s")) & (F.col("now.modified_ns") == F.col("had.modified_ns"))
    live = F.col("had").isNotNull() & ~F.col("had.deleted")
    kind = (
        F.when(F.col("now").isNull(), F.when(live, "deleted"))
        .when(F.col("now.ignored"), F.when(is_file, "skipped"))
        .when(F.col("had").isNull(), "added")
        .when(is_file, F.when(~live | ~same, "modified"))
        .when(~live, "added")
    )
    d = d.withColumn("kind", kind).where("kind IS NOT NULL")
    if incomplete is not None:
        bad = incomplete.select("folder").distinct().withColumn("kind", F.lit("deleted"))
        d = d.join(bad, ["folder", "kind"], "left_anti").select(d.columns)
    return d.select("folder", "name", "kind", F.col("now.rule").alias("rule"), "now", F.col("had.type").alias("had_type"))


def hashed(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds block_size and blocks to added and modified files; one that is gone by now is no change any more.

    ``contents``: folder, name, content, and path where the content is null because the file is too large for one
    value: such files are hashed block by block. This is for contents at hand, or in a store that only Spark reads: all of
    ``contents`` is read. ``sources.changed.hash_changed`` opens the changed files alone.
    """
    needs = changes.where("kind IN ('added', 'modified') AND now.type = 0")
    rest = changes.where("NOT (kind IN ('added', 'modified') AND now.type = 0)").withColumns({"block_size": F.lit(0), "blocks": F.array().cast("array<string>")})
    size = content.block_size("now.size")
    # Nothing is read of empty files, which some sources do not even list.
    empty = needs.where("now.size = 0").withColumns({"block_size": size, "blocks": F.array().cast("array<string>")})
    rest, needs = rest.unionByName(empty), needs.where("now.size > 0")
    done = needs.join(contents.where("content IS NOT NULL").select("folder", "name", "content"), ["folder", "name"])
    done = rest.unionByName(done.withColumns({"block_size": size, "blocks": content.block_hashes("content", size)}).drop("content"))
    if "path" not in contents.columns:
        return done
    large = needs.join(contents.where("content IS NULL AND path IS NOT NULL").select("folder", "name", "path"), ["folder", "name"])
    # Dealt out by block, so that one file is hashed by many tasks.
    ranges = block_ranges(large.select("folder", "name", "path", F.col("now.size").alias("size"))).repartition("folder", "name", "idx")
    blocks = hash_ranges(ranges).groupBy("folder", "name").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x"))
    blocks = blocks.where(~F.exists("x", lambda b: b["hash"].isNull())).select("folder", "name", F.transform("x", lambda b: b["hash"]).alias("blocks"))
    return done.unionByName(needs.join(blocks, ["folder", "name"]).withColumn("block_size", size))


def apply_local_changes(catalog: DataFrame, changes: DataFrame, device: str) -> DataFrame:
    """Catalog updates: versions bumped by this device; deletions become tombstones that keep the type."""
    had = catalog.where(F.col("replica") == device).select("folder", "name", F.col("version").alias("had_version"))
    d = changes.where("kind <> 'skipped'").join(had, ["folder", "name"], "left")
    gone = F.col("kind") == "deleted"
    pick = lambda field, kind: F.when(gone, F.lit(0)).otherwise(F.coalesce(F.col(f"now.{field}"), F.lit(0))).cast(kind)
    return d.select(
        "folder", F.lit(device).alias("replica"), "name", pick("size", "long").alias("size"), pick("modified_s", "long").alias("modified_s"), pick("modified_ns", "int").alias("modified_ns"),
        pick("mode", "int").alias("mode"), F.coalesce(F.col("now.type"), F.col("had_type")).cast("int").alias("type"), gone.alias("deleted"), F.lit(False).alias("invalid"),
        vectors.bump("had_version", device).alias("version"), F.lit(None).cast("long").alias("sequence"),
        F.when(gone, 0).otherwise(F.col("block_size")).cast("int").alias("block_size"), F.when(gone, F.array().cast("array<string>")).otherwise(F.col("blocks")).alias("blocks"),
    )


def rebuild_catalog(listing: DataFrame, contents: DataFrame, rules: DataFrame | None, device: str, schema_of: DataFrame) -> DataFrame:
    """A new catalog from a listing alone: the diff against nothing, applied."""
    nothing = schema_of.limit(0)
    return apply_local_changes(nothing, hashed(scan_diff(listing, nothing, rules), contents), device)


def changes_applied(changes: DataFrame) -> DataFrame:
    """Per folder; skipped entries count too."""
    return changes.groupBy("folder").agg(F.count("*").alias("changes"))
