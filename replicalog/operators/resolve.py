"""What an operator decides: settled conflicts, restored versions, deletions let through. Each gives catalog updates, the
event rows they emit, and the actions on conditions they settle; nothing moves bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.paths import conflict_original, is_confined, is_conflict_copy
from . import reconcile
from .events import conflict_actions

#: Categories and texts of emitted events.
APPLIED, SKIPPED, VERSIONED, CONFLICT, FAILED, WARNING, SYSTEM = "applied", "skipped", "versioned", "conflict", "error", "warning", "system"
LOCAL_REASONS = {"added": "local add", "modified": "local modify", "deleted": "local delete"}


def emitted(d: DataFrame, path: Column | str, category: str, severity: int, reason: Column | str, linked: Column | str = "", peer: str = "0", ts_s: int = 0) -> DataFrame:
    """Rows of the event log, without ids: folder, path, category, severity, reason, linked, peer_id, ts_s."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return d.select(
        "folder", (F.col(path) if isinstance(path, str) and path else text(path)).alias("path"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), text(reason).alias("reason"),
        F.coalesce(text(linked), F.lit("")).alias("linked"), F.lit(peer).alias("peer_id"), F.lit(ts_s).cast("long").alias("ts_s"),
    )


def system_events(spark: SparkSession, reason: str, severity: int, ts_s: int, folders: list[str] | None = None) -> DataFrame:
    """A row of the node itself, as when it starts or stops, or one for each of the folders."""
    d = spark.createDataFrame([(f,) for f in folders or [""]], "folder string")
    return emitted(d, "", SYSTEM, severity, reason, ts_s=ts_s)


def change_events(changes: DataFrame, ts_s: int) -> DataFrame:
    """Of a scan's changes; a skipped file names its rule."""
    done = changes.where("kind <> 'skipped'")
    reason = F.coalesce(*[F.when(F.col("kind") == k, F.lit(text)) for k, text in LOCAL_REASONS.items()])
    skipped = changes.where("kind = 'skipped'")
    return emitted(done, "name", APPLIED, 0, reason, ts_s=ts_s).unionByName(emitted(skipped, "name", SKIPPED, 0, "ignored by rule", F.col("rule"), ts_s=ts_s))


def pull_events(pulls: DataFrame, peer: str, ts_s: int) -> DataFrame:
    reason = F.when(F.col("reason") == "delete", "deleted (remote)").otherwise("pulled from peer")
    return emitted(pulls, "name", APPLIED, 0, reason, peer=peer, ts_s=ts_s)


def overwrite_events(plan: DataFrame, folders: DataFrame, peer: str, ts_s: int) -> DataFrame:
    """Of an overwrite plan: files archived, and conflict copies made. ``folders``: id, versioning."""
    kept = plan.where("archive").join(folders.select(F.col("id").alias("folder"), "versioning"), "folder", "left")
    archived = emitted(kept, "name", VERSIONED, 0, "versioning: archived before remote replace", F.col("versioning"), peer, ts_s)
    return archived.unionByName(emitted(plan.where("conflict_copy"), "name", CONFLICT, 1, "concurrent edit: conflict copy created", F.col("copy_name"), peer, ts_s))


def guard_events(guard: DataFrame, ts_s: int) -> DataFrame:
    text = F.format_string("deletion guard: %d of %d files would be deleted", "deletions", "live")
    return emitted(guard.where("blocked"), "", FAILED, 1, text, ts_s=ts_s)


def mass_change_events(mass: DataFrame, peer: str, ts_s: int) -> DataFrame:
    text = F.format_string("mass change: one sync brings changes to %d of %d live files; look whether they are meant before they spread", "changed", "live")
    return emitted(mass.where("alarm"), "", WARNING, 1, text, peer=peer, ts_s=ts_s)


def collision_events(collisions: DataFrame, ts_s: int) -> DataFrame:
    """The condition is the set of names."""
    text = F.concat(F.lit("case collision: "), "names", F.lit(": one name but for upper and lower case, which some clients cannot tell apart"))
    return emitted(collisions, "key", WARNING, 1, text, ts_s=ts_s)


def _settled(copies: DataFrame, by: str, ts_s: int) -> DataFrame:
    """Actions for folder, copy, original."""
    return conflict_actions(copies.select(F.xxhash64("folder", "copy").alias("action_id"), "folder", "copy", "original"), by, ts_s)


def resolve_all_conflicts(catalog: DataFrame, local: str, ts_s: int, by: str = "system") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The current files stay, all live conflict copies go: catalog updates, actions, and how many per folder."""
    live = catalog.where((F.col("replica") == local) & ~F.col("deleted") & is_conflict_copy("name"))
    copies = live.select("folder", F.col("name").alias("copy"), conflict_original("name").alias("original"))
    return reconcile.tombstones(live, local), _settled(copies, by, ts_s), copies.groupBy("folder").agg(F.count("*").alias("resolved"))


def restore_entries(catalog: DataFrame, chosen: DataFrame, local: str, ts_s: int, by: str = "system") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brings contents back as new local changes: catalog updates, event rows, actions.

    ``chosen``: folder, path (where to), source (an archived version's path or a conflict copy's name), from_copy, size,
    modified_s, modified_ns, mode, block_size, blocks of what is restored. Paths that leave the folder are no change. A
    conflict copy that was restored is deleted, and its conflict settled.
    """
    good = chosen.where(is_confined("path"))
    mine = catalog.where(F.col("replica") == local)
    had = mine.select("folder", F.col("name").alias("path"), F.col("version").alias("had"))
    back = good.join(had, ["folder", "path"], "left").select(
        "folder", F.lit(local).alias("replica"), F.col("path").alias("name"), "size", "modified_s", "modified_ns", "mode", F.lit(0).alias("type"), F.lit(False).alias("deleted"), F.lit(False).alias("invalid"),
        vectors.bump("had", local).alias("version"), F.lit(None).cast("long").alias("sequence"), "block_size", "blocks",
    )
    used = good.where("from_copy").select("folder", F.col("source").alias("name"))
    gone = reconcile.tombstones(mine.where(~F.col("deleted")).join(used, ["folder", "name"], "left_semi"), local)
    text = F.concat(F.when(F.col("from_copy"), "restored from conflict copy ").otherwise("restored from archived version "), "source")
    copies = good.where("from_copy").select("folder", F.col("source").alias("copy"), F.col("path").alias("original"))
    return back.select(catalog.columns).unionByName(gone.select(catalog.columns)), emitted(good, "path", APPLIED, 0, text, ts_s=ts_s), _settled(copies, by, ts_s)


def apply_pending_deletions(catalog: DataFrame, local: str, folder: str, ts_s: int, by: str = "system") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lets a folder's held-back deletions through: catalog updates, event rows, and the action that clears the guard."""
    here = catalog.where(F.col("folder") == folder)
    names = reconcile.pending_deletions(here, local)
    clear = names.limit(1).select(
        F.lit(ts_s).cast("long").alias("action_id"), F.lit("resolve").alias("kind"), F.lit(None).cast("long").alias("id"), "folder", F.lit("").alias("path"), F.lit(FAILED).alias("category"), F.lit(by).alias("by"), F.lit(ts_s).cast("long").alias("ts_s")
    )
    return reconcile.apply_deletions(here, local, names), emitted(names, "name", APPLIED, 0, "deleted (remote)", ts_s=ts_s), clear
