"""Whole runs: scan a folder, plan a sync, apply the plan. Plans are frames one can look at; nothing moves bytes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import diff, guards, reconcile, resolve, retention
from ..operators import events as ev
from ..sources.changed import hash_changed
from ..sources.walk import walk


@dataclass(frozen=True)
class Plan:
    moves: DataFrame
    pulls: DataFrame
    guard: DataFrame
    mass_change: DataFrame
    overwrites: DataFrame


@dataclass(frozen=True)
class Scan:
    """``changes`` with hashes, the ``catalog`` after them, and ``errors`` (folder, name, error): what could not be read."""

    changes: DataFrame
    catalog: DataFrame
    errors: DataFrame


def scan(listing: DataFrame, contents: DataFrame, catalog: DataFrame, rules: DataFrame | None, device: str, incomplete: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The changes, and the catalog after them, from a listing and contents at hand. Nothing is deleted in ``incomplete``
    folders."""
    own = catalog.where(F.col("replica") == device)
    changes = diff.hashed(diff.scan_diff(listing, own, rules, incomplete), contents)
    return changes, cat.put(catalog, diff.apply_local_changes(catalog, changes, device))


def scan_folder(spark: SparkSession, root: str, folder: str, catalog: DataFrame, rules: DataFrame | None, device: str) -> Scan:
    """A whole scan of one folder: a walk that enters no ignored directory, and reads of the changed files alone. What
    could not be walked keeps its catalog entries, and so does a file that could not be read."""
    found = walk(spark, root, folder, rules)
    own = catalog.where((F.col("replica") == device) & (F.col("folder") == folder))
    changes, unread = hash_changed(diff.scan_diff(found.entries, own, incomplete=found.incomplete()), root)
    return Scan(changes, cat.put(catalog, diff.apply_local_changes(catalog, changes, device)), found.errors.unionByName(unread))


@dataclass(frozen=True)
class Rebuild:
    """``catalog``: the folder's rows, numbered from 1; ``events``: that it was rebuilt; ``index_id``: new, so that peers
    exchange all of the folder; ``errors`` of the walk."""

    catalog: DataFrame
    events: DataFrame
    index_id: str
    errors: DataFrame


def rebuild_folder(spark: SparkSession, root: str, folder: str, catalog: DataFrame, rules: DataFrame | None, device: str, ts_s: int) -> Rebuild:
    """A folder's own rows made anew from what lies on disk; ``catalog`` lends its columns only. All is hashed."""
    nothing = catalog.limit(0)
    done = scan_folder(spark, root, folder, nothing, rules, device)
    return Rebuild(done.catalog, resolve.system_events(spark, "catalog rebuilt from the files", ev.WARN, ts_s, [folder]), uuid.uuid4().hex, done.errors)


def plan(catalog: DataFrame, folders: DataFrame, markers: DataFrame, local: str, peer: str) -> Plan:
    """Moves first; then what is still to be pulled, without deletions that the guard holds back."""
    pair = catalog.where(F.col("replica").isin(local, peer))
    moves = reconcile.validate_moves(reconcile.plan_moves(pair, local, peer), pair, local, peer).where("problem IS NULL").drop("problem")
    moved = cat.put(pair, reconcile.apply_moves(moves, pair, local, peer))
    guard = guards.deletion_guard(moved, folders, local)
    pulls = guards.unblocked_pulls(reconcile.need_pulls(moved, local), guard)
    return Plan(moves, pulls, guard, guards.mass_change(pair, markers, local, peer), reconcile.overwrite_plan(moved, local, folders))


def apply_plan(catalog: DataFrame, p: Plan, local: str, peer: str) -> DataFrame:
    """The catalog once the plan has been carried out: moves, deletions, copies of conflicts, then the winners."""
    c = cat.put(catalog, reconcile.apply_moves(p.moves, catalog, local, peer))
    dels = reconcile.apply_deletions(c, local, p.pulls.where("reason = 'delete'"))
    copies = reconcile.conflict_copies(p.overwrites, c, local)
    won = reconcile.adopt(c, local, p.pulls.where("reason <> 'delete'"))
    return cat.put(c, dels.unionByName(copies).unionByName(won))


def daily_retention(events: DataFrame, archive: DataFrame, days: int, archive_days: int, now_s: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a daily job keeps of the event log and of the archive, and how many events it takes away. Open warnings stay."""
    kept = ev.auto_archive(events, days, now_s)
    gone = ev.archive_preview(events, (days if days > 0 else ev.DEFAULT_DAYS) * ev.DAY, False, now_s).select("deleted", "kept_open")
    return kept, retention.prune_age(archive, archive_days, now_s), gone
