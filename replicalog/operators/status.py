"""Roll-ups: folders, nodes, peers, runs, transfers, and what needs attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.content import content_hash, preview
from ..functions.paths import conflict_original, conflict_stem, is_conflict_copy
from . import catalog as cat
from . import guards, reconcile
from .events import count_open, is_attention

ONLINE_S = 120
#: Labels by code.
SEVERITIES, RESOLUTIONS = ["info", "warn", "error"], ["open", "acknowledged", "resolved", "auto-resolved"]


def labelled(codes: Column, labels: list[str]) -> Column:
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in labels]), codes + 1), codes.cast("string"))


def category_label(category: Column) -> Column:
    return F.when(category == "applied", "synced").otherwise(category)


def peers_all(folders: DataFrame, peers: DataFrame) -> DataFrame:
    """Whether a folder goes to every configured peer: it has no list, or the list holds them all."""
    known = peers.agg(F.coalesce(F.collect_set("peer"), F.array()).alias("known"))
    d = folders.crossJoin(F.broadcast(known))  # one row
    return d.select("id", ((F.size("peers") <= 0) | (F.size(F.array_except("known", "peers")) == 0)).alias("all_peers"))


def sharing_status(folders: DataFrame, peers: DataFrame, advertised: DataFrame) -> DataFrame:
    """Per folder: peers seen that it may go to, how many of them share it, and whether it is an orphan."""
    theirs = advertised.select("peer", F.col("folder").alias("f")).distinct()
    seen = peers.select("peer").distinct().join(theirs.select("peer").distinct(), "peer", "left_semi")
    theirs = theirs.join(seen, "peer", "left_semi")
    # Folders with a list of peers by that list; for the others all peers count, which one row of totals says.
    open_ = folders.where((F.size("peers") <= 0) | F.col("peers").isNull()).select("id")
    listed = folders.where(F.size("peers") > 0).select("id", F.explode(F.array_distinct("peers")).alias("peer")).join(seen, "peer")
    listed = listed.join(theirs.withColumn("shares", F.lit(1)), (listed["id"] == theirs["f"]) & (listed["peer"] == theirs["peer"]), "left").groupBy("id").agg(F.count("*").alias("known"), F.count("shares").alias("shared"))
    all_ = open_.join(theirs.groupBy("f").agg(F.count("*").alias("shared")), F.col("id") == F.col("f"), "left").crossJoin(seen.agg(F.count("*").alias("known")))
    d = folders.select("id").join(listed.unionByName(all_.select("id", "known", F.coalesce("shared", F.lit(0)).alias("shared"))), "id", "left").na.fill(0, ["known", "shared"])
    return d.withColumn("not_shared", (F.col("known") > 0) & (F.col("shared") == 0))


def folder_status(
    catalog: DataFrame, local: str, folders: DataFrame, peers: DataFrame, events: DataFrame, archive_stats: DataFrame, advertised: DataFrame | None = None, transfers: DataFrame | None = None
) -> DataFrame:
    """One row per folder; every part is an aggregate by folder. Winners are chosen once, for pulls, deletions and the
    guard. ``folders`` has a column peers where ``advertised`` is given."""
    stats = cat.catalog_stats(catalog.where(F.col("replica") == local)).drop("replica")
    d = reconcile.reasons(reconcile.global_winner(catalog, local))
    deleted, pulled = F.col("reason") == "delete", F.col("reason") != "delete"
    names = d.groupBy("folder").agg(
        F.count_if(pulled).alias("pending"), F.sum(F.when(pulled, F.col("winner.size"))).alias("pending_bytes"), F.count_if(deleted).alias("pending_deletions"), F.count_if(~F.col("mine.deleted")).alias("live")
    )
    ups = reconcile.pending_uploads(catalog, local, peers).groupBy("folder").agg(F.count("*").alias("uploads"))
    d = folders.select(F.col("id").alias("folder"), "max_delete_pct", "max_delete_files")
    for part in (stats, names, ups, count_open(events), archive_stats):
        d = d.join(part, "folder", "left")
    guard = guards.tripped(F.coalesce("live", F.lit(0)), F.coalesce("pending_deletions", F.lit(0)), F.col("max_delete_pct"), F.col("max_delete_files"))
    d = d.withColumn("guard", guard).drop("live", "max_delete_pct", "max_delete_files").na.fill(0)
    if advertised is not None:
        d = d.join(peers_all(folders, peers).withColumnRenamed("id", "folder"), "folder", "left")
        d = d.join(sharing_status(folders, peers, advertised).select(F.col("id").alias("folder"), F.col("shared").alias("shared_peers"), "not_shared"), "folder", "left")
    if transfers is not None:
        d = d.join(transfer_stats(transfers).withColumnRenamed("last_session", "last_sync"), "folder", "left").na.fill(0, ["bytes_up", "bytes_down", "files_down", "sessions"])
    return d.orderBy("folder")


def node_status(status: DataFrame) -> DataFrame:
    """One row over all folders; bytes and the last sync where the folders' rows have them."""
    total = [c for c in ("live_files", "conflicts", "conflict_bytes", "versions", "bytes", "pending", "open_conditions", "bytes_up", "bytes_down") if c in status.columns]
    last = [F.max("last_sync").alias("last_sync")] if "last_sync" in status.columns else []
    return status.agg(F.count("*").alias("folders"), *[F.sum(c).alias(c) for c in total], *last)


def peer_status(attempts: DataFrame, peers: DataFrame, now_s: int, advertised: DataFrame | None = None) -> DataFrame:
    """``attempts``: peer, ts, ok, folders_synced. With ``advertised`` also whether the peer was ever seen, and its folders;
    with a column fingerprint of ``peers``, whether it is pinned."""
    last = attempts.groupBy("peer").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_online"), F.max(F.when(F.col("ok") & (F.col("folders_synced") > 0), F.col("ts"))).alias("last_sync"))
    pinned = [(F.btrim(F.coalesce("fingerprint", F.lit(""))) != "").alias("pinned")] if "fingerprint" in peers.columns else []
    d = peers.select("peer", *pinned).join(last, "peer", "left")
    d = d.withColumn("connected", F.coalesce(F.col("last_online") > now_s - ONLINE_S, F.lit(False)))
    if advertised is None:
        return d
    seen = advertised.groupBy("peer").agg(F.array_join(F.array_sort(F.collect_set("folder")), ",").alias("known_folders"))
    return d.join(seen, "peer", "left").withColumn("known", F.col("known_folders").isNotNull()).withColumn("known_folders", F.coalesce("known_folders", F.lit("")))


def resolve_peers(refs: DataFrame, peers: DataFrame, self_id: str, self_name: str) -> DataFrame:
    """``refs``: ref, an id or a name in any case. Adds peer (null if unknown) and is_self. ``peers``: peer, name. Of peers
    with one name the least id counts; a number is an id, never a name."""
    number = F.col("ref").rlike("^0*[1-9][0-9]*$")
    bare = F.regexp_replace("ref", "^0+(?=[1-9])", "")
    by_id = peers.select(F.col("peer").alias("by_id")).distinct()
    by_name = peers.groupBy(F.lower("name").alias("key")).agg(F.min("peer").alias("by_name"))
    d = refs.withColumn("__id", F.when(number, bare)).withColumn("__name", F.when(~number, F.lower("ref")))
    d = d.join(by_id, F.col("__id") == F.col("by_id"), "left").join(by_name, F.col("__name") == F.col("key"), "left")
    is_self = (F.lower("ref") == self_name.lower()) | F.coalesce(F.col("__id") == self_id, F.lit(False))
    return d.select(*refs.columns, F.coalesce("by_id", "by_name").alias("peer"), is_self.alias("is_self"))


def transfer_stats(transfers: DataFrame) -> DataFrame:
    """``transfers``: folder, session, up, down, files, finished."""
    return transfers.groupBy("folder").agg(F.sum("up").alias("bytes_up"), F.sum("down").alias("bytes_down"), F.sum("files").alias("files_down"), F.count_distinct("session").alias("sessions"), F.max("finished").alias("last_session"))


def last_run(runs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The latest run of every key, keys that never ran included; an error shows only if the last run failed."""
    d = runs.groupBy(key).agg(F.max_by(F.struct(*[c for c in runs.columns if c != key]), "started").alias("run"))
    return keys.select(key).join(d, key, "left").select(key, "run.*")


def move_events(moves: DataFrame, now_s: int, peer: str, most: int = 50) -> DataFrame:
    """A row per folder, and one per file where there are few."""
    n = moves.groupBy("folder").agg(F.count("*").alias("n"))
    each = moves.join(n.where(F.col("n") <= most), "folder").select("folder", F.col("to_name").alias("path"), F.lit("moved (local rename, no transfer)").alias("reason"), F.col("from_name").alias("linked"))
    whole = n.select("folder", F.lit("").alias("path"), F.concat(F.lit("moved "), "n", F.lit(" file(s) locally (same-content rename, no transfer)")).alias("reason"), F.lit("").alias("linked"))
    return whole.unionByName(each).withColumns({"category": F.lit("applied"), "severity": F.lit(0), "ts_s": F.lit(now_s), "peer_id": F.lit(peer)})


def attention(catalog: DataFrame, events: DataFrame, local: str, peers: DataFrame, legacy_stem: bool = False) -> DataFrame:
    """One row per name that is to be pulled, that a peer needs, that is a conflict copy, or that has an open warning.

    Warnings of a file with a conflict copy go to the copy's row; the newest one gives category and reason. A live local
    row's size and type stand before the winner's.
    """
    key = ["folder", "name"]
    pulls = reconcile.pending(catalog, local).select(*key, F.lit(True).alias("pending"), F.col("size").alias("pull_size"))
    ups = reconcile.pending_uploads(catalog, local, peers).select(*key, F.lit(True).alias("pending_up"))
    live = catalog.where((F.col("replica") == local) & ~F.col("deleted"))
    mine = live.select(*key, F.col("size").alias("own_size"), "modified_s", cat.type_label().alias("own_type"))
    stem = conflict_stem("name") if legacy_stem else conflict_original("name")
    copies = live.where(is_conflict_copy("name")).select("folder", "name", stem.alias("conflict_of"))
    copy_of = copies.groupBy("folder", F.col("conflict_of").alias("path")).agg(F.max("name").alias("copy"))
    warned = events.where(is_attention() & (F.col("path") != "")).select("folder", "path", "id", "category", "reason").join(copy_of, ["folder", "path"], "left")
    warned = warned.groupBy("folder", F.coalesce("copy", "path").alias("name")).agg(F.max_by(F.struct("category", "reason"), "id").alias("e"))
    flags = pulls.join(ups, key, "full_outer").join(copies, key, "full_outer").join(warned, key, "full_outer").join(mine, key, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return flags.select(
        *key, F.coalesce("own_size", "pull_size", F.lit(0)).alias("size"), F.coalesce("modified_s", F.lit(0)).alias("modified_s"),
        F.coalesce("own_type", F.when(yes(F.col("pending")), "file"), F.lit("")).alias("type"), yes(F.col("pending")).alias("pending"), yes(F.col("pending_up")).alias("pending_up"),
        F.col("conflict_of").isNotNull().alias("conflict"), F.coalesce("conflict_of", F.lit("")).alias("conflict_of"), F.col("e").isNotNull().alias("event"),
        F.coalesce("e.category", F.lit("")).alias("event_cat"), F.coalesce("e.reason", F.lit("")).alias("reason"),
    )


def compare_conflicts(catalog: DataFrame, contents: DataFrame, replica: str, names: DataFrame | None = None, self_id: str = "") -> DataFrame:
    """Every conflict copy beside its live file: sizes, times, hashes, previews, who wrote each last and in how many
    edits, and whether they are the same. ``names``: device, name of the devices."""
    live = catalog.where((F.col("replica") == replica) & ~F.col("deleted")).join(contents.select("folder", "name", F.col("content").cast("binary").alias("content")), ["folder", "name"], "left")
    known = F.expr("CAST(map() AS map<string, string>)")
    if names is not None:
        # One row: the configured devices.
        live = live.crossJoin(names.agg(F.map_from_entries(F.collect_list(F.struct("device", "name"))).alias("__names")))
        known = F.col("__names")
    last, history = vectors.summary("version", known, self_id or replica)
    side = F.struct("size", "modified_s", content_hash("content").alias("sha256"), preview("content").alias("preview"), last.alias("produced_by"), history.alias("history"))
    copies = live.where(is_conflict_copy("name")).select("folder", F.col("name").alias("copy_name"), conflict_original("name").alias("name"), side.alias("copy"))
    files = live.select("folder", "name", side.alias("file"))
    return copies.join(files, ["folder", "name"], "left").withColumn("identical", F.coalesce(F.col("copy.sha256") == F.col("file.sha256"), F.lit(False)))
