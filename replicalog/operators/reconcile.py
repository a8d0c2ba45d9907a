"""Reconciling replicas: winners, pulls, deletions, uploads, moves, overwrites.

All decisions come from one shuffle by (folder, name), which gathers the few versions of a name, one per replica. The
local replica is a parameter, not another table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content, vectors
from ..functions.paths import conflict_name

#: What of an entry takes part in decisions; its blocks do as one key.
FIELDS = ["replica", "size", "modified_s", "type", "deleted", "version"]


def mtime_nanos(c: str = "") -> Column:
    p = f"{c}." if c else ""
    return F.col(f"{p}modified_s") * 1_000_000_000 + F.col(f"{p}modified_ns")


def global_winner(catalog: DataFrame, local: str) -> DataFrame:
    """folder, name, winner (struct of FIELDS and content), is_local, mine (the local struct or null).

    Versions that another one strictly dominates go; of the concurrent rest the newest wins, then the largest canonical
    vector, then the local one.
    """
    one = F.struct(
        mtime_nanos().alias("mtime"), vectors.canonical("version").alias("canon"), (F.col("replica") == local).alias("is_local"), F.col("replica").alias("by"), F.struct(*FIELDS, content.content_key("size", "blocks").alias("content")).alias("entry")
    )
    # Compared as (mtime, canon, is_local, by); the entry holds a map, which has no order, and is looked up after.
    d = catalog.groupBy("folder", "name").agg(F.collect_list(one).alias("all"))
    top = F.filter("all", lambda x: ~F.exists("all", lambda y: vectors.dominates(y["entry"]["version"], x["entry"]["version"])))
    d = d.withColumn("top", top)
    best = F.array_max(F.transform("top", lambda x: F.struct(x["mtime"].alias("mtime"), x["canon"].alias("canon"), x["is_local"].alias("is_local"), x["by"].alias("by"))))
    d = d.withColumn("best", best)
    winner = F.element_at(F.filter("all", lambda x: x["by"] == F.col("best.by")), 1)["entry"]
    mine = F.try_element_at(F.filter("all", lambda x: x["is_local"]), F.lit(1))["entry"]
    return d.select("folder", "name", winner.alias("winner"), F.col("best.is_local").alias("is_local"), mine.alias("mine"))


def reasons(winners: DataFrame) -> DataFrame:
    """Adds reason: why the local replica must pull the winner, or null."""
    absent, gone, dead = F.col("mine").isNull(), F.col("mine.deleted"), F.col("winner.deleted")
    later = vectors.dominates("winner.version", "mine.version")
    clash = vectors.concurrent("winner.version", "mine.version") & ~content.same_key("winner", "mine")
    reason = (
        F.when(absent, F.when(~dead, "absent"))
        .when(~gone & dead, "delete")
        .when(gone & ~dead, "resurrect")
        .when(~gone & ~dead & later, "newer")
        .when(~gone & ~dead & clash, "conflict")
    )
    return winners.withColumn("reason", F.when(~F.col("is_local"), reason))


def need_pulls(catalog: DataFrame, local: str) -> DataFrame:
    """folder, name, reason, winner_replica, size."""
    d = reasons(global_winner(catalog, local)).where("reason IS NOT NULL")
    return d.select("folder", "name", "reason", F.col("winner.replica").alias("winner_replica"), F.col("winner.size").alias("size"))


def pending(catalog: DataFrame, local: str) -> DataFrame:
    """Needed pulls that bring bytes: deletions are left out."""
    return need_pulls(catalog, local).where("reason <> 'delete'")


def pending_totals(catalog: DataFrame, local: str) -> DataFrame:
    return pending(catalog, local).groupBy("folder").agg(F.count("*").alias("pending"), F.sum("size").alias("pending_bytes"))


def pending_deletions(catalog: DataFrame, local: str) -> DataFrame:
    d = global_winner(catalog, local).where("NOT mine.deleted AND winner.deleted")
    return d.select("folder", "name", F.col("winner.replica").alias("winner_replica"), F.col("mine.size").alias("size"))


def pending_uploads(catalog: DataFrame, local: str, peers: DataFrame) -> DataFrame:
    """Live local entries that some peer (column peer) lacks, holds deleted, or holds an older version of."""
    mine = catalog.where((F.col("replica") == local) & ~F.col("deleted")).select("folder", "name", "size", "version")
    known = peers.select(F.col("peer").cast("string").alias("peer")).where(F.col("peer") != local).distinct()
    # One row per name with the peers that are up to date; a name needs an upload if they are fewer than the peers.
    theirs = catalog.where(F.col("replica") != local).join(known, F.col("replica") == F.col("peer"), "left_semi")
    theirs = theirs.where(~F.col("deleted")).select("folder", "name", F.col("version").alias("their_version"))
    both = mine.join(theirs, ["folder", "name"], "left")
    current = F.col("their_version").isNotNull() & ~vectors.dominates("version", "their_version")
    counted = both.groupBy("folder", "name").agg(F.first("size").alias("size"), F.count_if(current).alias("current"))
    total = known.agg(F.count("*").alias("peers"))
    d = counted.join(F.broadcast(total))  # one row
    return d.where("peers > 0 AND current < peers").select("folder", "name", "size", (F.col("peers") - F.col("current")).alias("lacking"))


def diff_for_peer(catalog: DataFrame, local: str, peer: str) -> DataFrame:
    """Local entries, tombstones too, that the peer lacks or holds with another version."""
    key = ["folder", "name", "canon"]
    mine = catalog.where(F.col("replica") == local).withColumn("canon", vectors.canonical("version"))
    theirs = catalog.where(F.col("replica") == peer).withColumn("canon", vectors.canonical("version")).select(key)
    return mine.join(theirs, key, "left_anti").select("folder", "name", "size", "deleted", "canon")


def apply_index_batch(view: DataFrame, batch: DataFrame, update: bool) -> DataFrame:
    """A peer's view after a message: a full one replaces its folders, an update replaces by name."""
    on = ["folder", "replica", "name"] if update else ["folder", "replica"]
    return view.join(batch.select(on).distinct(), on, "left_anti").unionByName(batch)


def plan_moves(catalog: DataFrame, local: str, peer: str) -> DataFrame:
    """folder, from_name, to_name, size: files that the peer renamed. Of each content just one may be gone and just one new."""
    files = catalog.where("type = 0")
    mine = files.where((F.col("replica") == local) & ~F.col("deleted")).withColumn("key", content.content_key("size", "blocks"))
    theirs = catalog.where(F.col("replica") == peer)
    gone = mine.join(theirs.where("deleted").select("folder", "name"), ["folder", "name"], "left_semi")
    new = files.where((F.col("replica") == peer) & ~F.col("deleted")).withColumn("key", content.content_key("size", "blocks"))
    new = new.join(mine.select("folder", "name"), ["folder", "name"], "left_anti")
    one = lambda d, name: d.groupBy("folder", "key").agg(F.count("*").alias("n"), F.min("name").alias(name), F.min("size").alias("size")).where("n = 1").drop("n")
    return one(gone, "from_name").join(one(new, "to_name").drop("size"), ["folder", "key"]).select("folder", "from_name", "to_name", "size")


def validate_moves(moves: DataFrame, catalog: DataFrame, local: str, peer: str) -> DataFrame:
    """Adds problem: null if the move may be applied, else why not. A tombstone at the target counts as present."""
    rows = lambda replica, at: catalog.where(F.col("replica") == replica).select(F.col("folder"), F.col("name").alias(at), "type", "size", "blocks", "deleted")
    entry = lambda d, name, at: d.select("folder", at, F.struct("type", "size", "blocks", "deleted").alias(name))
    d = moves.join(entry(rows(local, "from_name"), "source", "from_name"), ["folder", "from_name"], "left")
    d = d.join(entry(rows(peer, "to_name"), "goal", "to_name"), ["folder", "to_name"], "left")
    d = d.join(entry(rows(local, "to_name"), "there", "to_name"), ["folder", "to_name"], "left")
    problem = (
        F.when(F.col("source").isNull() | F.col("source.deleted"), "source gone")
        .when(F.col("there").isNotNull(), "target exists")
        .when(~F.coalesce(content.same_content("source", "goal"), F.lit(False)), "content differs")
    )
    return d.withColumn("problem", problem).drop("source", "goal", "there")


def tombstones(d: DataFrame, device: str) -> DataFrame:
    """Catalog updates that delete the entries of ``d``."""
    return d.withColumns({
        "size": F.lit(0).cast("long"), "modified_s": F.lit(0).cast("long"), "modified_ns": F.lit(0), "deleted": F.lit(True), "version": vectors.bump("version", device),
        "block_size": F.lit(0), "blocks": F.slice("blocks", 1, 0), "sequence": F.lit(None).cast("long"),
    })


def apply_moves(moves: DataFrame, catalog: DataFrame, local: str, peer: str) -> DataFrame:
    """Catalog updates of valid moves: a tombstone at the source, the peer's entry at the target."""
    valid = validate_moves(moves, catalog, local, peer).where("problem IS NULL").select("folder", "from_name", "to_name")
    mine, theirs = catalog.where(F.col("replica") == local), catalog.where(F.col("replica") == peer)
    source = tombstones(mine.join(valid.select("folder", F.col("from_name").alias("name")), ["folder", "name"], "left_semi"), local)
    target = theirs.join(valid.select("folder", F.col("to_name").alias("name")), ["folder", "name"], "left_semi").withColumns({"replica": F.lit(local), "sequence": F.lit(None).cast("long")})
    return source.unionByName(target)


def overwrite_plan(catalog: DataFrame, local: str, folders: DataFrame) -> DataFrame:
    """For each pull over a live local entry: archive, and conflict_copy. ``folders``: id, conflict, versioned."""
    d = reasons(global_winner(catalog, local)).where("reason IS NOT NULL")
    d = d.join(folders.select(F.col("id").alias("folder"), "conflict", "versioned"), "folder")
    live = F.col("mine").isNotNull() & ~F.col("mine.deleted")
    clash = vectors.concurrent("winner.version", "mine.version") & ~content.same_key("winner", "mine")
    copy = live & clash & (F.col("conflict") == "conflict-copy") & ~F.col("versioned")
    return d.select(
        "folder", "name", F.coalesce(live & F.col("versioned"), F.lit(False)).alias("archive"), F.coalesce(copy, F.lit(False)).alias("conflict_copy"),
        F.when(copy, conflict_name("name", "mine.modified_s", local)).alias("copy_name"), F.col("mine.size").alias("size"),
    )


def conflict_copies(plan: DataFrame, catalog: DataFrame, local: str) -> DataFrame:
    """Catalog updates for the copies of a plan: the local entry under the copy's name, without blocks; the version of a
    copy that is there already is bumped."""
    mine = catalog.where(F.col("replica") == local)
    had = mine.select("folder", F.col("name").alias("copy_name"), F.col("version").alias("had"))
    d = mine.drop("version").join(plan.where("conflict_copy").select("folder", "name", "copy_name"), ["folder", "name"]).join(had, ["folder", "copy_name"], "left")
    d = d.withColumns({"name": F.col("copy_name"), "version": vectors.bump("had", local), "block_size": F.lit(0), "blocks": F.slice("blocks", 1, 0), "sequence": F.lit(None).cast("long")})
    return d.select(catalog.columns)


def adopt(catalog: DataFrame, local: str, names: DataFrame) -> DataFrame:
    """Catalog updates that take the winner's entry as it is, for folder and name in ``names``."""
    d = global_winner(catalog, local).where("NOT is_local").join(names.select("folder", "name"), ["folder", "name"], "left_semi")
    won = d.select("folder", "name", F.col("winner.replica").alias("replica"))
    d = catalog.join(won, ["folder", "name", "replica"]).withColumns({"replica": F.lit(local), "sequence": F.lit(None).cast("long"), "invalid": F.lit(False)})
    return d.select(catalog.columns)


def apply_deletions(catalog: DataFrame, local: str, names: DataFrame) -> DataFrame:
    """Catalog updates for names to delete, and for what lies below a directory among them."""
    mine = catalog.where((F.col("replica") == local) & ~F.col("deleted"))
    goal = names.select("folder", F.col("name").alias("__goal")).distinct()
    # A name goes if it, or a directory above it, is among the goals: an equi-join on every prefix of the path.
    parts = F.split("name", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = mine.select("folder", "name", F.explode(up).alias("__goal")).join(goal, ["folder", "__goal"], "left_semi").select("folder", "name").distinct()
    return tombstones(mine.join(hit, ["folder", "name"], "left_semi"), local).withColumn("type", F.lit(0))


def shared_folders(folders: DataFrame, advertised: DataFrame, peer: str) -> DataFrame:
    """Ids of folders that both sides have and that may go to the peer."""
    theirs = advertised.where(F.col("peer") == peer).select(F.col("folder").alias("id"))
    return advertised_folders(folders, peer).join(theirs, "id", "left_semi")


def advertised_folders(folders: DataFrame, peer: str) -> DataFrame:
    return folders.where(allows_peer("peers", F.lit(peer))).select("id")


def allows_peer(peers: str, peer: Column) -> Column:
    """No list means every peer."""
    return (F.size(peers) <= 0) | F.col(peers).isNull() | F.array_contains(F.col(peers), peer)


def select_delta(catalog: DataFrame, markers: DataFrame, indexes: DataFrame, local: str, peer: str) -> tuple[DataFrame, DataFrame]:
    """What to send, and the markers to set once it has arrived. ``indexes``: folder, index_id of the local catalog.

    Rows carry is_update: only what is later than the marker if its index is still the same, else everything.
    """
    mine = catalog.where(F.col("replica") == local)
    known = markers.where(F.col("peer") == peer).select("folder", F.col("index_id").alias("known"), "max_seq")
    state = indexes.join(known, "folder", "left").select("folder", "index_id", F.coalesce(F.col("known") == F.col("index_id"), F.lit(False)).alias("is_update"), "max_seq")
    rows = mine.join(state, "folder").where(~F.col("is_update") | (F.col("sequence") > F.col("max_seq")))
    top = mine.groupBy("folder").agg(F.max("sequence").alias("max_seq"))
    marker = indexes.join(top, "folder", "left").select("folder", F.lit(peer).alias("peer"), "index_id", F.coalesce("max_seq", F.lit(0)).alias("max_seq"))
    return rows.select("folder", "name", "sequence", "deleted", "is_update"), marker
