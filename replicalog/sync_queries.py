"""Queries over catalogs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import content, paths, rules, vectors
from .operators import blocks, catalog, diff, guards, reconcile, resolve, retention, status

LOCAL, PEER = "1", "2"
RULES = ["fr/", "*.html", "!en/25", "*_cache"]

#: Both versions of every name beside each other, and which side wins.
_WINNERS = (
    "WITH "
    + fx.catalog_sql("sha256({})")
    + """,
l AS (SELECT * FROM c WHERE replica = '1'), p AS (SELECT * FROM c WHERE replica = '2'),
w AS (SELECT coalesce(l.folder, p.folder) AS folder, coalesce(l.name, p.name) AS name, l.name IS NOT NULL AS has_l, p.name IS NOT NULL AS has_p,
             l.size AS l_size, p.size AS p_size, l.modified_s AS l_time, p.modified_s AS p_time, l.hash AS l_hash, p.hash AS p_hash, l.deleted AS l_gone, p.deleted AS p_gone,
             coalesce(p.v1 >= l.v1 AND p.v2 >= l.v2 AND (p.v1 > l.v1 OR p.v2 > l.v2), false) AS p_later,
             coalesce(l.v1 >= p.v1 AND l.v2 >= p.v2 AND (l.v1 > p.v1 OR l.v2 > p.v2), false) AS l_later,
             coalesce((p.v1 > l.v1 AND p.v2 < l.v2) OR (p.v1 < l.v1 AND p.v2 > l.v2), false) AS clash
      FROM l FULL JOIN p ON l.folder = p.folder AND l.name = p.name),
x AS (SELECT *, has_p AND (NOT has_l OR p_later OR (clash AND p_time > l_time)) AS p_wins, l_size = p_size AND l_hash = p_hash AS same FROM w),
n AS (SELECT folder, name, p_size AS size, l_size, CASE WHEN NOT has_l THEN CASE WHEN NOT p_gone THEN 'absent' END WHEN NOT l_gone AND p_gone THEN 'delete'
             WHEN l_gone AND NOT p_gone THEN 'resurrect' WHEN NOT l_gone AND NOT p_gone AND p_later THEN 'newer' WHEN NOT l_gone AND NOT p_gone AND clash AND NOT same THEN 'conflict' END AS reason
      FROM x WHERE p_wins)
"""
)
_CATALOG = "WITH " + fx.catalog_sql("sha256({})")

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(_WINNERS + "SELECT folder, name, reason, '2' AS winner_replica, size FROM n WHERE reason IS NOT NULL")
def need_pulls(spark, sf_dir):
    return reconcile.need_pulls(fx.catalog(spark, sf_dir), LOCAL)


@query(_WINNERS + "SELECT folder, name, CASE WHEN p_wins THEN '2' ELSE '1' END AS winner_replica, CASE WHEN p_wins THEN p_gone ELSE l_gone END AS deleted, CASE WHEN p_wins THEN p_time ELSE l_time END AS modified_s FROM x")
def global_winner(spark, sf_dir):
    d = reconcile.global_winner(fx.catalog(spark, sf_dir), LOCAL)
    return d.select("folder", "name", F.col("winner.replica").alias("winner_replica"), F.col("winner.deleted").alias("deleted"), F.col("winner.modified_s").alias("modified_s"))


@query(_WINNERS + "SELECT folder, count(*) AS pending, CAST(sum(size) AS BIGINT) AS pending_bytes FROM n WHERE reason <> 'delete' GROUP BY folder")
def pending_totals(spark, sf_dir):
    return reconcile.pending_totals(fx.catalog(spark, sf_dir), LOCAL)


@query(_WINNERS + "SELECT folder, name, '2' AS winner_replica, l_size AS size FROM n WHERE reason = 'delete'")
def pending_deletions(spark, sf_dir):
    return reconcile.pending_deletions(fx.catalog(spark, sf_dir), LOCAL)


@query(_WINNERS + "SELECT folder, name, l_size AS size, CAST(1 AS BIGINT) AS lacking FROM x WHERE has_l AND NOT l_gone AND (NOT has_p OR p_gone OR l_later)")
def pending_uploads(spark, sf_dir):
    return reconcile.pending_uploads(fx.catalog(spark, sf_dir), LOCAL, fx.peers(spark))


_CANON = "CASE WHEN v1 > 0 THEN '1:' || CAST(v1 AS VARCHAR) || '|' ELSE '' END || CASE WHEN v2 > 0 THEN '2:' || CAST(v2 AS VARCHAR) || '|' ELSE '' END"


@query(_CATALOG + f", k AS (SELECT *, {_CANON} AS canon FROM c) SELECT folder, name, size, deleted, canon FROM k a WHERE replica = '1' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.replica = '2' AND b.folder = a.folder AND b.name = a.name AND b.canon = a.canon)")
def diff_for_peer(spark, sf_dir):
    return reconcile.diff_for_peer(fx.catalog(spark, sf_dir), LOCAL, PEER)


_GONE_NEW = """, gone AS (SELECT l.folder, l.name, l.size, l.hash FROM c l JOIN c p ON l.folder = p.folder AND l.name = p.name WHERE l.replica = '1' AND p.replica = '2' AND NOT l.deleted AND p.deleted),
new AS (SELECT p.folder, p.name, p.size, p.hash FROM c p WHERE p.replica = '2' AND NOT p.deleted AND NOT EXISTS (SELECT 1 FROM c l WHERE l.replica = '1' AND NOT l.deleted AND l.folder = p.folder AND l.name = p.name)),
one_gone AS (SELECT folder, size, hash, min(name) AS from_name FROM gone GROUP BY ALL HAVING count(*) = 1), one_new AS (SELECT folder, size, hash, min(name) AS to_name FROM new GROUP BY ALL HAVING count(*) = 1),
moves AS (SELECT folder, from_name, to_name, size FROM one_gone JOIN one_new USING (folder, size, hash))
"""


@query(_CATALOG + _GONE_NEW + "SELECT * FROM moves")
def plan_moves(spark, sf_dir):
    return reconcile.plan_moves(fx.catalog(spark, sf_dir), LOCAL, PEER)


@query(
    _CATALOG
    + _GONE_NEW
    + """SELECT folder, CASE size % 4 WHEN 0 THEN from_name || '.none' ELSE from_name END AS from_name, CASE size % 4 WHEN 1 THEN from_name WHEN 2 THEN to_name || '.none' ELSE to_name END AS to_name, size,
    CASE size % 4 WHEN 0 THEN 'source gone' WHEN 1 THEN 'target exists' WHEN 2 THEN 'content differs' END AS problem FROM moves"""
)
def validate_moves(spark, sf_dir):
    """Moves of which three in four must be refused, each for another reason."""
    c = fx.catalog(spark, sf_dir)
    k, none = F.col("size") % 4, F.lit(".none")
    moves = reconcile.plan_moves(c, LOCAL, PEER)
    moves = moves.select("folder", F.when(k == 0, F.concat("from_name", none)).otherwise(F.col("from_name")).alias("from_name"), F.when(k == 1, F.col("from_name")).when(k == 2, F.concat("to_name", none)).otherwise(F.col("to_name")).alias("to_name"), "size")
    return reconcile.validate_moves(moves, c, LOCAL, PEER)


@query(_CATALOG + _GONE_NEW + "SELECT folder, from_name AS name, true AS deleted, '1:2|' AS canon FROM moves UNION ALL SELECT folder, to_name, false, '2:1|' FROM moves")
def apply_moves(spark, sf_dir):
    c = fx.catalog(spark, sf_dir)
    return reconcile.apply_moves(reconcile.plan_moves(c, LOCAL, PEER), c, LOCAL, PEER).select("folder", "name", "deleted", vectors.canonical("version").alias("canon"))


@query(_CATALOG + _GONE_NEW + ", n AS (SELECT folder, count(*) AS n FROM moves GROUP BY folder) SELECT folder, '' AS path, 'moved ' || CAST(n AS VARCHAR) || ' file(s) locally (same-content rename, no transfer)' AS reason, '' AS linked FROM n UNION ALL SELECT folder, to_name, 'moved (local rename, no transfer)', from_name FROM moves JOIN n USING (folder) WHERE n <= 50")
def move_events(spark, sf_dir):
    return status.move_events(reconcile.plan_moves(fx.catalog(spark, sf_dir), LOCAL, PEER), 1700000000, PEER).select("folder", "path", "reason", "linked")


@query(
    _WINNERS
    + """SELECT folder, name, has_l AND NOT l_gone AND folder = 'folder2' AS archive, has_l AND NOT l_gone AND clash AND NOT same AND folder = 'folder0' AS conflict_copy,
    CASE WHEN has_l AND NOT l_gone AND clash AND NOT same AND folder = 'folder0' THEN replace(name, '.txt', '') || '.sync-conflict-' || strftime(make_timestamp(CAST(l_time AS BIGINT) * 1000000), '%Y%m%d-%H%M%S') || '-1.txt' END AS copy_name, x.l_size AS size
    FROM x JOIN (SELECT folder, name FROM n WHERE reason IS NOT NULL) USING (folder, name)"""
)
def overwrite_plan(spark, sf_dir):
    d = reconcile.overwrite_plan(fx.catalog(spark, sf_dir), LOCAL, fx.folders(spark))
    return d.select("folder", "name", "archive", "conflict_copy", "copy_name", "size")


@query(_WINNERS + "SELECT folder, name, p_gone AS deleted, p_time AS modified_s FROM x WHERE p_wins")
def adopt_winners(spark, sf_dir):
    c = fx.catalog(spark, sf_dir)
    return reconcile.adopt(c, LOCAL, c.select("folder", "name").distinct()).select("folder", "name", "deleted", "modified_s")


@query(_CATALOG + ", g AS (SELECT folder, name, v1, v2 FROM c WHERE replica = '1' AND NOT deleted AND name LIKE 'fr/%') SELECT folder, name, true AS deleted, '1:' || CAST(v1 + 1 AS VARCHAR) || '|' || CASE WHEN v2 > 0 THEN '2:' || CAST(v2 AS VARCHAR) || '|' ELSE '' END AS canon FROM g")
def delete_directory(spark, sf_dir):
    """A directory's deletion takes all below it along."""
    c = fx.catalog(spark, sf_dir)
    goal = c.select("folder").distinct().withColumn("name", F.lit("fr"))
    return reconcile.apply_deletions(c, LOCAL, goal).select("folder", "name", "deleted", vectors.canonical("version").alias("canon"))


@query(_CATALOG + " SELECT folder, name, seq AS sequence, deleted, folder <> 'folder3' AS is_update FROM c WHERE replica = '1' AND (folder = 'folder3' OR seq > 500)")
def select_delta(spark, sf_dir):
    markers = spark.createDataFrame([(f"folder{i}", PEER, "b" if i == 3 else "a", 500) for i in range(4)], "folder string, peer string, index_id string, max_seq long")
    indexes = spark.createDataFrame([(f"folder{i}", "a") for i in range(4)], "folder string, index_id string")
    return reconcile.select_delta(fx.catalog(spark, sf_dir), markers, indexes, LOCAL, PEER)[0]


@query(
    _CATALOG
    + """ SELECT folder, replica, count(*) AS entries, CAST(coalesce(sum(size), 0) AS BIGINT) AS size, count(*) FILTER (deleted) AS tombstones, count(*) FILTER (NOT deleted) AS live_files,
    count(*) FILTER (NOT deleted AND name ILIKE '%.sync-conflict%') AS conflicts, CAST(coalesce(sum(size) FILTER (NOT deleted AND name ILIKE '%.sync-conflict%'), 0) AS BIGINT) AS conflict_bytes FROM c GROUP BY folder, replica"""
)
def catalog_stats(spark, sf_dir):
    return catalog.catalog_stats(fx.catalog(spark, sf_dir))


@query(_CATALOG + " SELECT folder, name, size, modified_s, 'file' AS type FROM c WHERE replica = '1' AND NOT deleted")
def files(spark, sf_dir):
    return catalog.files(fx.catalog(spark, sf_dir), LOCAL)


@query(_CATALOG + " SELECT folder, replica, max(seq) AS max_sequence FROM c GROUP BY folder, replica")
def max_sequence(spark, sf_dir):
    return catalog.max_sequence(fx.catalog(spark, sf_dir))


@query(
    _CATALOG
    + """, u AS (SELECT folder, '1' AS replica, name, row_number() OVER (PARTITION BY folder ORDER BY name) + (SELECT max(seq) FROM c m WHERE m.replica = '1' AND m.folder = c.folder) AS sequence FROM c WHERE replica = '2' AND NOT deleted AND v2 = 1)
    SELECT folder, name, sequence FROM u UNION ALL SELECT folder, name, seq FROM c WHERE replica = '1' AND NOT EXISTS (SELECT 1 FROM u WHERE u.folder = c.folder AND u.name = c.name)"""
)
def put_updates(spark, sf_dir):
    """The peer's own rows taken into the local catalog, under new sequence numbers."""
    c = fx.catalog(spark, sf_dir)
    new = c.where("replica = '2' AND NOT deleted").where(vectors.counter("version", PEER) == 1).withColumns({"replica": F.lit(LOCAL), "sequence": F.lit(None).cast("long")})
    return catalog.put(c.where("replica = '1'"), new).select("folder", "name", "sequence")


@query(_WINNERS + ", g AS (SELECT folder, count(*) FILTER (has_l AND NOT l_gone) AS live FROM x WHERE has_l GROUP BY folder) SELECT folder, live, deletions, live > 0 AND deletions >= 100 AND deletions * 100 >= live * 25 AS blocked FROM g JOIN (SELECT folder, count(n.reason) FILTER (n.reason = 'delete') AS deletions FROM n GROUP BY folder) USING (folder)")
def deletion_guard(spark, sf_dir):
    return guards.deletion_guard(fx.catalog(spark, sf_dir), fx.folders(spark), LOCAL)


_CASES = """, names AS (SELECT folder, name FROM c WHERE replica = '1' AND NOT deleted UNION SELECT folder, upper(name[1:2]) || name[3:] FROM c WHERE replica = '1' AND NOT deleted AND seq % 50 = 0)
SELECT folder, lower(name) AS key, regexp_replace(lower(name), '/[^/]*$', '') AS dir, array_to_string(list_sort(list(name)), ' / ') AS names FROM names GROUP BY folder, lower(name) HAVING count(*) > 1"""


@query(_CATALOG + _CASES)
def case_collisions(spark, sf_dir):
    c = fx.catalog(spark, sf_dir)
    loud = c.where("replica = '1' AND NOT deleted AND sequence % 50 = 0").withColumn("name", F.concat(F.upper(F.substring("name", 1, 2)), F.expr("substring(name, 3)")))
    return guards.case_collisions(c.unionByName(loud), LOCAL)


@query(
    _CATALOG
    + """, l AS (SELECT * FROM c WHERE replica = '1'), p AS (SELECT * FROM c WHERE replica = '2' AND NOT deleted),
    k AS (SELECT coalesce(l.folder, p.folder) AS folder, coalesce(l.name, p.name) AS name, CASE WHEN p.name IS NULL THEN CASE WHEN NOT l.deleted THEN 'deleted' END WHEN l.name IS NULL THEN 'added'
          WHEN l.deleted OR l.size <> p.size OR l.modified_s <> p.modified_s THEN 'modified' END AS kind FROM l FULL JOIN p ON l.folder = p.folder AND l.name = p.name)
    SELECT folder, name, kind FROM k WHERE kind IS NOT NULL"""
)
def scan_diff(spark, sf_dir):
    return diff.scan_diff(fx.listing(spark, sf_dir), fx.catalog(spark, sf_dir).where("replica = '1'")).select("folder", "name", "kind")


_PATHS = r"WITH q AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/|[?#].*$', '', 'g') AS name FROM pages), b AS (SELECT *, regexp_replace(name, '^.*/', '') AS base FROM q)"


@query(_PATHS + " SELECT page_id, name, CASE WHEN base LIKE '%_cache' AND right(base, 6) = '_cache' THEN true WHEN name = 'en/25' OR name LIKE 'en/25/%' THEN false WHEN lower(base) LIKE '%.html' THEN true WHEN name = 'fr' OR name LIKE 'fr/%' THEN true ELSE false END AS ignored FROM b")
def ignore_rules(spark, sf_dir):
    lines = spark.createDataFrame([("folder0", i, x) for i, x in enumerate(RULES)], "folder string, ord int, line string")
    return rules.with_rules(fx.paths(spark, sf_dir), rules.compile_rules(lines)).select("page_id", "name", "ignored")


_BLOCKS = """WITH d AS (SELECT 'folder' || CAST(doc_id % 4 AS VARCHAR) AS folder, lang || '/' || source || '/doc' || CAST(doc_id AS VARCHAR) || '.txt' AS name, text FROM documents),
b AS (SELECT folder, name, i AS idx, substring(text, CAST(i * 512 + 1 AS BIGINT), 512) AS piece FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 512.0) AS BIGINT))) AS i FROM d))
"""


@query(_BLOCKS + "SELECT folder, name, CAST(sum(length(piece)) AS BIGINT) AS size, CAST(count(*) AS INT) AS n_blocks, sha256(string_agg(sha256(piece), ',' ORDER BY idx)) AS digest FROM b GROUP BY folder, name")
def block_manifest(spark, sf_dir):
    d = blocks.manifest(blocks.explode_blocks(fx.contents(spark, sf_dir), "content", 512))
    return d.select("folder", "name", F.col("size").cast("long").alias("size"), "n_blocks", F.sha2(F.array_join("blocks", ","), 256).alias("digest"))


@query(_BLOCKS + ", e AS (SELECT folder, name, i AS idx, substring(text || '#edit', CAST(i * 512 + 1 AS BIGINT), 512) AS piece FROM (SELECT *, unnest(range(CAST(ceil((length(text) + 5) / 512.0) AS BIGINT))) AS i FROM d)) SELECT folder, name, idx, sha256(piece) AS hash FROM e EXCEPT SELECT folder, name, idx, sha256(piece) FROM b")
def missing_blocks(spark, sf_dir):
    """Blocks to fetch for edited texts, given those of the texts before."""
    c = fx.contents(spark, sf_dir)
    edited = c.withColumn("content", F.concat("content", F.lit("#edit")))
    d = blocks.missing_blocks(blocks.explode_blocks(edited, "content", 512), blocks.explode_blocks(c, "content", 512))
    return d.select("folder", "name", F.col("idx").cast("long").alias("idx"), "hash")


@query("SELECT o_orderkey, CASE WHEN s <= 0 OR s <= 2000 * 131072 THEN 131072 WHEN s <= 2000 * 262144 THEN 262144 WHEN s <= 2000 * 524288 THEN 524288 WHEN s <= CAST(2000 AS BIGINT) * 1048576 THEN 1048576 WHEN s <= CAST(2000 AS BIGINT) * 2097152 THEN 2097152 WHEN s <= CAST(2000 AS BIGINT) * 4194304 THEN 4194304 WHEN s <= CAST(2000 AS BIGINT) * 8388608 THEN 8388608 ELSE 16777216 END AS block_size FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000000 AS s FROM orders)")
def block_sizes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return d.select("o_orderkey", content.block_size(F.col("o_orderkey").cast("long") * 1_000_000).alias("block_size"))


_ARCHIVE = "WITH a AS (SELECT doc_id, 'folder' || CAST(doc_id % 4 AS VARCHAR) AS folder, ['trashcan', 'simple', 'staggered'][CAST(doc_id % 3 + 1 AS BIGINT)] AS strategy, source AS path, 1700000000 + doc_id * 60 AS t FROM documents)"


@query(_ARCHIVE + ", r AS (SELECT *, row_number() OVER (PARTITION BY folder, strategy, path, CASE WHEN strategy = 'staggered' THEN t // 86400 ELSE 0 END ORDER BY doc_id DESC) AS n FROM a) SELECT folder, strategy, path, doc_id AS stamp FROM r WHERE n <= CASE WHEN strategy = 'trashcan' THEN 1 ELSE 3 END")
def prune_archive(spark, sf_dir):
    return retention.prune_keep(fx.archive(spark, sf_dir), 3).select("folder", "strategy", "path", "stamp")


@query("SELECT 'folder' || CAST(doc_id % 4 AS VARCHAR) AS folder, count(*) AS versions, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE 1700000000 + doc_id * 60 >= 1700030000 - 86400 / 4 GROUP BY 1")
def archive_after_age(spark, sf_dir):
    """What the archive holds after versions older than a day are gone."""
    return retention.archive_stats(retention.prune_age(fx.archive(spark, sf_dir), 1, 1700030000 + 86400 * 3 // 4))


_UPLOADS = ", up AS (SELECT folder, name FROM x WHERE has_l AND NOT l_gone AND (NOT has_p OR p_gone OR l_later))"


@query(
    _WINNERS
    + _UPLOADS
    + ", "
    + fx.for_duckdb(fx.EVENTS)
    + """,
    f AS (SELECT unnest(range(4)) AS k),
    o AS (SELECT 'folder' || CAST(k AS VARCHAR) AS folder FROM f),
    st AS (SELECT folder, count(*) AS entries, CAST(sum(size) AS BIGINT) AS size, count(*) FILTER (deleted) AS tombstones, count(*) FILTER (NOT deleted) AS live FROM c WHERE replica = '1' GROUP BY folder),
    pl AS (SELECT folder, count(*) FILTER (reason <> 'delete') AS pending, CAST(sum(size) FILTER (reason <> 'delete') AS BIGINT) AS pending_bytes, count(*) FILTER (reason = 'delete') AS dels FROM n WHERE reason IS NOT NULL GROUP BY folder),
    us AS (SELECT folder, count(*) AS uploads FROM up GROUP BY folder),
    oc AS (SELECT folder, count(DISTINCT path || chr(0) || category) AS open_conditions FROM e WHERE resolution = 0 AND severity >= 1 GROUP BY folder),
    ar AS (SELECT 'folder' || CAST(doc_id % 4 AS VARCHAR) AS folder, count(*) AS versions, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1)
    SELECT o.folder, coalesce(entries, 0) AS entries, coalesce(st.size, 0) AS size, coalesce(tombstones, 0) AS tombstones, coalesce(live, 0) AS live_files, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS conflict_bytes,
        coalesce(pending, 0) AS pending, coalesce(pending_bytes, 0) AS pending_bytes, coalesce(dels, 0) AS pending_deletions, coalesce(uploads, 0) AS uploads, coalesce(open_conditions, 0) AS open_conditions,
        coalesce(versions, 0) AS versions, coalesce(bytes, 0) AS bytes, coalesce(live, 0) > 0 AND coalesce(dels, 0) >= 100 AND coalesce(dels, 0) * 100 >= coalesce(live, 0) * 25 AS guard
    FROM o LEFT JOIN st USING (folder) LEFT JOIN pl USING (folder) LEFT JOIN us USING (folder) LEFT JOIN oc USING (folder) LEFT JOIN ar USING (folder)"""
)
def folder_status(spark, sf_dir):
    events = fx.events(spark, sf_dir)
    return status.folder_status(fx.catalog(spark, sf_dir), LOCAL, fx.folders(spark), fx.peers(spark), events, retention.archive_stats(fx.archive(spark, sf_dir)))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN source || '/' || CAST((1700000000 + doc_id * 60) * 1000000000 + 7 AS VARCHAR) ELSE source || '/' || strftime(make_timestamp(CAST(1700000000 + doc_id * 60 AS BIGINT) * 1000000), '%Y-%m-%d') || '/' || CAST((1700000000 + doc_id * 60) * 1000000000 + 7 AS VARCHAR) END AS archive_path, source AS path FROM documents")
def archive_paths(spark, sf_dir):
    """Layouts of the three strategies, and back."""
    d = fx.archive(spark, sf_dir)
    d = d.withColumn("archive_path", paths.archive_path("strategy", "path", "modified_s", F.lit(7)))
    return d.select(F.col("stamp").alias("doc_id"), "archive_path", paths.archived_original("strategy", "archive_path").alias("path"))


@query(_CATALOG + " SELECT folder, replica, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS tombstones FROM c GROUP BY folder, replica")
def live_counts(spark, sf_dir):
    return catalog.live_counts(fx.catalog(spark, sf_dir))


@query(_CATALOG + " SELECT folder, replica, name, seq AS sequence, deleted FROM c WHERE seq > 300")
def list_after(spark, sf_dir):
    return catalog.list_after(fx.catalog(spark, sf_dir), 300).select("folder", "replica", "name", "sequence", "deleted")


@query(
    "SELECT 'folder' || CAST(o_orderkey % 3 AS VARCHAR) AS folder, 'o' || CAST(o_orderkey AS VARCHAR) AS name, CAST(10 + row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY 'o' || CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS sequence FROM orders"
)
def numbered_entries(spark, sf_dir):
    """Sequence numbers of new entries, one for each order, after ten in every folder."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    folder, name = F.concat(F.lit("folder"), F.col("o_orderkey") % 3), F.concat(F.lit("o"), "o_orderkey")
    d = d.select(folder.alias("folder"), F.lit(LOCAL).alias("replica"), name.alias("name"), F.lit(None).cast("long").alias("sequence"))
    last = d.select("folder", "replica").distinct().withColumn("max_sequence", F.lit(10).cast("long"))
    return catalog.numbered(d, last).select("folder", "name", "sequence")


@query(_WINNERS + "SELECT folder, name AS path, 'applied' AS category, CASE WHEN reason = 'delete' THEN 'deleted (remote)' ELSE 'pulled from peer' END AS reason, '2' AS peer_id FROM n WHERE reason IS NOT NULL")
def pull_events(spark, sf_dir):
    pulls = reconcile.need_pulls(fx.catalog(spark, sf_dir), LOCAL)
    return resolve.pull_events(pulls, PEER, 1700000000).select("folder", "path", "category", "reason", "peer_id")


@query(
    _CATALOG
    + """, l AS (SELECT * FROM c WHERE replica = '1'), p AS (SELECT * FROM c WHERE replica = '2' AND NOT deleted),
    k AS (SELECT coalesce(l.folder, p.folder) AS folder, coalesce(l.name, p.name) AS path, CASE WHEN p.name IS NULL THEN CASE WHEN NOT l.deleted THEN 'local delete' END WHEN l.name IS NULL THEN 'local add'
          WHEN l.deleted OR l.size <> p.size OR l.modified_s <> p.modified_s THEN 'local modify' END AS reason FROM l FULL JOIN p ON l.folder = p.folder AND l.name = p.name)
    SELECT folder, path, 'applied' AS category, reason FROM k WHERE reason IS NOT NULL"""
)
def change_events(spark, sf_dir):
    changes = diff.scan_diff(fx.listing(spark, sf_dir), fx.catalog(spark, sf_dir).where("replica = '1'"))
    return resolve.change_events(changes, 1700000000).select("folder", "path", "category", "reason")


_COPIES = ", cc AS (SELECT folder, replace(name, '.txt', '') || '.sync-conflict-20260818-080000-1.txt' AS copy, name, size, modified_s, v1, v2 FROM c WHERE replica = '1' AND NOT deleted AND seq % 25 = 3)"


def _with_copies(spark, sf_dir):
    """The catalog with conflict copies of every 25th document."""
    c = fx.catalog(spark, sf_dir)
    copies = c.where("replica = '1' AND NOT deleted AND sequence % 25 = 3").withColumn("name", F.concat(F.regexp_replace("name", r"\.txt$", ""), F.lit(".sync-conflict-20260818-080000-1.txt")))
    return c.unionByName(copies)


@query(_CATALOG + _COPIES + " SELECT folder, copy AS name, size, modified_s, 'file' AS type FROM cc")
def conflict_copies_listed(spark, sf_dir):
    return catalog.conflicts(_with_copies(spark, sf_dir), LOCAL)


@query(_CATALOG + _COPIES + ", a AS (SELECT folder, size, deleted, false AS copied FROM c WHERE replica = '1' UNION ALL SELECT folder, size, false, true FROM cc) SELECT folder, count(*) AS entries, count(*) FILTER (copied) AS conflicts, CAST(coalesce(sum(size) FILTER (copied), 0) AS BIGINT) AS conflict_bytes FROM a GROUP BY folder")
def conflict_stats(spark, sf_dir):
    d = catalog.catalog_stats(_with_copies(spark, sf_dir)).where("replica = '1'")
    return d.select("folder", "entries", "conflicts", "conflict_bytes")


@query(_CATALOG + _COPIES + " SELECT folder, copy AS name, true AS deleted, '1:' || CAST(v1 + 1 AS VARCHAR) || '|' || CASE WHEN v2 > 0 THEN '2:' || CAST(v2 AS VARCHAR) || '|' ELSE '' END AS canon FROM cc")
def resolved_conflicts(spark, sf_dir):
    """All conflict copies go; the current files stay."""
    gone = resolve.resolve_all_conflicts(_with_copies(spark, sf_dir), LOCAL, 1700000000)[0]
    return gone.select("folder", "name", "deleted", vectors.canonical("version").alias("canon"))


@query(_CATALOG + _COPIES + " SELECT folder, copy AS path, 'resolve' AS kind, 'conflict' AS category FROM cc UNION ALL SELECT folder, name, 'resolve', 'conflict' FROM cc")
def conflict_settlements(spark, sf_dir):
    actions = resolve.resolve_all_conflicts(_with_copies(spark, sf_dir), LOCAL, 1700000000)[1]
    return actions.select("folder", "path", "kind", "category")


@query(_WINNERS + "SELECT folder, name, true AS deleted, '1:2|' AS canon FROM n WHERE reason = 'delete' AND folder = 'folder3'")
def applied_deletions(spark, sf_dir):
    """Held-back deletions of one folder let through."""
    d = resolve.apply_pending_deletions(fx.catalog(spark, sf_dir), LOCAL, "folder3", 1700000000)[0]
    return d.select("folder", "name", "deleted", vectors.canonical("version").alias("canon"))


#: Events of the log on the names of the documents, and the copies of some of these.
_NAMED = ", " + fx.for_duckdb(fx.EVENTS) + ", en AS (SELECT e.id, c.folder, c.name AS path, category, severity, resolution, reason FROM e JOIN c ON c.replica = '1' AND 'p' || CAST(c.seq AS VARCHAR) = e.path)"


def _named_events(spark, sf_dir):
    names = fx.catalog(spark, sf_dir).where("replica = '1'").select(F.col("folder").alias("f"), "name", F.concat(F.lit("p"), F.col("sequence").cast("string")).alias("path"))
    return fx.events(spark, sf_dir).join(names, "path").drop("folder", "path").withColumnsRenamed({"f": "folder", "name": "path"})


@query(
    _WINNERS
    + _UPLOADS
    + _COPIES
    + _NAMED
    + """,
    live AS (SELECT folder, name, size, modified_s FROM c WHERE replica = '1' AND NOT deleted UNION ALL SELECT folder, copy, size, modified_s FROM cc),
    pull AS (SELECT folder, name, size FROM n WHERE reason <> 'delete'),
    ups AS (SELECT folder, name FROM up UNION ALL SELECT folder, copy FROM cc),
    warned AS (SELECT en.folder, coalesce(cc.copy, path) AS name, arg_max(category, id) AS category, arg_max(reason, id) AS reason FROM en LEFT JOIN cc ON cc.folder = en.folder AND cc.name = path WHERE resolution = 0 AND severity >= 1 GROUP BY 1, 2),
    keys AS (SELECT folder, name FROM pull UNION SELECT folder, name FROM ups UNION SELECT folder, copy FROM cc UNION SELECT folder, name FROM warned)
    SELECT k.folder, k.name, coalesce(live.size, pull.size, 0) AS size, coalesce(live.modified_s, 0) AS modified_s, CASE WHEN live.name IS NOT NULL OR pull.name IS NOT NULL THEN 'file' ELSE '' END AS type,
        pull.name IS NOT NULL AS pending, ups.name IS NOT NULL AS pending_up, cc.copy IS NOT NULL AS conflict, coalesce(cc.name, '') AS conflict_of, warned.name IS NOT NULL AS event, coalesce(category, '') AS event_cat, coalesce(reason, '') AS reason
    FROM keys k LEFT JOIN live ON live.folder = k.folder AND live.name = k.name LEFT JOIN pull ON pull.folder = k.folder AND pull.name = k.name LEFT JOIN ups ON ups.folder = k.folder AND ups.name = k.name
        LEFT JOIN cc ON cc.folder = k.folder AND cc.copy = k.name LEFT JOIN warned ON warned.folder = k.folder AND warned.name = k.name"""
)
def attention(spark, sf_dir):
    """Pulls, uploads, copies of conflicts and open warnings on the documents' names, a row per name."""
    return status.attention(_with_copies(spark, sf_dir), _named_events(spark, sf_dir), LOCAL, fx.peers(spark))
