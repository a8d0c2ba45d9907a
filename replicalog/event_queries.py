"""Queries over the event log and the attempts to reach peers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .operators import events as ev

NOW = 1_900_000_000
_EVENTS = "WITH " + fx.for_duckdb(fx.EVENTS)
_ATTEMPTS = "WITH " + fx.for_duckdb(fx.ATTEMPTS)
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(_EVENTS + " SELECT id, folder, path, category, severity FROM e WHERE resolution = 0 AND severity >= 1")
def open_events(spark, sf_dir):
    """The limit hides no open event."""
    return ev.query_events(fx.events(spark, sf_dir), ev.Filter(open_only=True, limit=1)).select("id", "folder", "path", "category", "severity")


@query(_EVENTS + " SELECT id, folder, path, category FROM e WHERE folder = 'folder1' AND severity >= 1 AND id > 100 AND (peer_id = '2' OR (folder = 'peers' AND path = 'nas')) ORDER BY id DESC LIMIT 50")
def filtered_events(spark, sf_dir):
    f = ev.Filter(folder="folder1", min_severity=1, after_id=100, peer="2", peer_name="nas", limit=50)
    return ev.query_events(fx.events(spark, sf_dir), f).select("id", "folder", "path", "category")


@query(_EVENTS + " SELECT folder, count(DISTINCT path || '/' || category) AS open_conditions FROM e WHERE resolution = 0 AND severity >= 1 GROUP BY folder")
def open_conditions(spark, sf_dir):
    return ev.count_open(fx.events(spark, sf_dir))


_CUT = """, k AS (SELECT min(ts_s) FILTER (resolution = 0 AND severity >= 1) AS cutoff FROM e), f AS (SELECT e.*, ts_s < cutoff AS old, resolution = 0 AND severity >= 1 AS open FROM e, k)"""


@query(_EVENTS + ", f AS (SELECT *, ts_s < 1704500000 AS old, resolution = 0 AND severity >= 1 AS open FROM e) SELECT count(*) FILTER (old AND NOT open) AS deleted, CAST(0 AS BIGINT) AS deleted_open, count(*) FILTER (old AND open) AS kept_open, CAST(1704500000 AS BIGINT) AS cutoff FROM f")
def archive_preview(spark, sf_dir):
    d = ev.archive_preview(fx.events(spark, sf_dir), NOW - 1_704_500_000, False, NOW)
    return d.select("deleted", "deleted_open", "kept_open", F.col("cutoff").cast("long").alias("cutoff"))


@query(_EVENTS + _CUT + " SELECT id FROM f WHERE NOT (old AND NOT open)")
def archive_before_oldest_warning(spark, sf_dir):
    return ev.archive_events(fx.events(spark, sf_dir), None, False, NOW).select("id")


@query(_EVENTS + " SELECT id, '[' || category || '] ' || folder || '/' || path || ': ' || reason AS message FROM e WHERE severity >= 1 AND (category = 'error' OR (category = 'peer' AND contains(reason, 'peer offline')))")
def alert_messages(spark, sf_dir):
    return ev.alerts(fx.events(spark, sf_dir).where(ev.page_worthy()), "node").select("id", "message")


@query(
    _EVENTS
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY folder, path, category ORDER BY ts_s, id) AS n FROM e WHERE severity >= 1 AND (category = 'error' OR (category = 'peer' AND contains(reason, 'peer offline')))),
    r AS (WITH RECURSIVE f AS (SELECT folder, path, category, id, ts_s, n, ts_s AS last, true AS fires FROM p WHERE n = 1
          UNION ALL SELECT p.folder, p.path, p.category, p.id, p.ts_s, p.n, CASE WHEN p.ts_s - f.last >= 86400 THEN p.ts_s ELSE f.last END, p.ts_s - f.last >= 86400 FROM f JOIN p ON p.folder = f.folder AND p.path = f.path AND p.category = f.category AND p.n = f.n + 1) SELECT * FROM f)
    SELECT id FROM r WHERE fires"""
)
def throttled_alerts(spark, sf_dir):
    return ev.throttle_alerts(fx.events(spark, sf_dir), 86400).select("id")


@query(
    _EVENTS
    + """, q AS (SELECT id, ts_s, folder, path, CASE WHEN category <> 'applied' THEN reason END AS reason FROM e),
    b AS (SELECT *, lag(reason) OVER w AS before, lag(id) OVER w IS NULL AS first FROM q WINDOW w AS (PARTITION BY folder, path ORDER BY ts_s, id))
    SELECT id, reason IS NULL AS is_resolve FROM b WHERE CASE WHEN first THEN reason IS NOT NULL ELSE reason IS DISTINCT FROM before END"""
)
def throttled_problems(spark, sf_dir):
    d = fx.events(spark, sf_dir).withColumn("reason", F.when(F.col("category") != "applied", F.col("reason")))
    return ev.throttle_by_reason(d.select("id", "ts_s", "folder", "path", "reason")).select("id", "is_resolve")


@query()
def folded_events(spark, sf_dir):
    """The log with actions on every eleventh event."""
    e = fx.events(spark, sf_dir)
    on = e.where("id % 11 = 0")
    kind = F.when(F.col("id") % 3 == 0, "acknowledge").when(F.col("id") % 3 == 1, "resolve").otherwise("reopen")
    actions = on.select((F.col("id") * 10).alias("action_id"), kind.alias("kind"), "id", F.lit("").alias("folder"), F.lit("").alias("path"), F.lit("").alias("category"), F.lit("me").alias("by"), (F.col("ts_s") + 5).alias("ts_s"))
    return ev.fold_state(e, actions).select("id", F.col("resolution").cast("int").alias("resolution"))


@query(
    _ATTEMPTS
    + """, i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY peer ORDER BY ts, id) AS island FROM a),
    n AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY peer, island ORDER BY ts, id) AS BIGINT) AS failures FROM i)
    SELECT id, peer, failures, CAST(CASE WHEN failures > 0 THEN least(5 * power(2, least(failures, 30) - 1), 300) ELSE 0 END AS BIGINT) AS wait_s, ok AND coalesce(lag(failures) OVER (PARTITION BY peer ORDER BY ts, id), 0) > 0 AS recovered FROM n"""
)
def peer_backoff(spark, sf_dir):
    return ev.peer_backoff(fx.attempts(spark, sf_dir)).select("id", "peer", "failures", F.col("wait_s").cast("long").alias("wait_s"), "recovered")


@query(
    _ATTEMPTS
    + """, b AS (SELECT *, lag(ok) OVER w AS was_ok, lag(error) OVER w AS was_error FROM a WINDOW w AS (PARTITION BY peer ORDER BY ts, id))
    SELECT id, peer, CASE WHEN ok THEN 'online' ELSE 'offline' END AS change, CASE WHEN ok THEN 'peer back online' ELSE 'peer offline: ' || error END AS reason FROM b
    WHERE CASE WHEN ok THEN was_ok = false ELSE coalesce(was_ok, true) OR error IS DISTINCT FROM was_error END"""
)
def peer_transitions(spark, sf_dir):
    return ev.peer_transitions(fx.attempts(spark, sf_dir)).select("id", "peer", "change", "reason")


@query(
    _EVENTS
    + """, s AS (SELECT folder, ts_s AS started, ts_s + id % 600 AS finished FROM e),
    r AS (SELECT *, max(finished) OVER (PARTITION BY folder ORDER BY started, finished ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR started > reach THEN 1 ELSE 0 END) OVER (PARTITION BY folder ORDER BY started, finished ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT folder, min(started) AS started, max(finished) AS finished FROM i GROUP BY folder, island"""
)
def busy_intervals(spark, sf_dir):
    s = fx.events(spark, sf_dir).select("folder", F.col("ts_s").alias("started"), (F.col("ts_s") + F.col("id") % 600).alias("finished"))
    return ev.busy_intervals(s).select("folder", "started", "finished")


_STALE = """, k AS (SELECT DISTINCT folder, path FROM e WHERE id % 3 = 0),
    s AS (SELECT folder, path, id FROM e WHERE category = 'conflict' AND resolution = 0 AND severity >= 1 AND folder IN ('folder0', 'folder2')
          AND NOT EXISTS (SELECT 1 FROM k WHERE k.folder = e.folder AND k.path = e.path AND length(k.path) % 2 = 0))"""


def _stale(spark, sf_dir):
    """Conflict copies of some paths of the log, part of which are gone; two of the folders make copies by their policy."""
    e = fx.events(spark, sf_dir)
    copies = e.where("id % 3 = 0").select("folder", F.lit("1").alias("replica"), F.concat("path", F.lit(".sync-conflict-20260818-080000-1")).alias("name"), (F.length("path") % 2 == 1).alias("deleted")).distinct()
    return ev.stale_conflicts(e, copies, "1", fx.folders(spark))


@query(_EVENTS + _STALE + " SELECT folder, path, id FROM s")
def stale_conflicts(spark, sf_dir):
    return _stale(spark, sf_dir)


@query(_EVENTS + _STALE + " SELECT DISTINCT folder, path, 'resolve' AS kind, 'conflict' AS category, 'system' AS \"by\", CAST(1700000000 AS BIGINT) AS ts_s FROM s")
def stale_conflict_actions(spark, sf_dir):
    return ev.stale_conflict_actions(_stale(spark, sf_dir), 1700000000).drop("action_id", "id")
