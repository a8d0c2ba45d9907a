"""Checks of a fleet's declared folders and peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import DEFAULT_DAYS
from ..operators.guards import DELETE_PCT
from ..operators.retention import STRATEGIES

#: Conflict policies, and the prefix that all shared paths have.
POLICIES, PREFIX = ("", "newest", "conflict-copy"), "/mnt/user/"


def _blank(column: str):
    return F.coalesce(F.btrim(column), F.lit("")) == ""


def _twice(d: DataFrame, what: str) -> DataFrame:
    n = d.where(~_blank("id")).groupBy("node", "id").count().where("count > 1")
    return n.select("node", "id", F.lit(f"duplicate {what} id").alias("violation"))


def _violations(d: DataFrame, tests: dict) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in tests.items()]))
    return d.select("node", "id", F.explode(found).alias("violation"))


def check_declarations(folders: DataFrame, peers: DataFrame) -> DataFrame:
    """node, id, violation. ``folders``: node, id, name, path, conflict, versioning; ``peers``: node, id, name, addresses,
    fingerprint."""
    of_folders = _violations(
        folders,
        {
            "missing folder id": _blank("id"),
            "missing folder name": _blank("name"),
            "missing folder path": _blank("path"),
            "relative path": ~_blank("path") & ~F.col("path").startswith("/"),
            "path outside the share": F.col("path").startswith("/") & ~F.col("path").startswith(PREFIX),
            "unknown conflict policy": ~F.coalesce("conflict", F.lit("")).isin(*POLICIES),
            "unknown versioning type": ~F.coalesce("versioning", F.lit("")).isin(*STRATEGIES),
        },
    )
    fingerprint = F.lower(F.regexp_replace(F.coalesce("fingerprint", F.lit("")), "[:\\s]", ""))
    none = F.coalesce(F.size("addresses"), F.lit(0)) <= 0
    of_peers = _violations(
        peers,
        {
            "missing peer id": _blank("id"),
            "missing peer name": _blank("name"),
            "no address": none,
            "empty address": ~none & F.exists("addresses", lambda a: F.coalesce(F.btrim(a), F.lit("")) == ""),
            "malformed fingerprint": (fingerprint != "") & ~fingerprint.rlike("^[0-9a-f]{64}$"),
        },
    )
    return of_folders.unionByName(_twice(folders, "folder")).unionByName(of_peers).unionByName(_twice(peers, "peer"))


def effective_settings(folders: DataFrame) -> DataFrame:
    """Settings with their defaults: the guard's share and the days of the event log."""
    positive = lambda c, default: F.when(F.col(c) > 0, F.col(c)).otherwise(default).alias(c)
    rest = [c for c in folders.columns if c not in ("max_delete_pct", "archive_days")]
    return folders.select(*rest, positive("max_delete_pct", DELETE_PCT), positive("archive_days", DEFAULT_DAYS))
