"""How far scans have come, from the progress that Spark reports of them while they run.

A scan that runs as a stream of slices of a listing has its rows observed: what Spark counts in each batch is told to a listener
on the driver, which adds it up to a row per folder. Nothing is counted a second time and no row passes the driver.
"""

from __future__ import annotations

import threading
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.status import last_run

RUNS = "folder string, started long, finished long, walked long, hash_total long, changed long, error string"
_PREFIX = "scan of "


def observed(changes: DataFrame, folder: str) -> DataFrame:
    """The stream, with its rows counted for ``ScanProgress``: all, files to hash, and changes. ``changes``: type, kind (null:
    unchanged)."""
    hashed = F.col("kind").isin("added", "modified") & (F.col("type") == 0)
    return changes.observe(f"{_PREFIX}{folder}", F.count(F.lit(1)).alias("walked"), F.count_if(hashed).alias("hash_total"), F.count("kind").alias("changed"))


class ScanProgress(StreamingQueryListener):
    """Add it to ``spark.streams`` before the scans start. A folder has the row of its last run, that of one in flight too."""

    def __init__(self) -> None:
        self.lock, self.runs, self.folders, self.begun = threading.Lock(), {}, {}, {}

    def onQueryStarted(self, event: Any) -> None:
        with self.lock:
            self.begun[str(event.runId)] = _seconds(event.timestamp)

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        with self.lock:
            for name, counts in p.observedMetrics.items():
                if not name.startswith(_PREFIX):
                    continue
                run, folder = str(p.runId), name[len(_PREFIX) :]
                if self.folders.get(folder) != run:
                    self.folders[folder] = run
                    self.runs[folder] = {"started": self.begun.get(run, _seconds(p.timestamp)), "finished": None, "walked": 0, "hash_total": 0, "changed": 0, "error": None}
                for k in ("walked", "hash_total", "changed"):
                    self.runs[folder][k] += counts[k] or 0

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        with self.lock:
            for folder, run in self.folders.items():
                if run == str(event.runId):
                    self.runs[folder] |= {"finished": int(datetime.now().timestamp()), "error": event.exception}

    def rows(self) -> list[tuple]:
        with self.lock:
            return [(f, *(r[k] for k in ("started", "finished", "walked", "hash_total", "changed", "error"))) for f, r in sorted(self.runs.items())]


def scan_runs(spark: SparkSession, progress: ScanProgress, folders: DataFrame) -> DataFrame:
    """RUNS of every folder (column folder), of those never scanned too; a row per folder."""
    return last_run(spark.createDataFrame(progress.rows(), RUNS), folders, "folder")


def _seconds(text: str) -> int:
    return int(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp())
