"""Streaming forms: debounced changes, event feeds, throttles with state, catalogs kept up to date.

Every form gives, over the same rows, what its batch twin gives. State here is a row per condition that ever fired, per open
problem, and per peer that is offline; ``timed`` has forms with timers, whose state ends. Late rows wait for the watermark. Sinks that replace data write whole new versions, so that a batch that runs twice does no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.paths import is_reserved
from ..operators import catalog as cat
from ..operators import diff, reconcile
from ..operators.events import CONDITION, Filter, auto_archive, count_open, page_worthy
from ..sources.ranges import RangeTable

DEBOUNCE = "250 milliseconds"
COOLDOWN_S = 900


def debounce(changes: DataFrame, width: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """``changes``: ts, folder, path. Batches of distinct paths by time window; none is dropped but reserved ones.

    Windows are aligned to the clock, where a first change would open one; both hold a path at most that long.
    """
    d = changes.where(~is_reserved("path")).withWatermark("ts", late)
    d = d.groupBy(F.window("ts", width), "folder").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return d.select("folder", F.col("window.start").alias("since"), "paths")


def event_feed(spark: SparkSession, path: str, schema: Any, f: Filter | None = None) -> DataFrame:
    """New events of a table of Parquet files, filtered."""
    return spark.readStream.schema(schema).parquet(path).where((f or Filter()).condition())


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts_s", "id"])


def throttle_alerts_stream(events: DataFrame, cooldown_s: int = COOLDOWN_S) -> DataFrame:
    """Page-worthy events that fire; the state of a condition is when it last did."""

    def fire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        ids = []
        for t, i in _ordered(frames)[["ts_s", "id"]].itertuples(index=False):
            if last is None or t - last >= cooldown_s:
                last = int(t)
                ids.append(int(i))
        state.update((last,))
        yield pd.DataFrame({"folder": key[0], "path": key[1], "category": key[2], "id": ids})

    d = events.where(page_worthy()).select(*CONDITION, "id", "ts_s")
    return d.groupBy(*CONDITION).applyInPandasWithState(fire, "folder string, path string, category string, id long", "last long", "append", GroupStateTimeout.NoTimeout)


def throttle_problems_stream(problems: DataFrame) -> DataFrame:
    """First failures and changes of reason; a null reason clears the problem and comes out as is_resolve."""

    def changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else ("",)
        rows = []
        for i, reason in _ordered(frames)[["id", "reason"]].itertuples(index=False):
            now = reason if isinstance(reason, str) else ""
            if now != last:
                rows.append((int(i), now or None, not now))
                last = now
        if last:
            state.update((last,))
        elif state.exists:
            state.remove()
        out = pd.DataFrame(rows, columns=["id", "reason", "is_resolve"])
        out.insert(0, "folder", key[0])
        out.insert(1, "path", key[1])
        yield out

    d = problems.select("folder", "path", "id", "ts_s", "reason")
    return d.groupBy("folder", "path").applyInPandasWithState(changed, "folder string, path string, id long, reason string, is_resolve boolean", "last string", "append", GroupStateTimeout.NoTimeout)


def peer_state_stream(attempts: DataFrame) -> DataFrame:
    """Failures in a row, the wait before the next attempt, and the change, if any, of every attempt."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, error = state.get if state.exists else (0, "")
        rows = []
        for i, ok, text in _ordered(frames)[["id", "ok", "error"]].itertuples(index=False):
            text = text if isinstance(text, str) else ""
            if ok:
                rows.append((int(i), 0, 0, "online" if failures else None))
                failures, error = 0, ""
            else:
                change = "offline" if not failures or text != error else None
                failures, error = failures + 1, text
                rows.append((int(i), failures, min(5 * 2 ** (min(failures, 30) - 1), 300), change))
        if failures:
            state.update((failures, error))
        elif state.exists:
            state.remove()
        out = pd.DataFrame(rows, columns=["id", "failures", "wait_s", "change"])
        out.insert(0, "peer", key[0])
        yield out

    d = attempts.select("peer", "id", F.col("ts").alias("ts_s"), "ok", "error")
    return d.groupBy("peer").applyInPandasWithState(run, "peer string, id long, failures long, wait_s long, change string", "failures long, error string", "append", GroupStateTimeout.NoTimeout)


class Versions:
    """A table as numbered folders of Parquet; the number is that of the batch that wrote it, so a rerun is harmless."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _paths(self) -> list[tuple[int, str]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        done = [s.getPath() for s in fs.listStatus(hadoop) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted((int(p.getName().split("=")[1]), p.toString()) for p in done if p.getName().startswith("v="))

    def latest(self, schema: Any, before: int | None = None) -> DataFrame:
        paths = [p for n, p in self._paths() if before is None or n < before]
        return self.spark.read.schema(schema).parquet(paths[-1]) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={batch}")


def latest_rows(batch: DataFrame) -> DataFrame:
    """Of message rows (with is_update) of one batch: the row of the largest sequence of every name. A full message
    lists all of its folder, so updates of no larger sequence than its own that it does not hold are out of date."""
    top = batch.where(~F.col("is_update")).groupBy("folder", "replica").agg(F.max("sequence").alias("__top"))
    rows = batch.join(top, ["folder", "replica"], "left").where("__top IS NULL OR NOT is_update OR sequence > __top").drop("__top")
    w = W.partitionBy(*cat.KEY).orderBy(F.desc("sequence"), F.desc("is_update"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def maintain_catalog(table: Versions, schema: Any) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over message rows (with is_update): full batches replace a folder's view, updates go in by name."""

    def put(batch: DataFrame, number: int) -> None:
        view = table.latest(schema, before=number)
        replaced = batch.where(~F.col("is_update")).select("folder", "replica").distinct()
        rows = latest_rows(batch).select(view.columns)
        table.write(reconcile.apply_index_batch(view.join(replaced, ["folder", "replica"], "left_anti"), rows, update=True), number)

    return put


def upsert_catalog(table: RangeTable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over message rows (with is_update), into a table of which only what the batch touches is written."""

    def put(batch: DataFrame, number: int) -> None:
        replaced = batch.where(~F.col("is_update")).select("folder", "replica")
        table.upsert(latest_rows(batch), number, replaced)

    return put


def scan_diff_stream(
    table: Versions, schema: Any, device: str, sink: Callable[[DataFrame, int], None], rules: DataFrame | None = None, incomplete: Callable[[int], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over listing snapshots: each is held against the catalog of the moment. ``rules`` are those of
    ``compile_rules``; ``incomplete`` names, for a batch, the folders whose listing failed."""

    def run(batch: DataFrame, number: int) -> None:
        failed = incomplete(number) if incomplete else None
        sink(diff.scan_diff(batch, table.latest(schema).where(F.col("replica") == device), rules, failed), number)

    return run


def open_conditions_stream(sink: Callable[[DataFrame, int], None], state: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over new events: the counts of open conditions in the folded state, for folders that changed."""

    def run(batch: DataFrame, number: int) -> None:
        changed = batch.select("folder").distinct()
        sink(count_open(state()).join(changed, "folder", "left_semi"), number)

    return run


def alert_sink(post: Callable[[str, str, str], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over ``alerts``: posts each from the executors."""

    def run(batch: DataFrame, number: int) -> None:
        batch.select("title", "message", "tags").foreach(lambda r: post(r["title"], r["message"], r["tags"]))

    return run


def retention_stream(store: Versions, schema: Any, days: int, now_s: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a daily availableNow job over new events: the log with them, less what its age takes away."""

    def run(batch: DataFrame, number: int) -> None:
        store.write(auto_archive(store.latest(schema, before=number).unionByName(batch), days, now_s()), number)

    return run
