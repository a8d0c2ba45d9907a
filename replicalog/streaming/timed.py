"""Stateful streams whose state ends: timers open and close it, and what is settled is forgotten.

Each keeps a row of state per key that has something pending, and none for others. State lives in Spark's state store, of
which the RocksDB provider has to be set (``use_rocksdb``). Rows of one batch are taken in order of time; what is later than the
watermark is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import is_reserved
from ..operators.events import CONDITION, WARN, page_worthy

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: how long after its first change a batch is given on.
DEBOUNCE_MS = 250
#: Paths of a batch; beyond, the folder is to be scanned anew.
MOST_PATHS = 100_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Cooldown(StatefulProcessor):
    """When the condition last fired, until its cooldown is over."""

    def __init__(self, cooldown_s: int):
        self.cooldown_s = cooldown_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, before, ids = self.last.get()[0] if self.last.exists() else None, None, []
        before = last
        for t, i in pd.concat(list(rows)).sort_values(["ts_s", "id"])[["ts_s", "id"]].itertuples(index=False):
            if last is None or t - last >= self.cooldown_s:
                last = int(t)
                ids.append(int(i))
        if last != before:
            if before is not None:
                self.handle.deleteTimer((before + self.cooldown_s) * 1000)
            self.last.update((last,))
            self.handle.registerTimer((last + self.cooldown_s) * 1000)
        yield pd.DataFrame({"folder": [key[0]] * len(ids), "path": [key[1]] * len(ids), "category": [key[2]] * len(ids), "id": pd.Series(ids, dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # What comes now fires with or without it.
        self.last.clear()
        yield pd.DataFrame({"folder": pd.Series(dtype=str), "path": pd.Series(dtype=str), "category": pd.Series(dtype=str), "id": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def cooled_alerts(events: DataFrame, cooldown_s: int, late: str = "10 seconds") -> DataFrame:
    """Page-worthy events that fire. State of a condition goes once the watermark has passed its cooldown."""
    d = events.where(page_worthy()).select(*CONDITION, "id", "ts_s", F.timestamp_seconds("ts_s").alias("at")).withWatermark("at", late)
    return d.groupBy(*CONDITION).transformWithStateInPandas(_Cooldown(cooldown_s), "folder string, path string, category string, id long", "Append", "EventTime")


class _Debounce(StatefulProcessor):
    """The paths of a folder since the first change, until its batch is due."""

    def __init__(self, wait_ms: int, most: int):
        self.wait_ms, self.most = wait_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A list, so that a change is one write, whatever is pending: changes with their times, in the order of arrival.
        self.handle, self.pending = handle, handle.getListState("pending", "at long, path string")
        self.due = handle.getValueState("due", "at long")

    def _given(self, key: tuple, since: int, paths: set[str]) -> dict:
        over = len(paths) > self.most
        return {"folder": key[0], "since": pd.Timestamp(since, unit="us"), "paths": [] if over else sorted(paths), "rescan": over}

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["folder", "since", "paths", "rescan"])
        return out.astype({"folder": object, "since": "datetime64[us]", "paths": object, "rescan": bool})

    def _closed(self, key: tuple, changes: list[tuple[int, str]], until: int) -> tuple[list[dict], list[tuple[int, str]]]:
        """Batches that are due by then, and what stays pending. A batch holds what came less than the wait after its first."""
        out, at = [], 0
        while at < len(changes) and changes[at][0] + self.wait_ms * 1000 <= until:
            since, paths = changes[at][0], set()
            while at < len(changes) and changes[at][0] < since + self.wait_ms * 1000:
                paths.add(changes[at][1])
                at += 1
            out.append(self._given(key, since, paths))
        return out, changes[at:]

    def _keep(self, changes: list[tuple[int, str]]) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        if changes:
            # Timers count milliseconds; a batch is due when the next whole one is reached.
            due = -(-(changes[0][0] + self.wait_ms * 1000) // 1000)
            self.pending.put(changes)
            self.due.update((due,))
            self.handle.registerTimer(due)
        else:
            self.pending.clear()
            self.due.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(t), p) for t, p in pd.concat(list(rows))[["us", "path"]].itertuples(index=False)]
        old = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        out, rest = self._closed(key, sorted(set(old + new)), timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(rest)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = sorted(tuple(x) for x in self.pending.get()) if self.pending.exists() else []
        self.due.clear()
        # All that is due by now, not by this timer alone: one set in the past would wait for another batch.
        out, rest = self._closed(key, held, timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(rest)
        yield self._frame(out)

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, wait_ms: int = DEBOUNCE_MS, late: str = "10 seconds", most: int = MOST_PATHS) -> DataFrame:
    """``changes``: ts, folder, path. folder, since, paths, rescan: batches of distinct paths of a folder, each opened by its first
    change and given on ``wait_ms`` later, in event time. A batch of more than ``most`` paths gives no paths but asks for a
    scan. Reserved paths open none."""
    d = changes.where(~is_reserved("path")).select("folder", "path", F.unix_micros("ts").alias("us"), "ts").withWatermark("ts", late)
    return d.groupBy("folder").transformWithStateInPandas(_Debounce(wait_ms, most), "folder string, since timestamp, paths array<string>, rescan boolean", "Append", "EventTime")


class _OpenConditions(StatefulProcessor):
    """The events of a condition that are open or acknowledged, and what they say of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "id long", "resolution int, severity int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        facts = pd.concat(list(rows)).sort_values(["ts_s", "is_action", "number"])
        known = {k[0]: [v[0], v[1]] for k, v in self.events.iterator()} if self.events.exists() else {}
        before, opened = {k: tuple(v) for k, v in known.items()}, lambda: any(r == 0 and s >= WARN for r, s in known.values())
        was = opened()
        for number, kind, event, severity, resolution in facts[["number", "kind", "event", "severity", "resolution"]].itertuples(index=False):
            if kind == "recorded":
                for v in known.values():
                    v[0] = 0 if v[0] == 1 else v[0]
                if resolution in (0, 1):
                    known[int(number)] = [int(resolution), int(severity)]
                continue
            ids = list(known) if pd.isna(event) else [int(event)] if int(event) in known else []
            for i in ids:
                r, s = known[i]
                if kind == "acknowledge" and r == 0:
                    known[i][0] = 1
                elif kind == "reopen" and r == 1:
                    known[i][0] = 0
                elif kind in ("resolve", "auto_resolve") and (not pd.isna(event) and kind == "resolve" or pd.isna(event) and r == 0 and s >= WARN):
                    del known[i]
        for i in before.keys() - known.keys():
            self.events.removeKey((i,))
        for i, v in known.items():
            if before.get(i) != tuple(v):
                self.events.updateValue((i,), tuple(v))
        change = int(opened()) - int(was)
        yield pd.DataFrame({"folder": [key[0]], "change": [change]}).query("change != 0")

    def close(self) -> None:
        pass


def facts_of(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Events and actions as rows of one stream. An action on an event by id has the condition of that event."""
    e = events.select(*CONDITION, F.col("id").alias("number"), "ts_s", F.lit(0).alias("is_action"), F.lit("recorded").alias("kind"), F.lit(None).cast("long").alias("event"), "severity", "resolution")
    a = actions.select(*CONDITION, F.col("action_id").alias("number"), "ts_s", F.lit(1).alias("is_action"), "kind", F.col("id").alias("event"), F.lit(None).cast("int").alias("severity"), F.lit(None).cast("int").alias("resolution"))
    return e.unionByName(a)


def open_condition_changes(facts: DataFrame) -> DataFrame:
    """folder, change: +1 for a condition that opens, -1 for one that closes. A batch costs its own conditions; a condition
    whose events are all resolved has no state."""
    return facts.groupBy(*CONDITION).transformWithStateInPandas(_OpenConditions(), "folder string, change long", "Append", "None")


def keep_counts(table: Any) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over ``open_condition_changes``: folder, open_conditions in a ``Versions`` table, which has a row per
    folder. A batch that runs again is added to what was before it."""

    def run(batch: DataFrame, number: int) -> None:
        had = table.latest("folder string, open_conditions long", before=number)
        new = batch.select("folder", F.col("change").alias("open_conditions"))
        table.write(had.unionByName(new).groupBy("folder").agg(F.sum("open_conditions").alias("open_conditions")), number)

    return run


def busy_sessions(sessions: DataFrame, late: str = "1 hour") -> DataFrame:
    """``sessions``: folder, started, finished, as timestamps, each when it has ended. Overlapping ones are one interval:
    folder, started, finished, sessions. An interval is given once the watermark has passed it."""
    d = sessions.withWatermark("started", late)
    # A window as long as the session, and never empty: sessions that touch share an instant.
    width = F.greatest(F.unix_micros("finished") - F.unix_micros("started"), F.lit(0)) + 1
    window = F.session_window("started", F.concat(width.cast("string"), F.lit(" microseconds")))
    d = d.groupBy("folder", window.alias("w")).agg(F.max("finished").alias("finished"), F.count("*").alias("sessions"))
    return d.select("folder", F.col("w.start").alias("started"), "finished", "sessions")
