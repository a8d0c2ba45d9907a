"""The event log by days, and retention that drops days instead of reading them.

The log is Parquet by day of the event's time. A manifest says of every day its rows, how many are warnings that are still
open, and its files. Retention compares days with the cutoff: a day wholly before it goes by its manifest row, unless it has open
warnings, which stay; the day in which the cutoff lies is written anew; later days are neither read nor written. The
manifest of a change is a new small file, renamed into place last, so that readers see one state or the other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..storage import delete

DAY = 86400


@dataclass(frozen=True)
class Day:
    day: int
    path: str
    rows: int
    open: int


class DatedTable:
    """Rows by day of ``time``, a column of seconds. ``keeps``: rows that retention leaves (their number is in the manifest,
    as ``open``); without it none stay. The archive of files is such a table too, by the time of the file."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, time: str = "ts_s", keeps: Column | None = None):
        self.spark, self.root, self.time = spark, root.rstrip("/"), time
        self.schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.keeps = F.coalesce(keeps, F.lit(False)) if keeps is not None else F.lit(False)

    def _fs(self) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs()
        at = path(f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def days(self) -> list[Day]:
        """The parts of the table, several of a day if it was appended to."""
        known = self.versions()
        if not known:
            return []
        text = self.spark.read.text(f"{self.root}/manifest/{known[-1]:012d}.json", wholetext=True).first()[0]
        return [Day(**d) for d in json.loads(text)]

    def _commit(self, days: list[Day]) -> None:
        path, fs = self._fs()
        number = max(self.versions(), default=-1) + 1
        draft, at = path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), path(f"{self.root}/manifest/{number:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps([asdict(d) for d in sorted(days, key=lambda d: (d.day, d.path))]).encode()))
        out.close()
        if not fs.rename(draft, at):
            raise OSError(f"the manifest {at.toString()} could not be put in place")

    def _written(self, rows: DataFrame) -> list[Day]:
        to = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names, F.floor(F.col(self.time) / DAY).cast("int").alias("day")).repartition("day").sortWithinPartitions(self.time).write.partitionBy("day").parquet(f"{self.root}/{to}")
        read = self.spark.read.schema(StructType([*self.schema.fields, *_parse_datatype_string("day int").fields])).parquet(f"{self.root}/{to}")
        sums = read.groupBy("day").agg(F.count("*").alias("rows"), F.count_if(self.keeps).alias("open")).collect()
        return [Day(x["day"], f"{to}/day={x['day']}", x["rows"], x["open"]) for x in sums]

    def append(self, rows: DataFrame) -> None:
        self._commit(self.days() + self._written(rows))

    def _of(self, days: list[Day]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{d.path}" for d in days]) if days else self.spark.createDataFrame([], self.schema)

    def read(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """Rows of a span of time, by whole seconds; days outside it are not opened."""
        days = [d for d in self.days() if (since is None or (d.day + 1) * DAY > since) and (until is None or d.day * DAY < until)]
        out = self._of(days)
        out = out if since is None else out.where(F.col(self.time) >= since)
        return out if until is None else out.where(F.col(self.time) < until)

    def to_read(self, cutoff: int) -> list[Day]:
        """The days that ``drop_before`` has to open: that of the cutoff, and earlier ones with rows that stay."""
        return [d for d in self.days() if d.day * DAY < cutoff and ((d.day + 1) * DAY > cutoff or 0 < d.open < d.rows)]

    def drop_before(self, cutoff: int, everything: bool = False) -> dict[str, int]:
        """Takes away rows before the cutoff but those that stay (with ``everything`` these too). Returns deleted, kept."""
        days, opened = self.days(), self.to_read(cutoff)
        whole = [d for d in days if (d.day + 1) * DAY <= cutoff]
        if everything:
            opened = [d for d in opened if d not in whole]
        gone = [d for d in whole if d not in opened and (everything or d.open == 0)]
        before = sum(d.rows for d in days)
        stays = F.col(self.time) >= cutoff if everything else (F.col(self.time) >= cutoff) | self.keeps
        made = self._written(self._of(opened).where(stays)) if opened else []
        left = [d for d in days if d not in gone and d not in opened] + made
        if gone or opened:
            self._commit(left)
        kept = sum(d.open for d in left if (d.day + 1) * DAY <= cutoff)
        # Of the day of the cutoff only a look at its rows tells which are before it.
        border = [d for d in left if d.day * DAY < cutoff < (d.day + 1) * DAY]
        if border and not everything:
            kept += self._of(border).where(F.col(self.time) < cutoff).count()
        return {"deleted": before - sum(d.rows for d in left), "kept": kept}

    def vacuum(self, keep: int = 2) -> None:
        """Deletes old manifests, and files that only these name."""
        versions = self.versions()
        old = versions[:-keep]
        if not old:
            return
        named = lambda v: {d["path"] for d in json.loads(self.spark.read.text(f"{self.root}/manifest/{v:012d}.json", wholetext=True).first()[0])}
        alive = set().union(*map(named, versions[-keep:]))
        dead = set().union(*map(named, old)) - alive
        delete(self.spark, [f"{self.root}/{p}" for p in sorted(dead)] + [f"{self.root}/manifest/{v:012d}.json" for v in old])
