"""A catalog table in ranges of its key, of which a batch rewrites only what it touches.

Every range has a base, Parquet sorted by key with a Bloom filter on the name, and deltas: small files of later batches. A
batch adds deltas to the ranges that its keys fall into; a range is rewritten, and split if it has grown, once its deltas are
many or large. All other ranges keep their files. Readers merge deltas into the base of the ranges that have any.

What the table consists of is said by a manifest per batch, a small file that is renamed into place when all else has been
written: a batch that fails leaves the table as it was, and one that runs again finds its manifest and does nothing. The
manifest has a row per range with its rows and its largest sequence, so that look-ups by key and by sequence open few
files. A row per range is what the driver holds; a table of ten thousand million entries has some thousands.

Rows with a null in the key are kept like others: a null is the least value.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window as W

from ..storage import delete

#: Rows of a range; of its deltas before it is rewritten, as a share of the base, and their number.
RANGE_ROWS, DELTA_SHARE, MOST_DELTAS = 2_000_000, 0.1, 8
#: Rows of deltas that are broadcast when they are merged; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
ROW_GROUP_BYTES = 8 << 20


@dataclass
class Delta:
    path: str
    rows: int
    top: int


@dataclass
class Range:
    low: str
    base: str | None = None
    rows: int = 0
    top: int = 0
    deltas: list[Delta] = field(default_factory=list)


class RangeTable:
    """``schema`` of the rows, the columns of their key, and the one that says which changes are later."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, keys: tuple[str, ...] = ("folder", "replica", "name"), order: str = "sequence", range_rows: int = RANGE_ROWS):
        self.spark, self.root, self.keys, self.order, self.range_rows = spark, root.rstrip("/"), keys, order, range_rows
        self.schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    # The key as one text: its order is that of its parts, as no part holds a lower character than the one between them.
    def _key(self) -> Column:
        return F.concat_ws("\x00", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys])

    def _fs(self) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        path, fs = self._fs()
        at = path(f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def ranges(self, batch: int | None = None) -> list[Range]:
        """Those of the latest batch, or of the latest before ``batch``."""
        known = [b for b in self.batches() if batch is None or b < batch]
        if not known:
            return []
        _, fs = self._fs()
        rows = json.loads(self.spark.read.text(f"{self.root}/manifest/{known[-1]:012d}.json", wholetext=True).first()[0])
        return [Range(**r | {"deltas": [Delta(**d) for d in r["deltas"]]}) for r in rows]

    def _commit(self, batch: int, ranges: list[Range]) -> None:
        path, fs = self._fs()
        at = f"{self.root}/manifest/{batch:012d}.json"
        draft = path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps([asdict(r) for r in ranges]).encode()))
        out.close()
        if not fs.rename(draft, path(at)) and not fs.exists(path(at)):
            raise OSError(f"the manifest {at} could not be put in place")

    def _write(self, rows: DataFrame, to: str, parts: list[str]) -> None:
        name = self.keys[-1]
        w = rows.write.mode("overwrite").partitionBy(*parts).option("parquet.block.size", ROW_GROUP_BYTES)
        w.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", self.range_rows).parquet(f"{self.root}/{to}")

    def _files(self, paths: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _merged(self, ranges: list[Range], where: Column | None = None) -> DataFrame:
        """The rows of the ranges; ``where`` is pushed into the files, and must not tell rows of one key apart."""
        narrowed = lambda d: d if where is None else d.where(where)
        still = [r.base for r in ranges if r.base and not r.deltas]
        base = [r.base for r in ranges if r.base and r.deltas]
        paths = [d.path for r in ranges for d in r.deltas]
        parts = [narrowed(self._files(still))] if still else []
        if paths:
            # The batch is in the path: a later one wins.
            read = self.spark.read.schema(StructType([*self.schema.fields, *_parse_datatype_string("batch long, range int").fields])).option("basePath", f"{self.root}/delta")
            fresh = narrowed(read.parquet(*[f"{self.root}/{p}" for p in paths])).drop("range")
            newest = W.partitionBy(*self.keys).orderBy(F.desc("batch"))
            fresh = fresh.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "batch").select(self.schema.names)
            if base:
                gone = fresh.select(*[F.col(k).alias(f"__{k}") for k in self.keys])
                if sum(d.rows for r in ranges for d in r.deltas) <= BROADCAST_ROWS:
                    gone = F.broadcast(gone)
                parts.append(narrowed(self._files(base)).join(gone, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_anti"))
            parts.append(fresh)
        out = self._nothing() if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, batch: int | None = None) -> DataFrame:
        """The whole table, as it is or as it was before a batch."""
        return self._merged(self.ranges(batch))

    def get(self, *key: str) -> DataFrame:
        """The rows of one key: files of one range, of which Parquet's filters skip what does not hold it."""
        ranges = self.ranges()
        at = bisect_right([r.low for r in ranges], "\x00".join(key)) - 1
        match = F.lit(True)
        for k, v in zip(self.keys, key, strict=True):
            match = match & (F.col(k) == v)
        return self._merged(ranges[max(at, 0) : at + 1], match)

    def after(self, value: int) -> DataFrame:
        """Rows whose order is larger: only ranges that have any are opened, and of those without deltas only groups."""
        newer = F.col(self.order) > value
        found = [r for r in self.ranges() if max([r.top, *(d.top for d in r.deltas)]) > value]
        # A base that a delta may outdate is merged first, unless nothing in it is late enough.
        late = [r if r.top > value else Range(r.low, None, 0, 0, r.deltas) for r in found]
        plain = self._merged([r for r in late if not r.deltas], newer)
        return plain.unionByName(self._merged([r for r in late if r.deltas]).where(newer))

    def _placed(self, rows: DataFrame, lows: list[str]) -> DataFrame:
        @F.pandas_udf("int")
        def range_of(key: pd.Series) -> pd.Series:
            return key.map(lambda k: max(bisect_right(lows, k) - 1, 0)).astype("int32")

        return rows.withColumn("range", range_of(self._key()))

    def _summed(self, rows: DataFrame, by: list[str]) -> list:
        """A row per range (or part of one): rows, largest order, least key."""
        return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.max(self.order), F.lit(0)).alias("top"), F.min(self._key()).alias("low")).orderBy(*by).collect()

    def upsert(self, rows: DataFrame, batch: int, replaced: DataFrame | None = None) -> None:
        """Takes in the rows of a batch, which have one row a key; of ``replaced`` (some first columns of the key), what the table
        had goes. A batch that is there already changes nothing. Batches come in order of their number."""
        done = self.batches()
        if batch in done:
            return
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        ranges = self.ranges()
        rows = rows.select(self.schema.names)
        if not ranges:
            self._commit(batch, self._based(rows, [Range("")], [0], batch, rows.count()))
            return
        to = f"delta/batch={batch}"
        placed = self._placed(rows, [r.low for r in ranges])
        self._write(placed.repartition("range").sortWithinPartitions(*self.keys), to, ["range"])
        written = self.spark.read.schema(StructType([*self.schema.fields, *_parse_datatype_string("range int").fields])).parquet(f"{self.root}/{to}")
        for x in self._summed(written, ["range"]):
            ranges[x["range"]].deltas.append(Delta(f"{to}/range={x['range']}", x["rows"], x["top"]))
        gone = [tuple(r) for r in replaced.distinct().collect()] if replaced is not None else []
        touched = self._holding(ranges, gone)
        full = {k for k, r in enumerate(ranges) if len(r.deltas) > MOST_DELTAS or sum(d.rows for d in r.deltas) > max(DELTA_SHARE * r.rows, 0)}
        self._commit(batch, self._rewritten(ranges, sorted(touched | full), batch, replaced if touched else None))

    def _holding(self, ranges: list[Range], prefixes: list[tuple]) -> set[int]:
        """Ranges that may hold keys that begin like these. As many prefixes as a batch has full messages."""
        lows, out = [r.low for r in ranges], set()
        for p in prefixes:
            first = "\x00".join(p) + "\x00"
            out |= set(range(max(bisect_right(lows, first) - 1, 0), bisect_right(lows, first[:-1] + "\x01")))
        return out

    def _rewritten(self, ranges: list[Range], which: list[int], batch: int, replaced: DataFrame | None) -> list[Range]:
        """The ranges, those of ``which`` with a base anew. Each is sorted into as many parts as its rows ask for."""
        if not which:
            return ranges
        if replaced is None:
            d = self._merged([ranges[k] for k in which])
        else:
            on = replaced.columns
            last = f"delta/batch={batch}/"
            old = self._merged([Range(ranges[k].low, ranges[k].base, ranges[k].rows, ranges[k].top, [x for x in ranges[k].deltas if not x.path.startswith(last)]) for k in which])
            new = [x.path for k in which for x in ranges[k].deltas if x.path.startswith(last)]
            new = self._files(new) if new else self._nothing()
            old = old.join(F.broadcast(replaced.distinct()), on, "left_anti").join(new.select(*self.keys), list(self.keys), "left_anti")
            d = old.select(self.schema.names).unionByName(new)
        return self._based(d, ranges, which, batch, sum(ranges[k].rows + sum(x.rows for x in ranges[k].deltas) for k in which))

    def _based(self, d: DataFrame, ranges: list[Range], which: list[int], batch: int, rows: int) -> list[Range]:
        """Writes the bases of the ranges from all of their rows."""
        parts = -(-rows // self.range_rows) + len(which) - 1
        d = self._placed(d, [r.low for r in ranges]).repartitionByRange(max(parts, 1), "range", *self.keys).withColumn("part", F.spark_partition_id())
        to = f"base/{batch}-{uuid.uuid4().hex[:8]}"
        self._write(d.sortWithinPartitions("range", *self.keys), to, ["range", "part"])
        made: dict[int, list[Range]] = {k: [] for k in which}
        written = self.spark.read.schema(StructType([*self.schema.fields, *_parse_datatype_string("range int, part int").fields])).parquet(f"{self.root}/{to}")
        for x in self._summed(written, ["range", "part"]):
            own = made[x["range"]]
            own.append(Range(x["low"] if own else ranges[x["range"]].low, f"{to}/range={x['range']}/part={x['part']}", x["rows"], x["top"]))
        return [new for k, r in enumerate(ranges) for new in (made[k] or [Range(r.low)] if k in made else [r])]

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the last ``keep``, and files that none of these names."""
        batches = self.batches()
        old = batches[:-keep]
        if not old:
            return
        paths = lambda ranges: {p for r in ranges for p in [r.base, *(d.path for d in r.deltas)] if p}
        alive = set().union(*(paths(self.ranges(b + 1)) for b in batches[-keep:]))
        dead = set().union(*(paths(self.ranges(b + 1)) for b in old)) - alive
        delete(self.spark, [f"{self.root}/{p}" for p in sorted(dead)] + [f"{self.root}/manifest/{b:012d}.json" for b in old])
