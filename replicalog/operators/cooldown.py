"""Firings with a cooldown, in order of time: none within so many seconds of the last one of its key that fired.

When one fires depends on the last that did. A key with few times is folded as one array. A key with many is cut into ranges of
time, each at least as long as the cooldown. What a range does is a function from the last firing before it to the last
one up to its end, with few arguments: no firing that matters, or one of the times less than a cooldown before its first. Functions
of FAN neighbouring ranges are composed, FAN of these again and so on, and on the way back every range learns what comes
into it, so that no task sees more of a key than one range or FAN functions and the depth is the logarithm of their number.

A range holds one row a second at most, as of equal times only one can fire: that is the bound on what a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed

#: Times of a key that are folded as one array.
FEW = 5_000
#: Seconds of a range at least.
RANGE_S = 86_400
#: Functions that one task composes.
FAN = 32


def firings(times: DataFrame, keys: list[str], cooldown_s: int, few: int = FEW, range_s: int = RANGE_S) -> DataFrame:
    """The rows of ``times`` that fire: keys, ts_s, id. ``times`` has one row per key and second, with its id."""
    d = times.select(*keys, F.col("ts_s").cast("long").alias("ts_s"), "id")
    many = d.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > few).drop("n")
    many = checkpointed(many)
    if many.isEmpty():
        return _folded(d, keys, cooldown_s)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    many = many.select([F.col(k).alias(f"__{k}") for k in keys])
    return _folded(d.join(many, same, "left_anti"), keys, cooldown_s).unionByName(_scanned(d.join(many, same, "left_semi"), keys, cooldown_s, range_s))


def _folded(d: DataFrame, keys: list[str], cooldown_s: int) -> DataFrame:
    d = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts_s", "id"))).alias("all"))
    kind = "array<struct<ts_s: bigint, id: bigint>>"
    last = lambda a: F.element_at(a, -1)["ts_s"]
    fired = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), lambda a, x: F.when((F.size(a) == 0) | (x["ts_s"] - last(a) >= cooldown_s), F.array_append(a, x)).otherwise(a))
    return d.select(*keys, F.explode(fired).alias("x")).select(*keys, "x.ts_s", "x.id")


def _ends(times: np.ndarray, cooldown_s: int) -> np.ndarray:
    """For every time, the last firing of the range if that time fires: jumps are doubled until none leads on."""
    to = np.searchsorted(times, times + cooldown_s)
    to = np.where(to < len(times), to, np.arange(len(times)))
    while True:
        further = to[to]
        if (further == to).all():
            return times[to]
        to = further


def _scanned(d: DataFrame, keys: list[str], cooldown_s: int, range_s: int) -> DataFrame:
    width = max(range_s, cooldown_s)
    # Keys of any type stand behind one number.
    known = checkpointed(d.select(keys).distinct().withColumn("k", F.monotonically_increasing_id()))
    same = [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in keys]
    named = known.select("k", *[F.col(x).alias(f"__{x}") for x in keys])
    rows = checkpointed(d.join(named, same).select("k", F.floor(F.col("ts_s") / width).alias("r"), "ts_s", "id"))
    heads = rows.groupBy("k", "r").agg(F.min("ts_s").alias("head"))
    # Firings before a range that matter to it lie in the range just before.
    late = rows.select("k", (F.col("r") + 1).alias("r"), "ts_s").join(heads, ["k", "r"]).where(F.col("ts_s") + cooldown_s > F.col("head"))
    fed = rows.select("k", "r", "ts_s", F.lit(0).alias("entry")).unionByName(late.select("k", "r", "ts_s", F.lit(1).alias("entry")))

    def function(t: pa.Table) -> pa.Table:
        ts, entry = t.column("ts_s").to_numpy(), t.column("entry").to_numpy()
        own, before = np.sort(ts[entry == 0]), np.sort(ts[entry == 1])
        ends = _ends(own, cooldown_s)
        at = np.searchsorted(own, before + cooldown_s)
        out = np.where(at < len(own), ends[np.minimum(at, len(own) - 1)], before)
        n = len(before) + 1
        entries = pa.array([None, *before.tolist()], pa.int64())
        return pa.table({"k": pa.array([t.column("k")[0].as_py()] * n, pa.int64()), "r": pa.array([t.column("r")[0].as_py()] * n, pa.int64()), "head": pa.array([int(own[0])] * n, pa.int64()), "entry": entries, "out": pa.array([int(ends[0]), *out.tolist()], pa.int64())})

    lowest = rows.agg(F.min("r"), F.max("r")).first()
    level = checkpointed(fed.groupBy("k", "r").applyInArrow(function, "k long, r long, head long, entry long, out long").withColumn("r", F.col("r") - lowest[0]))
    levels, span = [], lowest[1] - lowest[0]
    while span > 0:
        levels.append(level)
        level, span = checkpointed(_composed(level, cooldown_s)), span // FAN
    inputs = level.select("k", "r", F.lit(None).cast("long").alias("entry")).distinct()
    for level in reversed(levels):
        inputs = _handed_down(level, inputs, cooldown_s)
    inputs = checkpointed(inputs)
    entries = inputs.where("entry IS NOT NULL").select("k", (F.col("r") + lowest[0]).alias("r"), F.col("entry").alias("ts_s"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("is_entry"))

    def fire(t: pa.Table) -> pa.Table:
        t = t.sort_by("ts_s")
        ts, entry = t.column("ts_s").to_numpy(), t.column("is_entry").to_numpy() == 1
        own, fired = np.flatnonzero(~entry), []
        times = ts[own]
        at = np.searchsorted(times, ts[entry][0] + cooldown_s) if entry.any() else 0
        while at < len(times):
            fired.append(own[at])
            at = np.searchsorted(times, times[at] + cooldown_s)
        return t.take(pa.array(fired, pa.int64())).select(["k", "ts_s", "id"])

    fired = rows.withColumn("is_entry", F.lit(0)).select("k", "r", "ts_s", F.col("id").cast("long").alias("id"), "is_entry").unionByName(entries)
    fired = fired.groupBy("k", "r").applyInArrow(fire, "k long, ts_s long, id long")
    return fired.join(known, "k").select(*keys, "ts_s", "id")


class _Functions:
    """Functions of neighbouring ranges, in their order."""

    def __init__(self, t: pa.Table, cooldown_s: int):
        # A null entry, that of no firing that matters, comes first.
        t = t.sort_by([("r", "ascending"), ("entry", "ascending")])
        r = t.column("r").to_numpy()
        starts = [*np.flatnonzero(np.diff(r, prepend=r[0] - 1)).tolist(), len(r)]
        entry, out, head = t.column("entry").fill_null(np.iinfo(np.int64).min).to_numpy(), t.column("out").to_numpy(), t.column("head").to_numpy()
        order = [np.argsort(entry[a:b], kind="stable") + a for a, b in zip(starts, starts[1:], strict=False)]
        self.r, self.head, self.cooldown_s = [int(r[o[0]]) for o in order], [int(head[o[0]]) for o in order], cooldown_s
        self.entries, self.outs = [entry[o] for o in order], [out[o] for o in order]

    def entry(self, n: int, last: np.ndarray) -> np.ndarray:
        """Of last firings, those that matter to the n-th range; others are as good as none."""
        return np.where(last + self.cooldown_s > self.head[n], last, self.entries[n][0])

    def out(self, n: int, entry: np.ndarray) -> np.ndarray:
        return self.outs[n][np.searchsorted(self.entries[n], entry)]


def _composed(level: DataFrame, cooldown_s: int) -> DataFrame:
    """One function of each FAN neighbours, with the arguments of the first."""

    def compose(t: pa.Table) -> pa.Table:
        f = _Functions(t, cooldown_s)
        last = f.outs[0]
        for n in range(1, len(f.r)):
            last = f.out(n, f.entry(n, last))
        size = len(last)
        entry = pa.array([None, *f.entries[0][1:].tolist()], pa.int64())
        return pa.table({"k": pa.array([t.column("k")[0].as_py()] * size, pa.int64()), "r": pa.array([f.r[0] // FAN] * size, pa.int64()), "head": pa.array([f.head[0]] * size, pa.int64()), "entry": entry, "out": pa.array(last, pa.int64())})

    return level.groupBy("k", F.floor(F.col("r") / FAN)).applyInArrow(compose, "k long, r long, head long, entry long, out long")


def _handed_down(level: DataFrame, inputs: DataFrame, cooldown_s: int) -> DataFrame:
    """What comes into each of FAN neighbours (k, r, entry), from what comes into them as a whole."""

    def hand_down(t: pa.Table) -> pa.Table:
        top = t.column("up").to_numpy() == 1
        f = _Functions(t.filter(pa.array(~top)), cooldown_s)
        first = t.column("entry").filter(pa.array(top))[0].as_py()
        now = np.array([f.entries[0][0] if first is None else first])
        found, last = [], now
        for n in range(len(f.r)):
            if n:
                now = f.entry(n, last)
            found.append(None if now[0] == f.entries[n][0] else int(now[0]))
            last = f.out(n, now)
        return pa.table({"k": pa.array([t.column("k")[0].as_py()] * len(found), pa.int64()), "r": pa.array(f.r, pa.int64()), "entry": pa.array(found, pa.int64())})

    rows = level.select("k", "r", "head", "entry", "out", F.floor(F.col("r") / FAN).alias("g"), F.lit(0).alias("up"))
    above = inputs.select("k", F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("head"), "entry", F.lit(0).cast("long").alias("out"), F.col("r").alias("g"), F.lit(1).alias("up"))
    return rows.unionByName(above).groupBy("k", "g").applyInArrow(hand_down, "k long, r long, entry long")
