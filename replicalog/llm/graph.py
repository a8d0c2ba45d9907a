"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hinted, packed

#: Edges whose least neighbours are broadcast at most; beyond it they are joined by a shuffle.
MOST_BROADCAST = 100_000


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges``: a, b. Returns node, root (least node of its component) for every node that has an edge.
    ``rows``: how many edges there are at most, if that is known.

    Alternates two steps until all edges lead to roots: every node hands its larger neighbours
    to the least of its neighbours, then its smaller ones. Each round is checkpointed; rounds grow with the
    logarithm of the longest path, and their tasks with the edges. Only counts reach the driver.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpointed(e if rows is None else packed(e, rows))
    count = e.count() if rows is None else rows
    while True:
        # Stars: each node has one edge, and leads to one that has none. One look at the edges tells that, and their number.
        ends = e.selectExpr("stack(2, a, 1, 0, b, 0, 1) AS (v, out, into)")
        nodes = packed(ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into")), 2 * count)
        count, most, onward = nodes.agg(F.coalesce(F.sum("out"), F.lit(0)), F.max("out"), F.max(F.col("out") * F.col("into"))).first()
        tight, few = lambda d: packed(d, 2 * count), lambda d: hinted(d, count, MOST_BROADCAST, 2 * count)  # noqa: B023, E731
        if not count or (most == 1 and not onward):
            roots = tight(e.select(F.col("b").alias("node")).distinct()).select("node", F.col("node").alias("root"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        both = tight(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = tight(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        large = tight(tight(both.join(few(least), F.col("a") == F.col("n"))).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        least = tight(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        small = tight(large.join(few(least), F.col("a") == F.col("n")))
        e = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        e = checkpointed(tight(e))
