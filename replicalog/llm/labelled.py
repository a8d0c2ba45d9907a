"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 1 by three."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, most_chars: int) -> DataFrame:
    """id, t, y: up to ``per_class`` labelled documents of each class, those of least hash, among documents that are
    there, not held out and not longer than ``most_chars``. The bound on rows and on text holds for any input. An id
    with several texts stands for the least of them, one with several labels for the largest."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    there = docs.select(F.col("doc_id").alias("doc"), F.length(text_of()).alias("size")).where(F.col("size") <= most_chars).select("doc").distinct()
    known = known.join(there, F.col("id") == F.col("doc"), "left_semi")
    best = None
    for y in (0, 1):
        few = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        best = few if best is None else best.unionByName(few)
    rows = docs.select(F.col("doc_id").alias("doc"), text_of().alias("t")).where(F.length("t") <= most_chars).join(F.broadcast(best), F.col("doc") == F.col("id"))
    return rows.groupBy("id", "y").agg(F.min("t").alias("t")).select("id", "t", "y")
