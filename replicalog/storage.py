"""Cuts of lineage in the folder that driver and executors share, and what becomes of them.

What is cut inside a ``scratch`` goes when that ends; all else when the driver's JVM does, as frames that read it live until then.

The folder is the session's ``spark.checkpoint.dir``. Only a local session may do without: it gets one of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: For each ``scratch`` that this thread has open, the innermost last: paths to delete and broadcasts to release.
_OPEN: ContextVar[tuple[tuple[list[str], list], ...]] = ContextVar("open", default=())


def _note(spark: SparkSession, path: str) -> None:
    if _OPEN.get():
        _OPEN.get()[-1][0].append(path)
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/replicalog-shared"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint()
    file = out._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        _note(df.sparkSession, file.get())
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    finally:
        _note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Between rounds of a loop: Spark drops broadcasts and shuffle files only once the driver's JVM finds that nothing reads them any more,
    and a driver whose rounds plan much and hold little does not look for long, and grows."""
    spark.sparkContext._jvm.System.gc()


def released_after(broadcast):
    """Notes a broadcast variable, whose copies on the executors go with the scratch it was made in."""
    if _OPEN.get():
        _OPEN.get()[-1][1].append(broadcast)
    return broadcast


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was stored and checkpointed inside, and releases broadcasts. Frames that depend on
    these must have been written by then, by a path of their own or under an outer scratch."""
    paths, broadcasts = [], []
    token = _OPEN.set((*_OPEN.get(), (paths, broadcasts)))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for b in broadcasts:
            b.unpersist()
        delete(spark, paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes files and folders of any store that Spark knows."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
