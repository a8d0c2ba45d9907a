"""A walk through a folder that enters no ignored directory and survives what it cannot read.

Directories are walked level by level. A task reads the names of a directory as a stream, in slices; the entries are then
dealt out to all tasks, each of which asks the store about its own, so that one huge directory is many tasks' work. The
rules are evaluated on every level: what is below an ignored or reserved directory is never asked for.

What is gone by the time it is looked at is left out, alone. Anything else that goes wrong is a row of ``errors``; the folder
is then incomplete, and nothing may be taken for deleted. A root that is not there is such an error, so that a store
that isn't mounted does not read as a deletion of all.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_reserved
from ..functions.rules import RULE, ignore_match
from ..storage import checkpointed

#: Entries that a task holds at once.
SLICE = 4096
#: What is found: the whole path, and either the entry or what went wrong with it.
FOUND = "at string, type int, size long, modified_s long, modified_ns int, mode int, error string"
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
_SCHEMA = pa.schema([(c.split()[0], kind) for c, kind in zip(FOUND.split(", "), _KINDS, strict=True)])


@dataclass(frozen=True)
class Walk:
    """``entries``: folder, name, type, size, modified_s, modified_ns, mode, ignored, rule. ``errors``: folder, name, error."""

    entries: DataFrame
    errors: DataFrame

    def incomplete(self) -> DataFrame:
        """The folders of which something could not be read."""
        return self.errors.select("folder").distinct()


def _failed(at: str, e: Exception) -> tuple:
    return (at, None, None, None, None, None, f"{type(e).__name__}: {getattr(e, 'strerror', None) or e}")


def _utf8(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def names_in(at: str, top: bool) -> Iterator[tuple]:
    """FOUND of what lies in one directory. Of a local one only names and whether they are files, directories or links
    are known as yet: ``asked`` adds the rest."""
    if not at.startswith("/"):
        yield from _remote(at, top)
        return
    try:
        with os.scandir(at) as found:
            for e in found:
                if not _utf8(e.path):
                    yield (e.path.encode(errors="surrogateescape").decode(errors="replace"), None, None, None, None, None, "the name is not UTF-8")
                    continue
                try:
                    yield (e.path, 2 if e.is_symlink() else 1 if e.is_dir(follow_symlinks=False) else 0, None, None, None, None, None)
                except FileNotFoundError:
                    continue
                except OSError as error:
                    yield _failed(e.path, error)
    except FileNotFoundError as error:
        if top:
            yield _failed(at, error)
    except OSError as error:
        yield _failed(at, error)


def asked(row: tuple) -> tuple | None:
    """The row with size, time and mode of a local entry; None if it is gone."""
    at, kind, size, *_, error = row
    if error is not None or size is not None or not at.startswith("/"):
        return row
    try:
        x = os.stat(at, follow_symlinks=False)
    except FileNotFoundError:
        return None
    except OSError as e:
        return _failed(at, e)
    kind = 2 if stat.S_ISLNK(x.st_mode) else 1 if stat.S_ISDIR(x.st_mode) else 0
    time = x.st_mtime_ns if kind == 0 else 0
    return (at, kind, x.st_size if kind == 0 else 0, time // 10**9, time % 10**9, stat.S_IMODE(x.st_mode), None)


def _remote(at: str, top: bool) -> Iterator[tuple]:
    """Entries of a directory in a store that pyarrow knows, whole."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(at.replace("s3a://", "s3://", 1))
    scheme = at.split("://")[0]
    try:
        for e in store.get_file_info(fs.FileSelector(path, allow_not_found=not top)):
            file = e.type == fs.FileType.File
            time = e.mtime_ns or 0 if file else 0
            whole = f"{scheme}://{e.path}" if not e.path.startswith("/") else f"{at[: len(at) - len(path)]}{e.path}"
            yield (whole, 0 if file else 1, e.size or 0 if file else 0, time // 10**9, time % 10**9, None, None)
    except OSError as error:
        yield _failed(at, error)


def _sliced(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, SLICE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), _KINDS, strict=True)], schema=_SCHEMA)


def _mapped(df: DataFrame, rows_of: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sliced(rows_of(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)))

    return df.mapInArrow(run, FOUND)


def bare_path(root: str) -> str:
    """The root without its final slash, and without a scheme if it is local."""
    return root.removeprefix("file://" if root.startswith("file://") else "file:").rstrip("/") or "/"


def walk(spark: SparkSession, root: str, folder: str, rules: DataFrame | None = None, reserved: bool = False) -> Walk:
    """All files, directories and links below a root, empty ones too; contents are not read and links not followed.

    ``rules``: what ``compile_rules`` gives. Ignored entries are listed, marked; nothing below an ignored directory is.
    Reserved names are left out with what is below them, unless ``reserved``. Times of directories and links are
    left out; modes and links are known of local file systems only. A store that pyarrow does not know is an error.
    """
    top = bare_path(root)
    own = rules.where(F.col("folder") == folder).select("rules").first() if rules is not None else None
    # One folder's rules are few: they go into the plan.
    kept = F.lit(None).cast(RULE) if own is None else F.from_json(F.lit(_json(own["rules"])), RULE)
    level, found, first = spark.createDataFrame([(top,)], "at string"), [], True
    # A number, as rows that are small on the wire stand for much work: they are not to be put together again.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        names = _mapped(level.select("at").repartition(tasks, "at"), lambda rows, first=first: (x for (at,) in rows for x in names_in(at, first)))
        here = _mapped(names.repartition(tasks, "at"), lambda rows: filter(None, map(asked, rows)))
        name = F.substring("at", len(top.rstrip("/")) + 2, 1 << 30)
        here = here.withColumn("name", name).withColumn("m", F.when(F.col("error").isNull(), ignore_match(F.col("name"), F.col("type") == 1, kept)))
        here = here.select("*", F.coalesce("m.ignored", F.lit(False)).alias("ignored"), F.when(F.col("m.ignored"), F.col("m.rule")).alias("rule")).drop("m")
        if not reserved:
            here = here.where(~is_reserved("name"))
        here = checkpointed(here)
        found.append(here)
        level, first = here.where("type = 1 AND NOT ignored"), False
        if level.isEmpty():
            break
    d = reduce(DataFrame.unionByName, found).withColumn("folder", F.lit(folder))
    return Walk(d.where("error IS NULL").select("folder", "name", *_SCHEMA.names[1:-1], "ignored", "rule"), d.where("error IS NOT NULL").select("folder", "name", "error"))


def _json(rules: list) -> str:
    import json

    return json.dumps([r.asDict() for r in rules])
