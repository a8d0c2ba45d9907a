"""Names and paths: parts, conflict copies, reserved names, archive layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFLICT = ".sync-conflict"
RESERVED = ".sfx-"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slashed(name: Column | str) -> Column:
    return F.replace(_c(name), F.lit("\\"), F.lit("/"))


def basename(name: Column | str) -> Column:
    return F.substring_index(_c(name), "/", -1)


def parent(name: Column | str) -> Column:
    """The directory that holds it; ``.`` at the root."""
    return F.when(F.instr(_c(name), "/") > 0, F.regexp_replace(_c(name), "/[^/]*$", "")).otherwise(".")


def ancestors(name: Column | str) -> Column:
    """Directories above it, the topmost first."""
    parts = F.split(_c(name), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))


def is_reserved(name: Column | str) -> Column:
    return _c(name).rlike(r"(^|/)\.sfx-")


def is_conflict_copy(name: Column | str) -> Column:
    return F.contains(_c(name), F.lit(CONFLICT))


def is_confined(name: Column | str) -> Column:
    """Relative, and never above its root."""
    parts = F.split(slashed(name), "/")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda a, p: (lambda at: F.struct(at.alias("at"), F.least(a["least"], at).alias("least")))(a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)),
    )
    return ~slashed(name).startswith("/") & (depth["least"] >= 0) & (_c(name) != "")


def extension(name: Column | str) -> Column:
    """From the last dot of the last component."""
    return F.regexp_extract(_c(name), r"(\.[^./]*)$", 1)


def conflict_name(name: Column | str, modified_s: Column | str, device: Column | str) -> Column:
    """name.sync-conflict-YYYYMMDD-HHMMSS-device.ext, in UTC."""
    ext = extension(name)
    stem = F.substring(_c(name), F.lit(1), F.length(_c(name)) - F.length(ext))
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(_c(modified_s)), F.current_timezone()), "yyyyMMdd-HHmmss")
    device = F.lit(device) if isinstance(device, str) else device
    return F.concat(stem, F.lit(CONFLICT + "-"), stamp, F.lit("-"), device, ext)


def conflict_stem(name: Column | str) -> Column:
    """The text before the last mark."""
    return F.regexp_extract(_c(name), r"^(.*)\.sync-conflict", 1)


def conflict_original(name: Column | str) -> Column:
    """The name of the file that a conflict copy belongs to."""
    tail = F.regexp_extract(_c(name), r"^.*\.sync-conflict(?:-\d{8}-\d{6}-\d+)?(\.[^./]*)?$", 1)
    return F.concat(conflict_stem(name), F.coalesce(tail, F.lit("")))


def temporary_name(path: Column | str) -> Column:
    return F.concat(F.lit(RESERVED), F.substring(F.sha2(_c(path), 256), 1, 16), F.lit(".part"))


def utc_day(seconds: Column) -> Column:
    """YYYY-MM-DD of seconds since 1970, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def archive_path(strategy: Column | str, path: Column | str, modified_s: Column | str, modified_ns: Column | str) -> Column:
    """Where an overwritten file goes: trashcan at its own path, simple below a stamp, staggered below day and stamp."""
    stamp = (_c(modified_s) * 1_000_000_000 + _c(modified_ns)).cast("string")
    return (
        F.when(_c(strategy) == "trashcan", _c(path))
        .when(_c(strategy) == "simple", F.concat_ws("/", _c(path), stamp))
        .when(_c(strategy) == "staggered", F.concat_ws("/", _c(path), utc_day(_c(modified_s)), stamp))
    )


def archived_original(strategy: Column | str, path: Column | str) -> Column:
    """The path that an archived version was kept for."""
    return F.when(_c(strategy) == "simple", F.regexp_replace(_c(path), "/[^/]*$", "")).when(_c(strategy) == "staggered", F.regexp_replace(_c(path), "/[^/]*/[^/]*$", "")).otherwise(_c(path))


def problem(error: Column | str) -> Column:
    """What an error text asks of its reader."""
    s = F.lower(_c(error))
    has = lambda *texts: F.lit(False) if not texts else s.rlike("|".join(texts))
    # Phrases and the reasons they stand for, tested in this order.
    return (
        F.when(has("used by another process", "being used by another", "text file busy", "device or resource busy"), "file is locked/in use — retrying")
        .when(has("no space left", "disk full", "enospc"), "disk full — space needed on the share")
        .when(has("permission denied"), "permission denied — check PUID/PGID ownership")
        .when(has("read-only file system", "erofs"), "share is read-only — check the SMB export / array mode")
        .when(has("hash mismatch", "bad transfer"), "transfer failed hash verification — will re-request")
        .otherwise(F.concat(F.lit("cannot apply: "), F.when(F.octet_length(s) <= 140, s).otherwise(F.make_valid_utf8(F.substring(s.cast("binary"), 1, 140).cast("string")))))
    )
