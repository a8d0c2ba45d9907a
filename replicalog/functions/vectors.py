"""Version vectors as map<string, bigint> columns: the key is a device id in unsigned decimal.

An absent key counts as 0. Comparisons are written with ``map_zip_with`` only, which stays
right inside other lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "CAST(map() AS map<string, bigint>)"


def _c(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(v, F.expr(EMPTY))


def _differences(a: Column | str, b: Column | str) -> Column:
    zipped = F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.map_values(zipped)


def dominates(a: Column | str, b: Column | str) -> Column:
    """a holds everything that b holds, and more."""
    d = _differences(a, b)
    return F.exists(d, lambda x: x > 0) & ~F.exists(d, lambda x: x < 0)


def compare(a: Column | str, b: Column | str) -> Column:
    """0 equal, 1 a is later, -1 b is later, 2 concurrent."""
    d = _differences(a, b)
    more, less = F.exists(d, lambda x: x > 0), F.exists(d, lambda x: x < 0)
    return F.when(more & less, 2).when(more, 1).when(less, -1).otherwise(0)


def equal(a: Column | str, b: Column | str) -> Column:
    return ~F.exists(_differences(a, b), lambda x: x != 0)


def concurrent(a: Column | str, b: Column | str) -> Column:
    return compare(a, b) == 2


def counter(v: Column | str, device: Column | str) -> Column:
    """The device's counter; ``device`` is a column, or a literal id."""
    device = F.lit(device) if isinstance(device, str) else device
    return F.coalesce(F.try_element_at(_c(v), device), F.lit(0).cast("long"))


def bump(v: Column | str, device: Column | str) -> Column:
    device = F.lit(device) if isinstance(device, str) else device
    others = F.map_filter(_c(v), lambda k, _: k != device)
    return F.map_concat(others, F.create_map(device, counter(v, device) + 1))


def merge(a: Column | str, b: Column | str) -> Column:
    """The larger counter of every device."""
    return F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("long"))


def _by_device(v: Column | str) -> Column:
    """Entries in numeric order of the device."""
    entry = F.transform(F.map_entries(_c(v)), lambda e: F.struct(e["key"].cast("decimal(20,0)").alias("d"), e["value"].alias("n")))
    return F.array_sort(entry)


def to_json(v: Column | str) -> Column:
    """Keys in numeric order, as text."""
    pairs = F.transform(_by_device(v), lambda e: F.concat(F.lit('"'), e["d"].cast("string"), F.lit('":'), e["n"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def from_json(text: Column | str) -> Column:
    return F.from_json(text, "map<string,bigint>")


def canonical(v: Column | str) -> Column:
    """``hexkey:hexcount|`` in numeric order; the tie-breaker of concurrent versions."""
    part = F.transform(_by_device(v), lambda e: F.concat(F.lower(F.conv(e["d"].cast("string"), 10, 16)), F.lit(":"), F.lower(F.hex(e["n"])), F.lit("|")))
    return F.array_join(part, "")


def device_id(fingerprint: Column | str) -> Column:
    """The first eight bytes, big-endian, in unsigned decimal; of fewer bytes those there are, of none 0."""
    b = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    start = F.hex(F.substring(b, 1, 8))
    return F.when(F.length(b) > 0, F.conv(start, 16, 10)).otherwise("0")


def last_writers(v: Column | str) -> Column:
    """Devices by falling counter, then by id: array of (device, n)."""
    rows = F.transform(F.map_entries(_c(v)), lambda e: F.struct((-e["value"]).alias("m"), e["key"].cast("decimal(20,0)").alias("d")))
    return F.transform(F.array_sort(rows), lambda e: F.struct(e["d"].cast("string").alias("device"), (-e["m"]).alias("n")))


def summary(v: Column | str, names: Column, self_id: str) -> tuple[Column, Column]:
    """Last writer and ``name (×n), …``. ``names``: map of device id to name."""
    writers = last_writers(v)

    def named(device: Column) -> Column:
        name = F.try_element_at(names, device)
        known = F.coalesce(name, F.concat(F.lit("device "), device))
        return F.when(device == self_id, F.concat(F.coalesce(name, F.lit("self")), F.lit(" (this server)"))).otherwise(known)

    last = F.when(F.size(writers) > 0, named(F.try_element_at(writers, F.lit(1))["device"])).otherwise("unknown")
    text = F.array_join(F.transform(writers, lambda w: F.concat(named(w["device"]), F.lit(" (×"), w["n"].cast("string"), F.lit(")"))), ", ")
    return last, text
