"""Content fingerprints: block sizes, block hashes and keys of whole contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block sizes are powers of two between these, for at most so many blocks.
SMALLEST, LARGEST, MOST_BLOCKS = 128 << 10, 16 << 20, 2000
HASH_BYTES = 32


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def block_size(size: Column | str) -> Column:
    """The smallest block size that needs no more than MOST_BLOCKS blocks; of nothing, the smallest."""
    out, step = F.when(_c(size) <= SMALLEST * MOST_BLOCKS, SMALLEST), SMALLEST * 2
    while step < LARGEST:
        out, step = out.when(_c(size) <= step * MOST_BLOCKS, step), step * 2
    return out.otherwise(LARGEST)


def block_range(size: Column | str, block: Column | str, idx: Column | str) -> tuple[Column, Column]:
    """Offset and length of a block; 0 bytes past the end."""
    step = F.when(_c(block) <= 0, F.lit(SMALLEST)).otherwise(_c(block)).cast("long")
    offset = _c(idx).cast("long") * step
    return offset, F.least(step, F.greatest(_c(size) - offset, F.lit(0)))


def pieces(content: Column | str, block: Column | int) -> Column:
    """The content cut into blocks; nothing gives an empty array. Text is cut by characters, bytes by bytes."""
    c = _c(content)
    block = F.lit(block) if isinstance(block, int) else block
    last = F.ceil(F.length(c) / block).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.substring(c, (i * block + 1).cast("int"), block.cast("int")))
    return F.when(F.length(c) > 0, cut).otherwise(F.slice(F.array(c), 1, 0))


def block_hashes(content: Column | str, block: Column | int) -> Column:
    """SHA-256 of every block, in hex."""
    return F.transform(pieces(content, block), lambda p: F.sha2(p, 256))


def flatten(hashes: Column | str) -> Column:
    """One binary of all block hashes."""
    return F.unhex(F.array_join(_c(hashes), ""))


def unflatten(blob: Column | str) -> Column:
    """Block hashes in hex; a part at the end that is no whole hash is dropped."""
    b = _c(blob)
    n = F.floor(F.length(b) / HASH_BYTES).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.hex(F.substring(b, i * HASH_BYTES + 1, F.lit(HASH_BYTES)))))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def same_content(a: str, b: str) -> Column:
    """Type, size and blocks of two struct columns are equal."""
    return (F.col(f"{a}.type") == F.col(f"{b}.type")) & (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.blocks") == F.col(f"{b}.blocks"))


def same_key(a: str, b: str) -> Column:
    """The same of two struct columns that hold the content's key for its blocks."""
    return (F.col(f"{a}.type") == F.col(f"{b}.type")) & (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.content") == F.col(f"{b}.content"))


def content_key(size: Column | str, blocks: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", _c(size).cast("string"), F.array_join(_c(blocks), ",")), 256)


def content_hash(content: Column | str) -> Column:
    return F.sha2(_c(content), 256)


def preview(content: Column | str) -> Column:
    """The first 256 bytes as text if they are printable, else ``[binary] `` and the first 32 in hex."""
    head = F.substring(_c(content), 1, 256)
    plain = F.hex(head).rlike("^(?:0[9AD]|[2-9A-F][0-9A-F])*$")
    return F.when(plain, F.try_validate_utf8(head.cast("string"))).otherwise(F.concat(F.lit("[binary] "), F.lower(F.hex(F.substring(_c(content), 1, 32)))))
