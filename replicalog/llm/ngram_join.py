r"""Exact Jaccard self-join of word-shingle sets, and its connected components.

A document's set holds the 64-bit hashes of its distinct five-word shingles (A-Z lower-cased, words
``[^\x20\x09-\x0D]+``; with fewer words, the whole sequence is one). Two documents link when
100 * intersection >= 80 * union.

1. Every task hashes its documents' shingles and sends them, packed by range of hash, to where all documents'
   shingles of the range meet. Back comes, for each document, how many of its shingles no other document holds.
   Linked documents share one of their first n - ceil(0.8 n) + 1 shingles in any common order; taking the
   unshared ones first, a document with that many of them is linked with nothing. Most documents end here. (Hashes
   are cut to 48 bits for the count, and in their range to 32; a collision only keeps a document in play.)
2. Documents with equal sets are linked to the least of them, which alone stands for them from here on.
3. For the rest, each shingle's exact frequency among them is joined back, and each document hands out its prefix in
   order of frequency. Documents that share a shingle of their prefixes, and are connected by steps between set sizes that
   may link, fall into one block. Within a task each shingle's documents are reduced to a few ranges of sizes, so that a
   shingle costs few rows a task.
4. Blocks are cut into slices of about ``SLICE`` shingles; no group grows with a block. In a slice, the T-occurrence
   search of ``linked`` finds the links. A block of several slices goes on with one representative of each component that
   its slices have. Then only documents outside the block's largest component are still searched for in the other
   slices: a great group of near copies costs no pairs of slices.
5. Components of the links are found by joins. Nothing that grows with the documents reaches the driver.

A pair whose documents are connected already is not looked at again: components are all that ``joined``
returns, and copies are not expanded into pairs. ``pairs`` searches all slices and returns all links between different
sets, for those who want them.

Shingles are known by 64-bit hashes. What decides on a link are the two documents' own shingles: it would take a
collision between these few, not one in the corpus, to change it.

Defined cases: null or empty texts, and texts without words, have no shingles and are linked with nothing;
a row with null doc_id is linked with nothing and has a null component; rows sharing a doc_id each give
a row, and share their links; of a group's first document repeated rows are one; extra columns are carried
along or ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, hinted, let_go, stored
from .graph import components

WORDS = 5
PERCENT = 80
SLICE = 400_000
#: Shingles that a task gathers before it sorts them.
GATHER = 1_000_000
#: Ids that are broadcast at most; beyond it the texts, and the sets, are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Shingles of a bucket in which all documents' shingles of a range of hashes meet.
BUCKET = 2_000_000
#: So few candidates are probed at once, without a merge.
FEW = 8
#: DivideSkip's weight of a probe against a merge step.
MU = 0.05

_M = np.uint64(0x9E3779B97F4A7C15)
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, and powers of an odd number for its place in the word.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _M)
_POWERS = np.cumprod(np.full(256, 0xD6E8FEB86659FD93, np.uint64))


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, _POWERS[0], np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    a = np.frombuffer(data.lower(), np.uint8)
    inside = _NOT_SPACE[a]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    size = edges[1::2] - edges[::2]
    if not len(size):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    letters = a[inside]
    place = np.arange(len(letters)) - np.repeat(begin, size)
    return _mixed(np.add.reduceat(_BYTES[letters] * _powers(int(size.max()))[place], begin) + size.astype(np.uint64))


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = word_hashes(data)
    if not len(h):
        return np.zeros(0, np.int64)
    width = min(WORDS, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * _M + h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(out).view(np.int64))


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-n * PERCENT // 100)


def offsets_of(token: np.ndarray, width: int) -> np.ndarray:
    """Places of hashes in their ranges of ``width``, in order, cut to 32 bits: half as much to shuffle as whole ones."""
    return ((token % np.uint64(width)) >> np.uint64(max((width - 1).bit_length() - 32, 0))).astype(np.uint32)


def unshared(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n, s1 and s2 (128 bits that stand for the set), u (shingles that no other row holds), a row per row."""
    import pyspark

    shift = np.uint64(16)
    width = -(-(1 << 48) // buckets)
    schema = "bucket int, lot long, tokens binary, places binary, ids binary, n binary, s binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pyspark.TaskContext.get().partitionId()

        def flush(lot: int):
            token = np.concatenate(sets).view(np.uint64) >> shift
            place = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            order = np.argsort(token, kind="stable")
            token, place = token[order], place[order]
            cuts = np.searchsorted(token, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))
            offset = offsets_of(token, width)
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            tokens = [offset[cuts[k] : cuts[k + 1]].tobytes() for k in full]
            places = [place[cuts[k] : cuts[k + 1]].astype(np.uint16 if len(sets) < 1 << 16 else np.uint32).tobytes() for k in full]
            nothing = [None] * len(full)
            one = lambda values, kind: pa.array(values, kind)
            yield pa.record_batch([one(full, pa.int32()), one([lot] * len(full), pa.int64()), one(tokens, pa.binary()), one(places, pa.binary()), *(one(nothing, pa.binary()) for _ in range(3))], names)
            digest = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            known = np.array([(-1 if i is None else i, i is not None) for i in ids], dtype=np.int64)
            yield pa.record_batch([one([lot % buckets], pa.int32()), one([lot], pa.int64()), one([None], pa.binary()), one([None], pa.binary()), one([known.tobytes()], pa.binary()), one([np.array([len(s) for s in sets], np.int64).tobytes()], pa.binary()), one([digest], pa.binary())], names)

        sets, ids, size, lots = [], [], 0, 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sets.append(shingles(t.as_py() or b""))
                ids.append(i)
                size += len(sets[-1])
                if size >= GATHER:
                    yield from flush((part << 24) + lots)
                    sets, ids, size, lots = [], [], 0, lots + 1
        if sets:
            yield from flush((part << 24) + lots)
        let_go()

    def counted(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Of one bucket: how many of a document's shingles stand alone, for each lot."""
        token = [np.frombuffer(r["tokens"], np.uint32) for r in rows]
        # The lot's places are as wide as its count of documents needs.
        place = [np.frombuffer(r["places"], np.uint16 if len(r["places"]) == 2 * len(t) else np.uint32).astype(np.int64) for r, t in zip(rows, token, strict=True)]
        start = np.cumsum([0, *(int(p.max()) + 1 for p in place)])
        all_ = np.concatenate(token)
        order = np.argsort(all_, kind="stable")
        all_ = all_[order]
        owner = np.concatenate([p + s for p, s in zip(place, start, strict=False)])[order]
        edge = np.concatenate([[True], all_[1:] != all_[:-1], [True]])
        alone = edge[:-1] & edge[1:]
        counts = np.bincount(owner[alone], minlength=start[-1]).astype(np.uint32)
        for k, r in enumerate(rows):
            yield pa.RecordBatch.from_pylist([r | {"tokens": None, "places": counts[start[k] : start[k + 1]].tobytes()}], out_schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of their bucket: one bucket is held at a time.
        met: list[dict] = []
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                if r["tokens"] is None:
                    yield pa.RecordBatch.from_pylist([r], out_schema)
                    continue
                if met and met[0]["bucket"] != r["bucket"]:
                    yield from counted(met)
                    met = []
                met.append(r)
        if met:
            yield from counted(met)

    def total(t: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x.as_py(), np.uint32) for x in t.column("places") if x.is_valid]
        at = next(k for k, x in enumerate(t.column("ids")) if x.is_valid)
        known = np.frombuffer(t.column("ids")[at].as_py(), np.int64).reshape(-1, 2)
        u = np.zeros(len(known), np.int64)
        for c in counts:
            u[: len(c)] += c
        s = np.frombuffer(t.column("s")[at].as_py(), np.int64).reshape(-1, 2)
        n = np.frombuffer(t.column("n")[at].as_py(), np.int64)
        return pa.table({"doc_id": pa.array(known[:, 0], pa.int64(), mask=known[:, 1] == 0), "n": n, "s1": s[:, 0], "s2": s[:, 1], "u": u})

    names = [c.split()[0] for c in schema.split(", ")]
    out_schema = pa.schema([("bucket", pa.int32()), ("lot", pa.int64()), *((c, pa.binary()) for c in names[2:])])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    sent = d.mapInArrow(send, schema).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, schema)
    return sent.groupBy("lot").applyInArrow(total, "doc_id long, n long, s1 long, s2 long, u long")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, s (the shingle set) of the documents in ``ids`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py() or b"") for t in b.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "s"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    d = d.join(broadcast_if_small(ids, MOST_BROADCAST), F.col("doc_id") == F.col("node"), "left_semi")
    return d.mapInArrow(run, "doc_id long, s array<long>").where(F.size("s") > 0)


def prefixes(sets: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), prefix: those of the first shingles, in order of frequency and then of hash, that are shared at all."""
    rows = sets.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1").withColumnRenamed("token", "key")
    met = rows.join(shared, F.col("token") == F.col("key")).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("docs", "token"))).alias("x"))
    # Shingles held once come first and take up places of the prefix, without being handed out.
    size = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.size("x"))
    return met.where(size > 0).select("doc_id", F.col("n").cast("long").alias("n"), F.transform(F.slice("x", F.lit(1), size.cast("int")), lambda y: y["token"]).alias("prefix"))


def _ranges(token: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of ranges of set sizes (low, high), each held by a document: for every token those merged between which a link's
    sizes may lie (token, low, high, a document), in order; and distinct edges from this document to the others."""
    order = np.lexsort((low, token))
    token, low, high, doc = token[order], low[order], high[order], doc[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    # The largest size so far of the same token.
    step = np.cumsum(new) << 40
    reach = np.maximum.accumulate(step + high) - step
    first = new.copy()
    first[1:] |= PERCENT * low[1:] > 100 * reach[:-1]
    start = np.flatnonzero(first)
    leader = np.repeat(doc[start], np.diff(np.append(start, len(token))))
    other = leader != doc
    edges = np.stack([leader[other], doc[other]], axis=1)
    return [token[start], low[start], np.maximum.reduceat(high, start), doc[start]], np.unique(edges, axis=0) if len(edges) else edges


def block_edges(heads: DataFrame) -> DataFrame:
    """a, b: edges that connect all documents that may link and share a shingle of their prefixes."""
    names = ["token", "low", "high", "a", "b"]
    rows = lambda *columns: pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)
    nothing = lambda n: [None] * n

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            n = np.concatenate(sizes)
            merged, edges = _ranges(np.concatenate(tokens), n, n, np.concatenate(docs))
            yield rows(*merged, nothing(len(merged[0])))
            yield rows(*(nothing(len(edges)) for _ in range(3)), edges[:, 0], edges[:, 1])

        tokens, docs, sizes, size = [], [], [], 0
        for b in batches:
            lists = b.column(2)
            many = np.diff(lists.offsets.to_numpy())
            tokens.append(lists.flatten().to_numpy())
            docs.append(np.repeat(b.column(0).to_numpy(), many))
            sizes.append(np.repeat(b.column(1).to_numpy(), many))
            size += len(tokens[-1])
            if size >= GATHER:
                yield from flush()
                tokens, docs, sizes, size = [], [], [], 0
        if size:
            yield from flush()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                now = [b.column(k).to_numpy() for k in range(4)]
                merged, edges = _ranges(*([np.concatenate([x, y]) for x, y in zip(last, now, strict=True)] if last else now))
                last = [c[-1:] for c in merged]
                yield pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    first = heads.select("doc_id", "n", "prefix").mapInArrow(local, "token long, low long, high long, a long, b long")
    first = stored(first, "shingle-heads")
    met = first.where("token IS NOT NULL").select("token", "low", "high", "a").repartition("token").sortWithinPartitions("token", "low").mapInArrow(across, "a long, b long")
    return first.where("token IS NULL").select("a", "b").unionByName(met)


class Forest:
    """Union-find over the documents of one group."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (r != (above := self.up[r])).any():
            r = above
        return r

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Pairs of places whose links connect all linked sets, or with ``every`` all links. With ``side``, only pairs of
    different sides count. Sets come in falling order of size.

    T-occurrence search: for each set, documents must occur T = ceil(0.8 n) times in the inverted lists of its
    shingles. The L longest lists are set apart (DivideSkip); the short ones are merged, documents with at least
    T - L occurrences stay, and the long lists are probed for them by binary search. Where all sets that may still
    link are few, they are probed at once.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    keys, ends = flat[first], np.append(first[1:], len(flat))
    forest, out = Forest(len(sets)), []
    for q, s in enumerate(sets):
        if side is not None and side[q]:
            continue
        open_ = (np.arange(len(sets)) > q) if side is None else side.astype(bool)
        open_ &= (100 * sizes >= PERCENT * len(s)) & (PERCENT * sizes <= 100 * len(s))
        if not every:
            open_ &= forest.roots(np.arange(len(sets))) != forest.root(q)
        left = np.flatnonzero(open_)
        if len(left) <= FEW:
            for y in left:
                n = int(np.isin(sets[y], s, assume_unique=True).sum())
                if 100 * n >= PERCENT * (len(s) + sizes[y] - n) and (forest.join(q, int(y)) or every):
                    out.append((q, int(y)))
            continue
        at = np.searchsorted(keys, s)
        length = (ends - first)[at]
        need = least_overlap(len(s))
        if (length > 1).sum() < need:
            continue
        long_ = min(need - 1, int(need / (MU * math.log2(max(int(length.max()), 2)) + 1)))
        by = at[np.argsort(length, kind="stable")]
        short, rest = by[: len(by) - long_], by[len(by) - long_ :]
        merged = np.concatenate([owner[first[k] : ends[k]] for k in short])
        if len(merged) * 4 > len(sets):
            counts = np.bincount(merged, minlength=len(sets))
            found = np.flatnonzero(counts >= max(need - long_, 1))
            counts = counts[found]
        else:
            found, counts = np.unique(merged, return_counts=True)
            found, counts = found[counts >= need - long_], counts[counts >= need - long_]
        found, counts = found[open_[found]], counts[open_[found]]
        for left, k in enumerate(rest[::-1] if len(found) else ()):
            reachable = counts + (len(rest) - left) >= need
            found, counts = found[reachable], counts[reachable]
            if not len(found):
                break
            docs = owner[first[k] : ends[k]]
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            counts = counts + (docs[place] == found)
        for y in found[100 * counts >= PERCENT * (len(s) + sizes[found] - counts)]:
            if forest.join(q, int(y)) or every:
                out.append((q, int(y)))
    return out


def searched(rows: DataFrame, every: bool = False) -> DataFrame:
    """a, b: links found in groups (block, i, j). ``rows``: doc_id, s, block, i, j, query (whether it is looked for; null
    where the whole group is searched in itself)."""

    def search(t: pa.Table) -> pa.Table:
        ids, query = t.column("doc_id").to_numpy(), t.column("query").to_pylist()
        found = [x.values.to_numpy() for x in t.column("s")]
        order = sorted(range(len(ids)), key=lambda k: (-len(found[k]), ids[k]))
        side = None if query[0] is None else np.array([not query[k] for k in order])
        pairs = linked([found[k] for k in order], side, every)
        a, b = [int(ids[order[x]]) for x, _ in pairs], [int(ids[order[y]]) for _, y in pairs]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("doc_id", "s", "block", "i", "j", "query").groupBy("block", "i", "j").applyInArrow(search, "a long, b long")


def _in_slices(rows: DataFrame) -> DataFrame:
    """Rows of searches inside slices. ``rows``: doc_id, s, block, own (slice)."""
    return rows.select("doc_id", "s", "block", F.col("own").alias("i"), F.col("own").alias("j"), F.lit(None).cast("boolean").alias("query"))


def _across_slices(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of searches for the documents of ``asked`` in the other slices of their blocks; both: doc_id, s, block, slices, own."""
    goals = checkpointed(asked.select("block", F.col("own").alias("j")).distinct())
    index = rows.join(broadcast_if_small(goals, MOST_BROADCAST), "block").where("own <> j").select("doc_id", "s", "block", F.col("own").alias("i"), "j", F.lit(False).alias("query"))
    others = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i")
    queries = asked.select("doc_id", "s", "block", "own", others).where("own <> i").select("doc_id", "s", "block", "i", F.col("own").alias("j"), F.lit(True).alias("query"))
    return index.unionByName(queries)


def links(sets: DataFrame, members: DataFrame, slice_size: int) -> DataFrame:
    """a, b: links that connect all documents of ``sets`` that links connect. ``members``: node, block, slices. Sets stay
    where they are until they meet in a slice: what says where they go is broadcast, up to a bound."""
    count = members.count()
    few = lambda d: hinted(d, count, MOST_BROADCAST)
    d = sets.join(few(members), F.col("doc_id") == F.col("node")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
    inside = checkpointed(searched(_in_slices(d)))
    several = d.where("slices > 1")
    if members.where("slices > 1").isEmpty():
        return inside
    # One representative of each component, the largest set, as far as a block's representatives fit into a slice.
    roots = lambda edges: several.select("doc_id", "block", F.size("s").alias("n")).join(few(components(edges)), F.col("doc_id") == F.col("node"), "left").select("doc_id", "block", "n", F.coalesce("root", "doc_id").alias("root"))
    heads = checkpointed(roots(inside).groupBy("block", "root").agg(F.max(F.struct("n", "doc_id")).alias("x")).select(F.col("block").alias("of"), F.col("x.doc_id").alias("head"), F.col("x.n").alias("n")))
    small = heads.groupBy("of").agg(F.sum("n").alias("total")).where(F.col("total") <= slice_size).select("of")
    some = several.join(few(heads.join(few(small), "of", "left_semi").select("head")), F.col("doc_id") == F.col("head"), "left_semi")
    between = checkpointed(searched(_in_slices(some.withColumn("own", F.lit(0)))))
    # What the largest component of a block does not hold is searched for in the other slices.
    known = checkpointed(roots(inside.unionByName(between)))
    largest = known.groupBy("block", "root").count().groupBy(F.col("block").alias("of")).agg(F.max(F.struct("count", "root")).alias("x")).select("of", F.col("x.root").alias("main"))
    rest = known.join(few(largest), (F.col("block") == F.col("of")) & (F.col("root") == F.col("main")), "left_anti").select(F.col("doc_id").alias("asked"))
    rest = checkpointed(rest)
    across = searched(_across_slices(several, several.join(few(rest), F.col("doc_id") == F.col("asked"), "left_semi")))
    return inside.unionByName(between).unionByName(across)


def _prepared(docs: DataFrame, slice_size: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A row per row with its counts; edges from representatives to equal sets; sets of the representatives that may
    link; their blocks and slices."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # A shingle to about six characters.
    chars = d.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // (6 * BUCKET))
    all_ = stored(unshared(d, buckets), "shingle-counts")
    known = all_.where("n > 0 AND doc_id IS NOT NULL")
    alike = checkpointed(known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("u").alias("u")))
    same = known.join(alike.where("copies > 1").drop("u"), ["s1", "s2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    open_ = checkpointed(alike.where(F.col("u") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100)).select(F.col("rep").alias("node")).distinct())
    sets = stored(sets_of(d, open_), "shingle-sets")
    blocks = components(block_edges(prefixes(sets)))
    sized = blocks.join(sets.select("doc_id", F.size("s").alias("n")), F.col("node") == F.col("doc_id"))
    weights = sized.groupBy(F.col("root").alias("block")).agg(F.ceil(F.sum("n") / slice_size).cast("int").alias("slices"))
    members = checkpointed(blocks.join(weights, F.col("root") == F.col("block")).select("node", "block", "slices"))
    return all_, same, sets, members


def pairs(docs: DataFrame, slice_size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """All links (a, b, with a < b) between representatives of equal sets, and membership: doc_id, rep."""
    all_, same, sets, members = _prepared(docs, slice_size)
    d = sets.join(broadcast_if_small(members, MOST_BROADCAST), F.col("doc_id") == F.col("node")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
    found = searched(_in_slices(d), every=True).unionByName(searched(_across_slices(d, d), every=True))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    rep = same.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("a"))
    return found, all_.select("doc_id").distinct().join(rep, F.col("doc_id") == F.col("of"), "left").select("doc_id", F.coalesce("a", "doc_id").alias("rep"))


def joined(docs: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """doc_id, n_shingles, component_id, a row per row of ``docs``."""
    all_, same, sets, members = _prepared(docs, slice_size)
    groups = components(links(sets, members, slice_size).unionByName(same))
    out = all_.select("doc_id", F.col("n").alias("n_shingles")).join(groups, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one of the least id, and of its repeated rows (equal in id and
    text) one. Rows with a null doc_id stay."""
    lost = checkpointed(joined(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__lost")).distinct())
    lost = broadcast_if_small(lost, MOST_BROADCAST)
    kept = docs.join(lost, docs["doc_id"] == lost["__lost"], "left_anti")
    again = checkpointed(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again"))
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again, MOST_BROADCAST)
    once, more = kept.join(again, kept["doc_id"] == again["__again"], "left_anti"), kept.join(again, kept["doc_id"] == again["__again"], "left_semi")
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))
