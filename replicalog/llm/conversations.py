"""Conversations repaired at least cost, with an audit of the edits.

A conversation is to read as an optional system turn and then pairs of user and assistant. A dynamic program over its
rows keeps, for each of the four places in that pattern, the cheapest edits so far and among equals those whose audit
is least by characters. Audits are nodes of a tree that share their prefixes; a node knows its depth, a rolling hash of
its audit and its ancestors at distances of powers of two, so that two audits are compared by searching for their longest
common prefix. Nodes are unique for their audit, which verifies every hash: equal hashes of distinct nodes are a collision,
and such audits are compared node by node.

Among edits of equal cost over the same rows no audit is a proper prefix of another, as whatever follows would
have to be insertions, which cost; hence the least prefix leads to the least audit.

Rows are shuffled by conversation, sorted, and read as a stream. What all four places agree on is settled, leaves the
tree, and lets its rows go; places that cannot win any more are dropped. So memory follows what is undecided and not the
conversation. Which rows repeat earlier ones is found before that, by keys of the conversation's id, role and digest of
the text that are counted in parallel, and comes to the stream as rows of its own.

A conversation is still one task's work, as its digest is one hash over all of its text; it is streamed, never gathered.

Defined cases: null roles and texts are one space, as are null ids and turns where they are hashed; null turns come
first; rows of one turn come by role, then by digest of the text, so equal ones are neighbours; repeated rows are
duplicates; a conversation without rows has nothing to repair; roles are told by their first character; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_CHARS = " \t\n\x0b\f\r"
#: The pattern's places and where a turn leads: 0 the start, 1 after a system turn, 2 after a user, 3 after an assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = {0: "u", 1: "u", 2: "a", 3: "u"}
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
ORDERLY = {"su", "ua", "au"}
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: What the start can save over later places in time to come: the system turn that only it may keep.
SAVES = 4
#: Rows after which what is settled leaves the tree.
SETTLE = 256
BASE, PRIME = 1_000_003, (1 << 61) - 1


class Node:
    """An audit: its last edit after the audit of its parent."""

    __slots__ = ("above", "children", "depth", "edit", "hash", "up")

    def __init__(self, above: Node | None = None, edit: str = ""):
        self.above, self.edit, self.children = above, edit, {}
        self.depth = above.depth + 1 if above else 0
        self.hash = (above.hash * BASE + ord(edit)) % PRIME if above else 0
        self.up: list[Node] = [above] if above else []
        while above and len(self.up) <= len(self.up[-1].up):
            self.up.append(self.up[-1].up[len(self.up) - 1])

    def then(self, edit: str) -> Node:
        found = self.children.get(edit)
        if found is None:
            found = self.children[edit] = Node(self, edit)
        return found

    def at(self, depth: int) -> Node:
        """The ancestor of that depth."""
        node = self
        while node.depth > depth:
            node = node.up[min((node.depth - depth).bit_length(), len(node.up)) - 1]
        return node

    def edits_since(self, top: Node) -> str:
        out, node = [], self
        while node is not top:
            out.append(node.edit)
            node = node.above
        return "".join(reversed(out))


def parted(x: Node, y: Node) -> tuple[Node, Node] | None:
    """The ancestors of two nodes of one depth just below their longest common prefix; None if they are the same."""
    if x.hash == y.hash:
        if x is y:
            return None
        return _parted_by_steps(x, y)
    a, b = x, y
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    return (a, b) if a.above is b.above else _parted_by_steps(x, y)


def _parted_by_steps(x: Node, y: Node) -> tuple[Node, Node]:
    while x.above is not y.above:
        x, y = x.above, y.above
    return x, y


def less(x: Node, y: Node) -> bool:
    """Whether the audit of x comes before that of y."""
    depth = min(x.depth, y.depth)
    found = parted(x.at(depth), y.at(depth))
    return x.depth < y.depth if found is None else found[0].edit < found[1].edit


def common(nodes: list[Node]) -> Node:
    """The longest audit that all begin with."""
    top = nodes[0]
    for n in nodes[1:]:
        depth = min(top.depth, n.depth)
        found = parted(top.at(depth), n.at(depth))
        top = top.at(depth) if found is None else found[0].above
    return top


class Repair:
    """One conversation, row by row. ``settled`` gets the rows of the repaired one: row or None, role, text, edit."""

    def __init__(self):
        self.root = Node()
        self.best: dict[int, tuple[int, Node]] = {0: (0, self.root)}
        self.waiting: deque[tuple[str, str]] = deque()
        self.place, self.fed, self.audit = 0, 0, []
        self.insert(self.best)

    def offer(self, to: dict[int, tuple[int, Node]], place: int, cost: int, node: Node) -> bool:
        had = to.get(place)
        if had is None or cost < had[0] or cost == had[0] and node is not had[1] and less(node, had[1]):
            to[place] = (cost, node)
            return True
        return False

    def insert(self, best: dict[int, tuple[int, Node]]) -> None:
        todo = list(best)
        while todo:
            place = todo.pop()
            cost, node = best[place]
            after = NEXT[place, DUE[place]]
            if self.offer(best, after, cost + INSERT, node.then("I")):
                todo.append(after)

    def feed(self, role: str, text: str, drop: bool, unfinished: bool) -> list[tuple[str, str, str]]:
        """Takes the next row; returns what is settled by now, if it is time to look."""
        more = UNFINISHED if unfinished else 0
        new: dict[int, tuple[int, Node]] = {}
        for place, (cost, node) in self.best.items():
            self.offer(new, place, cost + DELETE, node.then("D"))
            if not drop:
                if (place, role[:1]) in NEXT:
                    self.offer(new, NEXT[place, role[:1]], cost + more, node.then("K"))
                self.offer(new, NEXT[place, DUE[place]], cost + REROLE + more, node.then("R"))
        self.insert(new)
        # After an assistant the same turns are due as at the start or after the system turn.
        if 3 in new:
            for place, saves in ((0, SAVES), (1, 0)):
                if place in new and new[place][0] > new[3][0] + saves:
                    del new[place]
        self.best = new
        self.waiting.append((role, text))
        self.fed += 1
        return self.settle() if self.fed % SETTLE == 0 else []

    def settle(self) -> list[tuple[str, str, str]]:
        """Carries out what all places agree on, and plants the rest anew."""
        top = common([n for _, n in self.best.values()])
        done = top.edits_since(self.root)
        rest = {p: (c, n.edits_since(top)) for p, (c, n) in self.best.items()}
        self.root = Node()
        self.best = {}
        for p, (c, edits) in rest.items():
            node = self.root
            for e in edits:
                node = node.then(e)
            self.best[p] = (c, node)
        return self.carry_out(done)

    def carry_out(self, edits: str) -> list[tuple[str, str, str]]:
        self.audit.append(edits)
        out = []
        for e in edits:
            role, text = ("", "") if e == "I" else self.waiting.popleft()
            if e != "D":
                letter = role[:1] if e == "K" else DUE[self.place]
                self.place = NEXT[self.place, letter]
                out.append((role if e == "K" else NAMES[letter], text, e))
        return out

    def end(self) -> tuple[int, list[tuple[str, str, str]]]:
        """The cost, and what was not settled yet."""
        final: dict[int, tuple[int, Node]] = {}
        for place in ENDS:
            if place in self.best:
                self.offer(final, 0, *self.best[place])
        cost, node = final[0]
        return cost, self.carry_out(node.edits_since(self.root))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows with their planned faults. Dropped rows stay as rows that are gone, so
    that no conversation is lost."""
    d = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = d.withColumn("fault", F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(times).alias("again"))
    return d.drop("again")


def repeats(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest of rows whose role and text an earlier turn of the conversation has. Counted by keys
    in parallel; no text is shuffled."""
    seen = rows.where("NOT gone").select("conv_id", "turn", "role", "digest").distinct()
    # A null turn comes before all others.
    first = seen.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn"))).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return seen.join(first, same).where(~F.col("turn").eqNullSafe(F.col("first.turn"))).select("conv_id", "turn", "role", "digest")


def _stream(rows: DataFrame) -> DataFrame:
    """The rows of each conversation in order, within one partition; a row that says that what follows repeats an
    earlier turn (mark 0) stands before the rows (1), and those that are gone come last (2)."""
    rows = rows.withColumn("digest", F.when(~F.col("gone"), F.unhex(F.sha2("text", 256))))
    marks = repeats(rows).select("conv_id", "turn", "role", "digest", F.lit(0).alias("mark"), F.lit("").alias("text"))
    d = rows.select("conv_id", "turn", "role", "digest", F.when(F.col("gone"), 2).otherwise(1).alias("mark"), F.when(~F.col("gone"), F.col("text")).otherwise("").alias("text")).unionByName(marks)
    return d.repartition("conv_id").sortWithinPartitions("conv_id", F.col("mark") == 2, "turn", "role", "digest", "mark")


class _Account:
    """What one conversation comes to, fed in order."""

    def __init__(self):
        self.repair = Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.high = 0, None, None
        self.before, self.initial, self.marked = None, None, None

    def feed(self, turn: int | None, role: str, digest: bytes, mark: int, text: str) -> list[tuple[str, str, str]]:
        if mark == 2:
            return []
        here = (turn, role, digest)
        if mark == 0:
            self.marked = here
            return []
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ORDERLY
        self.initial = role[:1]
        bare = text.rstrip(SPACE_CHARS)
        again = here in (self.before, self.marked)
        self.before = here
        self.blank += not bare
        self.duplicate += bool(bare) and again
        unfinished = bool(bare) and not again and bare[-1] not in ".!?"
        self.truncated += unfinished
        return self.repair.feed(role, text, not bare or again, unfinished)

    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


def _run(rows: DataFrame, start, row, end, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Streams conversations through ``start() -> state``, ``row(id, account, state, settled rows) -> output rows`` and
    ``end(id, account, state, cost, last rows) -> output rows``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, account, state, out = object(), None, None, []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
            out.clear()
            return made

        for b in batches:
            for conv, turn, role, digest, mark, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if account is None or conv != now:
                    if account is not None:
                        out.extend(end(now, account, state, *account.repair.end()))
                    now, account, state = conv, _Account(), start()
                out.extend(row(now, account, state, account.feed(turn, role, digest, mark, text)))
                if len(out) >= 1000:
                    yield batch()
        if account is not None:
            out.extend(end(now, account, state, *account.repair.end()))
        yield batch()

    return _stream(rows).mapInArrow(run, schema)


def _id(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def audits(rows: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    ``rows``: conv_id, turn, role, text, gone."""

    def start() -> list:
        return [hashlib.sha256(), True]

    def add(state: list, settled: list[tuple[str, str, str]]) -> None:
        for role, text, _ in settled:
            state[0].update(f"{'' if state[1] else chr(10)}{role}:{text}".encode())
            state[1] = False

    def row(conv, account: _Account, state: list, settled: list) -> list:
        add(state, settled)
        return []

    def end(conv, x: _Account, state: list, cost: int, settled: list) -> list:
        add(state, settled)
        return [(conv, x.gaps(), x.blank, x.duplicate, x.truncated, x.illegal, cost, "".join(x.repair.audit), state[0].hexdigest())]

    name, kind = _id(rows)
    schema = f"conv_id {name}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _run(rows, start, row, end, schema, [kind, *[pa.int64()] * 6, pa.string(), pa.string()])


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, role, text, edit (K kept, R with another role, I inserted)."""

    def give(conv, account: _Account, state: list, settled: list) -> list:
        out = [(conv, state[0] + k, *x) for k, x in enumerate(settled)]
        state[0] += len(out)
        return out

    def end(conv, account: _Account, state: list, cost: int, settled: list) -> list:
        return give(conv, account, state, settled)

    name, kind = _id(rows)
    schema = f"conv_id {name}, place long, role string, text string, edit string"
    return _run(rows, lambda: [0], give, end, schema, [kind, pa.int64(), *[pa.string()] * 3])
