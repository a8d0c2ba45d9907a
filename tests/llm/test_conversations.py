import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from replicalog.llm import conversations as C
from replicalog.llm.oracles import CONVERSATIONS

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit) and the repaired rows, by plain strings. ``rows``: role, text, drop, unfinished."""
    states = {"": (0, "", ())}

    def better(to, key, value):
        if key not in to or value < to[key]:
            to[key] = value

    def inserted(states):
        for _ in range(4):
            for p, (c, a, out) in list(states.items()):
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if (p, letter) in NEXT:
                        better(states, NEXT[p, letter], (c + 3, a + "I", (*out, f"{name}:")))
        return states

    inserted(states)
    for role, text, drop, unfinished in rows:
        new, more = {}, 3 * unfinished
        for p, (c, a, out) in states.items():
            better(new, p, (c + 4, a + "D", out))
            if not drop:
                if (p, role[:1]) in NEXT:
                    better(new, NEXT[p, role[:1]], (c + more, a + "K", (*out, f"{role}:{text}")))
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if (p, letter) in NEXT:
                        better(new, NEXT[p, letter], (c + 3 + more, a + "R", (*out, f"{name}:{text}")))
        states = inserted(new)
    return min(states[p] for p in ("", "a") if p in states)


def repair(rows):
    r, out = C.Repair(), []
    for x in rows:
        out += r.feed(*x)
    cost, last = r.end()
    return cost, "".join(r.audit), tuple(f"{role}:{text}" for role, text, _ in out + last)


@pytest.mark.parametrize("every", [1, 2, 7, 256])
def test_repair_against_plain_strings(monkeypatch, every):
    monkeypatch.setattr(C, "SETTLE", every)
    rng = random.Random(every)
    for n in [*range(6), *[rng.randint(5, 60) for _ in range(150)]]:
        names = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", "", " "], ["user"], ["assistant", "system"]])
        rows = [(rng.choice(names), str(i), rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]
        assert repair(rows) == cheapest(rows)


def test_all_short_edit_sequences():
    """Against every sequence of edits, for few rows."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.random() < 0.3, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        best = None
        for n in range(len(rows) + 5):
            for edits in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in edits) != len(rows):
                    continue
                i, p, cost = 0, "", 0
                for e in edits:
                    role, _, drop, unfinished = ("", "", False, False) if e == "I" else rows[i]
                    i += e != "I"
                    if e == "D":
                        cost += 4
                        continue
                    due = "a" if p == "u" else "u"
                    letter = role[:1] if e == "K" else due
                    if drop or (p, letter) not in NEXT:
                        break
                    p, cost = NEXT[p, letter], cost + (0 if e == "K" else 3) + 3 * unfinished
                else:
                    if p in ("", "a") and (best is None or (cost, edits) < best):
                        best = (cost, edits)
        cost, audit, _ = repair(rows)
        assert (cost, tuple(audit)) == best


def test_memory_follows_what_is_undecided():
    r = C.Repair()
    for i in range(30_000):
        r.feed("user" if i % 3 else "assistant", "t", i % 5 == 0, i % 7 == 0)
        assert len(r.waiting) <= 2 * C.SETTLE
    assert max(n.depth for _, n in r.best.values()) <= 4 * C.SETTLE


def test_colliding_hashes_are_noticed(monkeypatch):
    monkeypatch.setattr(C, "PRIME", 3)
    rng = random.Random(5)
    for _ in range(80):
        rows = [(rng.choice(["user", "assistant", "system"]), str(i), rng.random() < 0.2, rng.random() < 0.3) for i in range(25)]
        assert repair(rows) == cheapest(rows)


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Hi?"), (1, 7, "assistant", "so"),
    (2, None, None, None), (2, None, "user", "a."), (2, 5, "user", ""), (2, 5, "user", " \n"), (2, 6, "assistant", "ok."), (2, 6, "assistant", "ok.\t"), (None, 1, "user", "x!"), (None, None, "assistant", "y"),
    (3, 3, "user", "same."), (3, 4, "assistant", "same."), (3, 4, "assistant", "same."), (3, 5, "user", "same."), (3, 9, "assistant", "same."), (3, None, "user", "same."), (4, 1, "zebra", "z."), (4, 2, "", "w."),
]


def fixture(spark):
    rows = ROWS + [(100 + i, k, random.Random(i * 9 + k).choice(["user", "assistant", "system"]), random.Random(i + k).choice(["a.", "b", "", "c!", "d."])) for i in range(60) for k in range(i % 9)]
    return spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, mark int, digest string")


def test_query_against_its_sql_on_odd_rows(spark):
    df = fixture(spark)
    want = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", want)
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    got = C.audits(C.damaged(df)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert key(got) == key(con.execute(CONVERSATIONS).fetchall())
    assert C.audits(C.damaged(df.limit(0))).collect() == []


def test_planned_damage(spark):
    got = {(r.conv_id, r.turn): [] for r in fixture(spark).collect()}
    for r in C.damaged(fixture(spark)).collect():
        got[r.conv_id, r.turn].append(r)
    blank = lambda x: " " if x is None else x
    for (conv, turn), rows in got.items():
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        before = [r for r in fixture(spark).where("true").collect() if (r.conv_id, r.turn) == (conv, turn)] if fault < 5 else None
        if before:
            assert len(rows) == len(before) * (2 if fault == 3 else 1)
            assert all(r.gone == (fault == 0) for r in rows)
            assert fault != 1 or all(r.text == "" for r in rows)
            assert fault != 2 or not any(c in r.text for r in rows for c in ".!?")
            assert fault != 4 or all(r.role == "user" for r in rows)


def test_repaired_rows_are_what_the_digest_says(spark):
    rows = C.damaged(fixture(spark))
    texts = {}
    for r in sorted(C.repaired(rows).collect(), key=lambda r: (str(r.conv_id), r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in C.audits(rows).collect():
        assert hashlib.sha256("\n".join(texts.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
