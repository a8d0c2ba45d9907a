import random

from pyspark.sql import functions as F

from replicalog.operators.cooldown import firings

TIMES = "folder string, path string, ts_s long, id long"


def plain(rows, cooldown):
    last, out = {}, set()
    for f, p, t, i in sorted(rows, key=lambda r: r[2]):
        if (f, p) not in last or t - last[f, p] >= cooldown:
            last[f, p] = t
            out.add(i)
    return out


def test_ranges_against_a_loop(spark):
    rng = random.Random(2)
    for cooldown, width, seconds in ((7, 10, 300), (50, 10, 2000), (10, 40, 5000)):
        rows, i = [], 0
        for key in [("f", "a"), ("f", None), ("g", "a"), ("g", "few")]:
            at = sorted(rng.sample(range(-seconds // 3, seconds), 12 if key[1] == "few" else seconds // rng.choice([2, 9])))
            # A long silence, too.
            for t in at:
                rows.append((*key, t + (seconds * 3 if t > seconds // 2 else 0), i := i + 1))
        d = spark.createDataFrame(rows, TIMES)
        got = firings(d, ["folder", "path"], cooldown, few=20, range_s=width)
        assert {r.id for r in got.collect()} == plain(rows, cooldown)


def test_a_million_events_a_second_apart(spark):
    """One condition without a pause: no task holds more than a range of it."""
    d = spark.range(1_000_000).selectExpr("'f' folder", "'p' path", "id + id div 7 ts_s", "id")
    got = firings(d, ["folder", "path"], 900)
    want, last = 0, None
    for i in range(1_000_000):
        t = i + i // 7
        if last is None or t - last >= 900:
            last, want = t, want + 1
    assert got.count() == want
    assert got.agg(F.max("ts_s")).first()[0] == last
