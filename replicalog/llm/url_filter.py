"""URL filter: rules first, then a ratio of two character language models.

Two variable-order Markov models over characters, one of accepted and one of rejected URLs,
share one inventory of grams and are smoothed by Witten-Bell interpolation, so that a
gram's probability falls back on its suffix. A URL's score is the difference of the two
log-likelihoods over its length; the cut is calibrated on a held-out fifth of the labelled
URLs, so that ``ACCEPTED`` of the accepted ones among them pass. Labelled URLs are those that a rule decides, and hosts that hold a seed word. The
models read the host without its last label, and the path without its first segment: these the rules decide on, and no
URL shall be judged by a language or top-level domain that only the rules' examples share. A domain's own name is read.

Everything is a join or an aggregate. Grams are counted with map-side combining; every gram and
context that occurs stays in the inventory, at every size. Distinct windows are scored once, whatever
number of URLs share them. Grams of one length are broadcast up to a counted bound and joined by a
shuffle beyond it, with the same result.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and
score 0 (allow, as the cut is then at or below it, or block if calibration puts it above);
repeated rows give repeated results; extra columns are ignored; an empty table gives an
empty result; with one class unlabelled every undecided URL is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed

#: verdict, host, start of the path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A host that holds one of these is a rejected example, unless a rule allows it.
SEEDS = ("spam", "pills", "casino", "porn", "viagra", "warez")
#: Contexts of up to so many characters.
ORDER = 4
#: Grams of one length that are broadcast at most; beyond it they are joined by a shuffle.
MAX_GRAMS = 100_000
#: Windows that are broadcast at most; beyond it they are joined by a shuffle. A gram or window has ORDER + 1 characters and
#: a number: below 64 bytes, so that no broadcast holds more than 32 MB.
MAX_WINDOWS = 500_000
ALPHABET = 256
ACCEPTED = 0.95
AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (verdict of the longest rule that fits, or null)."""
    url = F.col("url").cast("string")
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    d = pages.select("page_id", url.alias("url"), rest.alias("rest"))
    d = d.select("page_id", "url", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), AZ, AZ.lower()).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))

    def fits(host: str, path: str) -> Column:
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)

    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = F.coalesce(*[F.when(fits(h, p), F.lit(h + p)) for _, h, p in longest])
    ruled = F.coalesce(*[F.when(fits(h, p), F.lit(v)) for v, h, p in longest])
    return d.select("*", rule.alias("rule"), ruled.alias("ruled"))


def _grams(text: Column, size: Column | int) -> Column:
    """The ``size`` characters that end at each place of the text; places before it hold ``^``."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i + ORDER + 1 - size, F.lit(size)))


def train(labelled: DataFrame) -> DataFrame | None:
    """``labelled``: m (text), label (1 accepted, 0 rejected), n (how often). Returns gram, size, d and e: the
    difference of the log-probabilities of its last character, and of the logs of its weights as a context."""
    counts = None
    for size in range(1, ORDER + 2):
        c = labelled.select(F.explode_outer(_grams(F.col("m"), size)).alias("gram"), "label", "n")
        c = c.groupBy("gram").agg(F.sum(F.col("label") * F.col("n")).alias("a"), F.sum((1 - F.col("label")) * F.col("n")).alias("r")).withColumn("size", F.lit(size))
        counts = c if counts is None else counts.unionByName(c)
    counts = checkpointed(counts)
    contexts = counts.groupBy(F.expr("left(gram, size - 1)").alias("ctx"), (F.col("size") - 1).alias("csize")).agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
    )
    g = counts.join(contexts, (F.expr("left(gram, size - 1)") == F.col("ctx")) & (F.col("size") - 1 == F.col("csize")))
    g = checkpointed(g.select("gram", "size", "a", "r", "na", "nr", "ta", "tr"))
    smooth = lambda n, total, kinds, lower: F.when(total > 0, (n + kinds * lower) / (total + kinds)).otherwise(lower)
    levels, below = [], None
    for size in range(1, ORDER + 2):
        level = g.where(F.col("size") == size)
        if below is None:
            level = level.withColumns({"pa": F.lit(1 / ALPHABET), "pr": F.lit(1 / ALPHABET)})
        else:
            level = level.join(below.select(F.col("gram").alias("suffix"), "pa", "pr"), F.expr("substring(gram, 2)") == F.col("suffix")).drop("suffix")
        level = level.select("gram", "size", smooth(F.col("a"), F.col("na"), F.col("ta"), F.col("pa")).alias("pa"), smooth(F.col("r"), F.col("nr"), F.col("tr"), F.col("pr")).alias("pr"))
        below = level = checkpointed(level)
        levels.append(level)
    model = reduce(DataFrame.unionByName, levels)
    weight = lambda total, kinds: F.when(total > 0, F.log(kinds / (total + kinds))).otherwise(0.0)
    context = contexts.select(F.col("ctx").alias("c"), "csize", (weight(F.col("na"), F.col("ta")) - weight(F.col("nr"), F.col("tr"))).alias("e"))
    # A run of ^ and the empty gram are contexts only.
    model = model.select("gram", "size", (F.log("pa") - F.log("pr")).alias("d")).join(context, F.col("gram") == F.col("c"), "full")
    model = model.select(F.coalesce("gram", "c").alias("gram"), F.coalesce("size", "csize").alias("size"), "d", F.coalesce("e", F.lit(0.0)).alias("e"))
    return checkpointed(model.where((F.col("e") != 0) | F.col("d").isNotNull()))


def _scored(texts: DataFrame, model: DataFrame) -> DataFrame:
    """m and score for distinct m. A window is a character with its longest context; the longest gram in the
    inventory that ends it gives its log-ratio, each longer context that is known adds its fall-back weight."""
    places = texts.select("m", F.explode_outer(_grams(F.col("m"), ORDER + 1)).alias("window"))
    w = places.select("window").distinct()
    sizes = {r["size"]: r["count"] for r in model.groupBy("size").count().collect()}
    for size in range(1, ORDER + 2):
        k = model.where((F.col("size") == size) & F.col("d").isNotNull()).select(F.col("gram").alias("g"), F.col("d").alias(f"d{size}"))
        k = F.broadcast(k) if sizes.get(size, 0) <= MAX_GRAMS else k
        w = w.join(k, F.expr(f"right(window, {size})") == F.col("g"), "left").drop("g")
    for size in range(ORDER + 1):
        k = model.where((F.col("size") == size) & (F.col("e") != 0)).select(F.col("gram").alias("g"), F.col("e").alias(f"e{size}"))
        k = F.broadcast(k) if sizes.get(size, 0) <= MAX_GRAMS else k
        w = w.join(k, F.expr(f"substring(window, {ORDER + 1 - size}, {size})") == F.col("g"), "left").drop("g")
    ratio = F.lit(0.0)
    for size in range(1, ORDER + 2):
        ratio = F.when(F.col(f"d{size}").isNotNull(), F.col(f"d{size}")).otherwise(ratio + F.coalesce(f"e{size - 1}", F.lit(0.0)))
    w = checkpointed(w.select("window", ratio.alias("ratio")))
    return places.join(broadcast_if_small(w, MAX_WINDOWS), "window").groupBy("m").agg((F.sum("ratio") / F.count("*")).alias("score"))


def _read() -> Column:
    """What the models see of a URL's host and path."""
    return F.concat(F.regexp_replace("host", "[^.]*$", ""), F.regexp_replace("path", "^/[^/]*", ""))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score."""
    d = parts(pages, rules)
    seeded = F.col("host").rlike("|".join(seeds))
    label = F.when(F.col("ruled") == "block", 0).when((F.col("ruled") == "allow") & ~seeded, 1).when(F.col("ruled").isNull() & seeded, 0)
    d, m = d.withColumn("read", _read()), F.col("read")
    d = d.select("*", m.alias("m"), label.alias("label"), (F.pmod(F.xxhash64(m), F.lit(5)) == 0).alias("aside"))
    texts = checkpointed(d.groupBy("m").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"), F.first("aside").alias("aside")))
    labelled = texts.select("m", "aside", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("good").alias("n")), F.struct(F.lit(0).alias("label"), F.col("bad").alias("n")))).alias("x")).select("m", "aside", "x.*").where("n > 0")
    train_on = labelled.where(~F.col("aside"))
    if len(train_on.select("label").distinct().collect()) < 2:
        return d.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scores = checkpointed(_scored(texts.select("m"), train(train_on)))
    cut = _calibrated(labelled.where("aside").join(scores, "m"))
    d = d.join(scores.withColumnRenamed("m", "m2"), F.col("m") == F.col("m2"), "left")
    verdict = F.coalesce("ruled", F.when(F.coalesce("score", F.lit(0.0)) >= cut, "allow").otherwise("block"))
    return d.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _calibrated(held_out: DataFrame) -> float:
    """The largest cut, in hundredths, that keeps ACCEPTED of the accepted examples; at most one row per hundredth is
    collected. Without any it is 0."""
    step = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100)))
    rows = held_out.where("label = 1").groupBy(step.alias("s")).agg(F.sum("n").alias("a")).collect()
    good, kept = sum(r["a"] for r in rows), 0
    for r in sorted(rows, key=lambda r: -r["s"]):
        kept += r["a"]
        if kept >= ACCEPTED * good:
            return r["s"] / 100
    return 0.0
