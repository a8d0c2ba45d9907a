r"""Benchmark decontamination by template canonicalisation.

Numbers, capitalised words inside a sentence, and units after numbers become typed placeholders; the rest is
lower-cased words. Windows of ``SEED`` canonical words of every document are hash-joined with the windows of the
benchmark items. A window that is less than half literal words is hashed by its own words instead, so that tables of numbers
meet only where the numbers are the same. Windows are candidates only. Each gives an alignment of the item in the
document, along which all the item's words are compared: a placeholder agrees with one of its type, and the same value
must always be replaced by the same value; alignments that break this, or that change more values than they have
literal words in common, are no leak. A document leaks an item if the words that agree along one alignment, or the words
that agreeing runs of ``window_of`` words cover together, make up the share ``needed`` of the item, or if ``RUN`` words
in a row agree.

Part of that definition: an alignment is looked at where SEED words in a row agree. n words of which e are changed, be it
as evenly as can be, hold such a run whenever n > 4 * e + 3: one change in 9 words is found wherever it is, two in 14, six
in 30, nine in 40, and more if they stand closer. Windows that more than ``COMMON`` texts of items share, such as a stock
question's form, do not by themselves name candidates for items that hold rarer ones, so that a form met in every document
does not pair it with every item: such windows are looked up a second time together with what else a leak must hold
(``common_alignments``). No leak is lost by that; ``COMMON`` says only which way it is found.
Items of fewer than ``SHORTEST`` words stand in most texts by chance: they are leaked by a document of which they are
a whole line.

The benchmark's windows are broadcast up to a counted bound, its words up to a bound in bytes. Then documents are read
once: windows are made, probed, compared and dropped inside the scan, and only pairs that may leak are shuffled. Beyond
the bounds the same is done by shuffles of windows, without texts. A window that an item repeats counts at each of its
places. Documents with common windows are read twice more.

Defined cases: null or empty texts have no windows, and empty items are leaked by nothing; repeated rows of either
side count once, and rows that share an id but not their text are told apart; a null id on either side is dropped;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, stored, text_of

#: Words of the windows that are looked up (a power of two), of those that count as covered, and of the shortest items.
SEED, WINDOW, SHORTEST = 4, 8, 5
#: Windows that more texts of items share name candidates only with more evidence, unless an item has none but such.
COMMON = 32
#: So many words in a row are a leak, whatever their share of the item.
RUN = 20
#: Windows (some 60 bytes each), documents to drop, and lines of short items that are broadcast at most.
MAX_WINDOWS, MAX_ITEMS = 1_000_000, 20_000
#: Bytes of items' words that are broadcast at most; WORD_BYTES come to each word for its two arrays.
MAX_BYTES, WORD_BYTES = 64 << 20, 48
UNITS = "km m cm mm mi ft kg g mg lb oz l ml s ms min h hz khz mhz ghz kb mb gb tb w kw v usd eur gbp dollars euros cents percent meters metres miles feet inches grams kilograms litres liters seconds minutes hours days weeks months years degrees".split()
DOC, ITEM = ["doc_id", "doc_hash"], ["item_id", "item_hash"]


def window_of(n: Column) -> Column:
    """So many words in a row of an item of n words count as covered, also where the rest of an alignment differs."""
    return F.when(n >= 2 * WINDOW, WINDOW).when(n >= 10, F.floor(n / 2)).otherwise(n).cast("int")


def needed(n: Column) -> Column:
    """The share of an item of n words that must agree: more of short ones, and all of the shortest."""
    return F.when(n >= 4 * WINDOW, 0.5).when(n >= 2 * WINDOW, 0.7).when(n > WINDOW, 0.8).otherwise(1.0)


def tokens(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The id and the text's hash under ``names``; slotted: whether there are placeholders; raw and canon: aligned
    arrays of words and of canonical words."""
    named = r"(?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{N},;)]\x20)(\p{Lu}\p{Ll}+)"
    # A filter on the words themselves would be pushed below the patterns, and run them all twice.
    d = df.where(F.col(key).isNotNull() & text_of().rlike(r"[\p{L}\p{N}\x02]")).select(F.col(key).alias(names[0]), F.xxhash64(text_of()).alias(names[1]), F.lower(F.regexp_replace(text_of(), named, "\u0002$1")).alias("t"))
    d = d.select(*names, F.when(F.col("t").rlike("[0-9]"), F.regexp_replace("t", r"(?<=[0-9])(?=\p{L})|(?<=\p{L})(?=[0-9])", " ")).otherwise(F.col("t")).alias("t"))
    # Single spaces are left as they are, so that not every word makes a match.
    between = r"[^\p{L}\p{N}\u0002 ][^\p{L}\p{N}\u0002]*+| [^\p{L}\p{N}\u0002]++"
    d = d.select(*names, F.btrim(F.regexp_replace("t", between, " "), F.lit(" ")).alias("t"))
    canon = F.regexp_replace("t", "\u0002[^ ]+", "\u0001name")
    canon = F.regexp_replace(canon, "(?<![^ ])[0-9]+(?![^ ])", "\u0001num")
    canon = F.regexp_replace(canon, "(?<=\u0001num )(?:" + "|".join(UNITS) + ")(?![^ ])", "\u0001unit")
    d = d.withColumns({"slotted": F.col("t").rlike("[0-9\u0002]"), "raw": F.split("t", " ")})
    return d.select(*names, "slotted", "raw", F.when(F.col("slotted"), F.split(canon, " ")).otherwise(F.col("raw")).alias("canon"))


def windows(toks: DataFrame) -> DataFrame:
    """``toks`` with hs: the hashes of all windows of SEED canonical words, by place.

    Words are hashed once, then neighbours in pairs, and the pairs in pairs. Where there are placeholders literal words
    are counted in the same way, and a window of too few is hashed by its own words.
    """
    literal = F.when(F.col("slotted"), F.transform("canon", lambda w: F.when(w.startswith("\u0001"), 0).otherwise(1)))
    d = toks.withColumns({"h": F.transform("canon", lambda w: F.xxhash64(w)), "c": literal})
    for k in range(SEED.bit_length() - 1):
        later = lambda c: F.slice(c, F.lit(2**k + 1), F.size("canon"))  # noqa: B023, E731
        d = d.withColumns({"h": F.zip_with("h", later("h"), lambda a, b: F.xxhash64(a, b)), "c": F.zip_with("c", later("c"), lambda a, b: a + b)})
    own = lambda i: F.xxhash64(F.array_join(F.slice("raw", i + 1, F.lit(SEED)), " "), F.lit(SEED))
    poor = F.transform(F.arrays_zip("h", "c"), lambda x, i: F.when(2 * x["c"] >= SEED, x["h"]).otherwise(own(i)))
    hs = F.slice(F.when(F.col("c").isNull(), F.col("h")).otherwise(poor), F.lit(1), F.greatest(F.size("canon") - SEED + 1, F.lit(0)))
    return d.withColumn("hs", hs).drop("h", "c", "slotted")


def seeds(items: DataFrame, common: bool = False) -> DataFrame:
    """ITEM, n (its words), h, q (place), before (hash of the seed one place earlier, if that is one too) of the windows
    by which items are looked up; with ``common`` of those that too many texts share."""
    b = windows(items.where(F.size("canon") >= SHORTEST)).select(*ITEM, F.size("canon").alias("n"), F.posexplode_outer("hs").alias("q", "h"))
    b = b.join(b.groupBy("h").agg(F.countDistinct("item_hash").alias("texts")), "h")
    rare = F.col("texts") <= F.greatest(F.lit(COMMON), F.col("least"))
    b = b.join(b.groupBy(*ITEM).agg(F.min("texts").alias("least")), ITEM).where(~rare if common else rare).drop("texts", "least")
    return b.join(b.select(*ITEM, (F.col("q") + 1).alias("q"), F.col("h").alias("before")), [*ITEM, "q"], "left")


_FIRST = "before IS NULL OR previous IS NULL OR before <> previous"
_OFFSET = "i - q AS offset"


def _beside(c: str) -> Column:
    """The document's words beside the item's."""
    return F.slice(c, F.greatest("offset", F.lit(0)) + 1, F.col("n") + F.least("offset", F.lit(0))).alias(f"doc_{c}")


def _placed(toks: DataFrame) -> DataFrame:
    """``toks`` with a row for each window: i (place), h, previous (the window before)."""
    # The outer form: from the plain one Spark infers a filter on the array, and makes it twice.
    return windows(toks).select("*", F.posexplode_outer("hs").alias("i", "h")).where("h IS NOT NULL").withColumn("previous", F.get("hs", F.col("i") - 1)).drop("hs")


def alignments(docs: DataFrame, b: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """DOC, ITEM, offset of the item in the document, doc_raw, doc_canon (the document's words beside the item's) of
    every alignment with a seed ``b``. Of seeds in a row the first stands for all."""
    d = _placed(tokens(docs, "doc_id", DOC))
    if b.limit(most + 1).count() <= most:
        return d.join(F.broadcast(b), "h").where(_FIRST).select(*DOC, *ITEM, "n", "raw", "canon", F.expr(_OFFSET)).select(*DOC, *ITEM, "offset", _beside("raw"), _beside("canon"))
    # Windows are shuffled without the texts; only those with hits are made into words again.
    lines = checkpointed(d.drop("raw", "canon").join(b, "h").where(_FIRST).select(*DOC, *ITEM, "n", F.expr(_OFFSET)).distinct())
    return lines.join(tokens(_having(docs, lines), "doc_id", DOC).dropDuplicates(DOC), DOC).select(*DOC, *ITEM, "offset", _beside("raw"), _beside("canon"))


def _having(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that ``rows`` name by DOC."""
    ids = rows.select(F.col("doc_id").alias("hit_id"), F.col("doc_hash").alias("hit_hash")).distinct()
    return docs.select("doc_id", "text").join(broadcast_if_small(ids, MAX_WINDOWS), (F.col("doc_id") == F.col("hit_id")) & (F.xxhash64(text_of()) == F.col("hit_hash")), "left_semi")


def _grams(toks: DataFrame) -> DataFrame:
    """``toks`` with g and g_run: hashes of all its SEED and RUN canonical words in a row, whatever they are."""
    d = toks.withColumn("g1", F.transform("canon", lambda w: F.xxhash64(w)))
    later = lambda c, k: F.slice(c, F.lit(k + 1), F.size("canon"))
    both = lambda a, b: F.xxhash64(a, b)
    for k in (1, 2, 4, 8):
        d = d.withColumn(f"g{2 * k}", F.zip_with(f"g{k}", later(f"g{k}", k), both))
    d = d.withColumn("g_run", F.zip_with("g16", later("g4", RUN - SEED), both))
    cut = lambda c, k: F.slice(c, F.lit(1), F.greatest(F.size("canon") - k + 1, F.lit(0)))
    return d.withColumns({"g": cut("g4", SEED), "g_run": cut("g_run", RUN)}).drop("g1", "g2", "g4", "g8", "g16")


def _keys(items: DataFrame, forms: DataFrame) -> DataFrame:
    """ITEM, key: of the items with common windows, what a document that leaks them must hold.

    If T of n words agree, one of any n - T + 1 does. So keys are, beside a common window, the n - T + 1 words outside it
    that are rarest at their distance from it; for words covered by several alignments, the windows around the n - T + 1
    places whose windows are rarest; and each RUN words in a row. Words of a form are the last to become keys: they
    do if the form alone makes up the share, so that it is leaked by all who hold it.
    """
    spare = F.col("n") - F.ceil(needed(F.col("n")) * F.col("n")) + 1
    rank = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = items.join(forms.select(*ITEM, "n").distinct(), ITEM)
    near = forms.select(*ITEM, "h", "q").join(some, ITEM).select(*ITEM, "n", "h", "q", F.posexplode("canon").alias("p", "w")).where((F.col("p") < F.col("q")) | (F.col("p") >= F.col("q") + SEED))
    near = checkpointed(near.select(*ITEM, "n", "h", "q", F.xxhash64(F.lit(1), "h", (F.col("p") - F.col("q")).cast("int"), "w").alias("key")))
    near = near.join(near.groupBy("key").agg(F.count("*").alias("held")), "key").withColumn("rank", rank([*ITEM, "h", "q"], "held", "key")).where(F.col("rank") <= spare)
    grams = checkpointed(_grams(some))
    g = grams.select(*ITEM, "n", F.posexplode("g").alias("p", "g")).select(*ITEM, "n", "p", F.xxhash64(F.lit(2), "g").alias("key"))
    g = g.join(g.groupBy("key").agg(F.count("*").alias("held")), "key").select(*ITEM, "n", "key", "held", F.explode(F.sequence(F.col("p"), F.col("p") + SEED - 1)).alias("place"))
    g = checkpointed(g)
    places = g.groupBy(*ITEM, "n", "place").agg(F.sum("held").alias("held")).withColumn("rank", rank(ITEM, "held", "place")).where(F.col("rank") <= spare)
    covering = g.join(places.select(*ITEM, "place"), [*ITEM, "place"])
    runs = grams.select(*ITEM, F.explode("g_run").alias("g")).select(*ITEM, F.xxhash64(F.lit(3), "g").alias("key"))
    return near.select(*ITEM, "key").unionByName(covering.select(*ITEM, "key")).unionByName(runs).distinct()


def common_alignments(docs: DataFrame, items: DataFrame, forms: DataFrame, known: DataFrame) -> DataFrame:
    """What ``alignments`` gives for the common windows ``forms``, of all pairs that can leak (by ``_keys``) and of the
    pairs ``known`` (DOC, ITEM), without listing all pairs that share a form."""
    common = broadcast_if_small(checkpointed(forms.select("h").distinct()), MAX_WINDOWS)
    holding = checkpointed(_placed(tokens(docs, "doc_id", DOC)).select(*DOC, "h").join(common, "h", "left_semi").select(*DOC).distinct())
    toks = stored(tokens(_having(docs, holding), "doc_id", DOC).dropDuplicates(DOC), "form-words")
    most = forms.agg(F.max("n")).first()[0]
    low = F.greatest(F.col("i") - most, F.lit(0))
    beside = _placed(toks).select(*DOC, "canon", "i", "h").join(common, "h", "left_semi")
    beside = beside.select(*DOC, F.explode(F.transform(F.slice("canon", low + 1, F.lit(2 * most)), lambda w, k: F.xxhash64(F.lit(1), "h", (k + low - F.col("i")).cast("int"), w))).alias("key"))
    grams = F.concat(F.transform("g", lambda g: F.xxhash64(F.lit(2), g)), F.transform("g_run", lambda g: F.xxhash64(F.lit(3), g)))
    held = beside.unionByName(_grams(toks).select(*DOC, F.explode(grams).alias("key")))
    pairs = held.join(broadcast_if_small(checkpointed(_keys(items, forms)), MAX_WINDOWS), "key").select(*DOC, *ITEM)
    pairs = checkpointed(pairs.unionByName(known.select(*DOC, *ITEM)).distinct())
    lines = pairs.join(forms, ITEM).join(_placed(toks).drop("raw", "canon"), [*DOC, "h"]).where(_FIRST).select(*DOC, *ITEM, "n", F.expr(_OFFSET)).distinct()
    return lines.join(toks, DOC).select(*DOC, *ITEM, "offset", _beside("raw"), _beside("canon"))


def compared(lines: DataFrame, items: DataFrame) -> DataFrame:
    """DOC, ITEM, n (words of the item), same (that agree), run (of them in a row), changed (values), covered (places
    in agreeing runs of ``window_of`` words) of the alignments that hold."""
    size = items.agg(F.sum(F.octet_length(F.array_join("raw", " ")) + WORD_BYTES * F.size("raw"))).first()[0] or 0
    x = items.select(*ITEM, "raw", "canon")
    d = lines.join(F.broadcast(x) if size <= MAX_BYTES else x, ITEM)
    n, w, start = F.size("raw"), window_of(F.size("raw")), F.greatest(-F.col("offset"), F.lit(0))
    beside = lambda c: F.slice(c, start + 1, F.size(c))
    bits = F.array_join(F.zip_with(beside("canon"), "doc_canon", lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    d = d.select(
        *DOC, *ITEM, n.alias("n"), w.alias("w"), start.alias("start"), bits.alias("bits"), F.length(F.replace(bits, F.lit("0"), F.lit(""))).alias("same"),
        F.arrays_zip(beside("canon").alias("ca"), F.col("doc_canon").alias("cb"), beside("raw").alias("a"), F.col("doc_raw").alias("b")).alias("x"),
    )
    # With fewer words in common an alignment neither leaks nor covers anything.
    d = d.where(F.col("same") >= F.least(F.col("w").cast("double"), needed(F.col("n")) * F.col("n")))
    slots = F.filter("x", lambda x: (x["ca"] == x["cb"]) & x["ca"].startswith("\u0001"))
    values = F.array_distinct(F.transform(slots, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    none = F.array().cast("array<int>")
    whole = F.when(F.length("bits") >= F.col("w"), F.filter(F.sequence(F.lit(0), F.length("bits") - F.col("w")), lambda i: F.substring("bits", i + 1, F.col("w")) == F.repeat(F.lit("1"), F.col("w")))).otherwise(none)
    covered = F.array_distinct(F.flatten(F.transform(whole, lambda i: F.sequence(F.col("start") + i, F.col("start") + i + F.col("w") - 1))))
    d = d.select(
        *DOC, *ITEM, "n", "same", (F.col("same") - F.size(slots)).alias("literal"), values.alias("values"), covered.alias("covered"),
        F.array_max(F.transform(F.split("bits", "0"), lambda r: F.length(r))).alias("run"),
    )
    d = d.withColumn("changed", F.size(F.filter("values", lambda v: v["a"] != v["b"])))
    consistent = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda v: v["a"])))
    return d.where(consistent & (F.col("changed") <= F.col("literal"))).drop("values", "literal")


def _bare(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def short_leaks(docs: DataFrame, items: DataFrame, benchmark: DataFrame) -> DataFrame:
    """DOC, ITEM, n of items below SHORTEST words that are a whole line of a document."""
    few = items.where(F.size("canon") < SHORTEST).select(*[F.col(c).alias(f"{c}_of") for c in ITEM], F.size("canon").alias("n"))
    text = benchmark.select(F.col("item_id"), F.xxhash64(text_of()).alias("item_hash"), _bare(text_of()).alias("line")).where("line <> ''").distinct()
    text = text.join(few, [F.col(c) == F.col(f"{c}_of") for c in ITEM]).select(*ITEM, "n", "line")
    lines = F.array_distinct(F.filter(F.transform(F.split(text_of(), "\n"), _bare), lambda x: F.size(F.split(x, " ")) < SHORTEST))
    d = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text_of()).alias("doc_hash"), F.explode_outer(lines).alias("line")).where("line <> ''")
    return d.join(broadcast_if_small(text, MAX_ITEMS), "line").select(*DOC, *ITEM, "n").distinct()


def found(docs: DataFrame, benchmark: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """DOC, ITEM, n, n_found, run, changed of every leak."""
    items = checkpointed(tokens(benchmark, "item_id", ITEM).dropDuplicates(ITEM))
    seen = compared(alignments(docs, checkpointed(seeds(items)), most), items)
    forms = checkpointed(seeds(items, common=True))
    if not forms.isEmpty():
        seen = checkpointed(seen)
        seen = seen.unionByName(compared(common_alignments(docs, items, forms, seen), items))
    seen = seen.groupBy(*DOC, *ITEM).agg(
        F.max("n").alias("n"), F.max("same").alias("same"), F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("covered"), F.max("run").alias("run"), F.max_by("changed", F.struct("same", "changed")).alias("changed")
    )
    seen = seen.withColumn("n_found", F.greatest("same", "covered")).where((F.col("n_found") >= needed(F.col("n")) * F.col("n")) | (F.col("run") >= RUN)).select(*DOC, *ITEM, "n", "n_found", "run", "changed")
    if items.where(F.size("canon") < SHORTEST).isEmpty():
        return seen
    return seen.unionByName(short_leaks(docs, items, benchmark).select(*DOC, *ITEM, "n", F.col("n").alias("n_found"), F.col("n").alias("run"), F.lit(0).alias("changed")))


def leaks(docs: DataFrame, benchmark: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_words of the item, n_found (of them), longest_run, share, n_changed (slot values that differ),
    kind; a row for each pair of different texts."""
    d = found(docs, benchmark, most)
    long = lambda c: F.col(c).cast("long")
    kind = F.when(F.col("changed") > 0, "reparameterised").otherwise("copied")
    return d.select("doc_id", "item_id", long("n").alias("n_words"), long("n_found").alias("n_found"), long("run").alias("longest_run"), (F.col("n_found") / F.col("n")).alias("share"), long("changed").alias("n_changed"), kind.alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; the columns stay."""
    lost = broadcast_if_small(checkpointed(found(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).distinct()), MAX_WINDOWS)
    return docs.join(lost, (docs["doc_id"] == lost["__id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == lost["__hash"]), "left_anti")
