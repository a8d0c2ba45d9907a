"""Quality rules: a threshold table compiled into one projection of built-in functions.

``RULES`` is the table: a name, a ratio over the measured columns, and the bounds
inside which a text is kept. ``score`` measures every text and evaluates all rules
in the same pass; there is no shuffle, no Python function and no state.

Defined cases: a null text is measured as an empty one (no words, ``base_failed``);
rows are judged one by one, so repeated rows give repeated results; extra columns
of the input are ignored; an empty table gives an empty result. A text without
words has ratios of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, words_of

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on with as by be are this at or from "
    "le la les de des et un une en que qui dans du pour est au par ne se il "
    "der die das und ein eine zu den von mit auf im nicht sich dem ist des es "
    "el los las una y no con del al como por para su lo más"
).split()

#: name, SQL over the measured columns, lower bound, upper bound (None: no bound).
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 50, 1_000_000),
    ("mean_word_length", "word_chars / n_words", 2, 15),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("stop_words", "n_stop_words / n_words", 0.02, None),
    ("repeated_words", "n_repeat_words / n_words", None, 0.5),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
    ("upper_words", "n_upper_words / n_words", None, 0.4),
]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measured columns. Repeated three-word windows are found per text by sorting
    their hashes with the position in the low bits; neighbours of equal hash are compared by words."""
    text = text_of()
    d = docs.select(F.col("doc_id"), text.alias("t"), words_of(text).alias("w"))
    d = d.select(
        "doc_id",
        "w",
        F.size("w").alias("n"),
        F.length(F.bin(F.size("w").cast("long"))).alias("b"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    d = d.select(
        "*",
        F.expr("sort_array(transform(slice(w, 1, greatest(n - 2, 0)), (x, i) -> shiftleft(xxhash64(x, w[i + 1], w[i + 2]), b) | i))").alias("s"),
        F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS)).alias("stops"),
        F.expr(r"filter(w, x -> x rlike '^\\p{Lu}{2}' AND x = upper(x))").alias("uppers"),
    )
    same = "shiftright(x, b) = shiftright(s[{j}], b) AND w[{p}] = w[{q}] AND w[{p} + 1] = w[{q} + 1] AND w[{p} + 2] = w[{q} + 2]"
    at = "CAST({} & (shiftleft(1L, b) - 1) AS INT)"
    pair = lambda j: same.format(j=j, p=at.format("x"), q=at.format(f"s[{j}]"))
    d = d.withColumn("again", F.expr(f"filter(s, (x, i) -> (i > 0 AND {pair('i - 1')}) OR (i < n - 3 AND {pair('i + 1')}))"))
    d = d.withColumn("at", F.expr(f"sort_array(transform(again, x -> {at.format('x')}))"))
    covered = "CASE WHEN size(at) = 0 THEN 0L ELSE 3L + aggregate(transform(slice(at, 2, size(at)), (q, i) -> least(3, q - at[i])), 0L, (a, x) -> a + x) END"
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("stops").cast("long").alias("n_stop_words"),
        F.size("uppers").cast("long").alias("n_upper_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _fails(measure: str, low: float | None, high: float | None) -> Column:
    value = F.coalesce(F.expr(measure.replace(" / ", " / nullif(") + ", 0)" if " / " in measure else measure), F.lit(0))
    below = F.lit(False) if low is None else value < low
    above = F.lit(False) if high is None else value > high
    return below | above


def score(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: the measures, ``base_failed``, ``kept`` and the names of failed rules."""
    d = measured(docs)
    failed = F.array_compact(F.array(*[F.when(_fails(m, low, high), F.lit(name)) for name, m, low, high in rules]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.select("*", base.alias("base_failed"), F.array_join(failed, ",").alias("failed_rules"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"),
        "n_stop_words", "n_upper_words", "n_lines", "failed_rules",
    )
