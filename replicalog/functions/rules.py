"""Ignore rules: compiling lines, and matching paths; the last rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import ancestors, basename

RULE = "array<struct<ord: int, raw: string, negate: boolean, kind: string, pattern: string>>"


def compile_rules(lines: DataFrame) -> DataFrame:
    """``lines``: folder, ord, line. Returns folder, rules (array of RULE in order): one row per folder.

    Tests, in order: a trailing slash names a directory, a leading slash an anchored one; ``*.x`` without a slash an
    extension; a leading star the end of a basename; a slash inside a directory; all else a basename.
    """
    bare = F.btrim("line")
    d = lines.select("folder", F.col("ord").cast("int").alias("ord"), bare.alias("raw")).where((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    d = d.withColumn("negate", F.col("raw").startswith("!")).withColumn("p", F.when(F.col("negate"), F.btrim(F.substring("raw", 2, 1 << 20))).otherwise(F.col("raw"))).where("p <> ''")
    p = F.col("p")
    slash = F.contains(p, F.lit("/"))
    kind = F.when(p.endswith("/") | p.startswith("/"), "dir").when(F.contains(p, F.lit("*.")) & ~slash, "ext").when(p.startswith("*"), "suffix").when(slash, "dir").otherwise("exact")
    pattern = (
        F.when(kind == "dir", F.regexp_replace(F.regexp_replace(p, "/+$", ""), "^/+", ""))
        .when(kind == "ext", F.lower(F.regexp_extract(p, r"\*\.(.*)$", 1)))
        .when(kind == "suffix", F.substring(p, 2, 1 << 20))
        .otherwise(p)
    )
    ext = F.lower(F.regexp_extract(p, r"^.*?\*\.(.*)$", 1))
    d = d.select("folder", F.struct("ord", "raw", "negate", kind.alias("kind"), F.when(kind == "ext", ext).otherwise(pattern).alias("pattern")).alias("r"))
    return d.groupBy("folder").agg(F.array_sort(F.collect_list("r")).cast(RULE).alias("rules"))


def _matches(path: Column, is_dir: Column, r: Column) -> Column:
    base, p = basename(path), r["pattern"]
    return (
        F.when(r["kind"] == "dir", (path == p) | F.startswith(path, F.concat(p, F.lit("/"))))
        .when(r["kind"] == "ext", ~is_dir & F.endswith(F.lower(base), F.concat(F.lit("."), p)))
        .when(r["kind"] == "suffix", ~is_dir & F.endswith(base, p))
        .otherwise(base == p)
    )


def ignore_match(path: Column, is_dir: Column, rules: Column) -> Column:
    """struct<ignored, rule>: the verdict of the last rule that matches, and its text."""
    start = F.struct(F.lit(False).alias("ignored"), F.lit(None).cast("string").alias("rule"))
    rules = F.coalesce(rules, F.array().cast(RULE))
    return F.aggregate(rules, start, lambda acc, r: F.when(_matches(path, is_dir, r), F.struct((~r["negate"]).alias("ignored"), r["raw"].alias("rule"))).otherwise(acc))


def below_ignored(path: Column, rules: Column) -> Column:
    """Whether a directory above the path is ignored: nothing below it can be taken back in."""
    return F.exists(ancestors(path), lambda a: ignore_match(a, F.lit(True), rules)["ignored"])


def with_rules(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ignored and rule to a listing (folder, name, type). Rules are a row per folder, joined on it."""
    r = rules.select(F.col("folder").alias("rules_of"), "rules")
    d = listing.join(r, F.col("folder") == F.col("rules_of"), "left")
    m = ignore_match(F.col("name"), F.col("type") == 1, F.col("rules"))
    return d.withColumn("m", m).withColumn("pruned", below_ignored(F.col("name"), F.col("rules"))).withColumns({"ignored": F.col("m.ignored"), "rule": F.when(F.col("m.ignored"), F.col("m.rule"))}).drop("m", "rules", "rules_of")


def prune_ignored_dirs(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """The listing without what lies below an ignored directory; ignored entries stay, marked."""
    return with_rules(listing, rules).where(~F.col("pruned")).drop("pruned")
