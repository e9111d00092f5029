"""Canonical names: alias table, longest contained keyword, fuzzy match, merged mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import clean_name, lcs_ratio
from sievelake.operators.components import connected_components
from sievelake.storage import Scratch

LONG_NAME, FUZZY_LEAST = 40, 70
#: Blocks into which the known names of one length are dealt.
FUZZY_BLOCKS = 16
#: Aliases are a table (alias, canonical, pos); beyond so many rows it is joined without a broadcast.
ALIAS_BROADCAST_ROWS = 100_000


def with_overrides(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """The alias table (alias, canonical, pos), custom rows winning over defaults."""
    return custom.unionByName(defaults.join(custom.select("alias"), "alias", "left_anti"))


def canonical_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, canonical) of the distinct names: an alias' canonical; of unknown long names that of the longest contained alias; else the cleaned name.

    Only the few unknown names over 40 characters meet the alias table by containment.
    """
    cleaned = names.select("name").distinct().withColumn("clean", clean_name(F.col("name")))
    table = aliases.select(F.col("alias"), F.col("canonical").alias("known"), "pos")
    small = aliases.count() <= ALIAS_BROADCAST_ROWS
    side = F.broadcast(table) if small else table
    known = cleaned.join(side.select(F.col("alias").alias("clean"), "known"), "clean", "left")
    long_ = known.where(F.col("known").isNull() & (F.length("clean") > LONG_NAME)).select("clean").distinct()
    grams = long_.select("clean", F.explode(_substrings(F.col("clean"))).alias("alias")) if not small else None
    inside = long_.join(side, F.col("clean").contains(F.col("alias"))) if small else grams.join(table, "alias")
    best = inside.groupBy("clean").agg(F.max_by("known", F.struct(F.length("alias"), -F.col("pos"))).alias("contained"))
    return known.join(best, "clean", "left").select("name", F.coalesce("known", "contained", "clean").alias("canonical"))


def _substrings(text: Column) -> Column:
    """All substrings of a (long) name, so that containment becomes an equality for large alias tables."""
    n = F.length(text)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(text, i, k)))))


def fuzzy_matches(unknown: DataFrame, known: DataFrame, least: int = FUZZY_LEAST) -> DataFrame:
    """(name, match, ratio): of all known names the most alike one of at least `least`, ties alphabetical.

    Unknown names meet only the known ones of lengths with which the ratio can be reached,
    dealt into blocks so that common lengths do not fill one task. Pairs whose edit distance
    rules the ratio out are dropped before it is computed; neither bound loses a match.
    """
    names = unknown.where("name is not null").select("name").distinct()
    others = known.where("name is not null").select(F.col("name").alias("match")).distinct()
    others = others.withColumn("size", F.length("match")).withColumn("block", F.pmod(F.xxhash64("match"), F.lit(FUZZY_BLOCKS)).cast("int"))
    sizes = F.broadcast(others.select("size").distinct())  # one row per length
    total = F.length("name") + F.col("size")
    reachable = 200 * F.least(F.length("name"), F.col("size")) >= least * total
    asked = names.join(sizes, reachable).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(FUZZY_BLOCKS - 1))))
    # The ratio counts a replaced letter as two edits, the distance as one, so the distance is at most the ratio's edits.
    near = 100 * F.levenshtein("name", "match") <= (100 - least) * total
    pairs = asked.join(others, ["size", "block"]).where(near)
    scored = pairs.select("name", "match", F.round(lcs_ratio(F.col("name"), F.col("match")), 4).alias("ratio")).where(F.col("ratio") >= least)
    best = Window.partitionBy("name").orderBy(F.desc("ratio"), "match")
    return scored.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def merged_mapping(groups: DataFrame, accepted: DataFrame, scratch: Scratch) -> DataFrame:
    """(old, merged) for every group (name, count, is_canonical), united over accepted pairs (a, b).

    A component is named after its canonical member if it has one, then by most records,
    shortest name, alphabet.
    """
    labels = connected_components(accepted, scratch)
    placed = groups.join(labels.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    rank = F.struct(~F.col("is_canonical"), -F.col("count"), F.length("name"), "name")
    names = placed.groupBy("component").agg(F.min_by("name", rank).alias("merged"))
    return placed.join(names, "component").select(F.col("name").alias("old"), "merged")


def regroup(tricks: DataFrame, mapping: DataFrame) -> DataFrame:
    """tricks (technique, ...) under their merged names; unmapped techniques keep theirs."""
    joined = tricks.join(mapping.select(F.col("old").alias("technique"), "merged"), "technique", "left")
    return joined.withColumn("technique", F.coalesce("merged", "technique")).drop("merged")


def new_aliases(mapping: DataFrame, curated: DataFrame) -> DataFrame:
    """Aliases (old, merged) worth keeping: changed names that no user has curated (alias)."""
    return mapping.where("old <> merged").join(curated.select(F.col("alias").alias("old")), "old", "left_anti")
