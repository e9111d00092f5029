"""What a judge is shown of records and techniques, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import word_set

DESCRIPTION_CHARS, CODE_CHARS, TITLES = 300, 200, 6


def trick_evidence(tricks: DataFrame) -> DataFrame:
    """(id, evidence) of records: technique, title, the first 300 characters of the description and 200 of the code."""
    shown = F.struct(
        "technique", "title",
        F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION_CHARS).alias("description"),
        F.substring(F.coalesce("key_code", F.lit("")), 1, CODE_CHARS).alias("key_code"),
    )
    return tricks.select("id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("evidence"))


def group_evidence(tricks: DataFrame) -> DataFrame:
    """(id, evidence) of techniques: name, number of records and the six commonest titles as sorted words, ties alphabetical.

    Titles are counted before they are ranked, so that a technique with many records meets
    one row per distinct title. A null title counts as empty.
    """
    title = F.array_join(F.array_sort(word_set(F.coalesce("title", F.lit("")))), " ")
    counted = tricks.select("technique", title.alias("title")).groupBy("technique", "title").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("technique").agg(F.sum("n").alias("trick_count"))
    nth = F.row_number().over(Window.partitionBy("technique").orderBy(F.desc("n"), "title"))
    best = counted.withColumn("nth", nth).where(F.col("nth") <= TITLES)
    titles = best.groupBy("technique").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda t: t["title"]).alias("sample_titles"))
    return total.join(titles, "technique").select(
        F.col("technique").alias("id"), F.to_json(F.struct(F.col("technique").alias("name"), "trick_count", "sample_titles")).alias("evidence")
    )


def with_evidence(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with evidence_a and evidence_b; those of which nothing is known have null."""
    for side in ("a", "b"):
        pairs = pairs.join(evidence.select(F.col("id").alias(side), F.col("evidence").alias(f"evidence_{side}")), side, "left")
    return pairs
