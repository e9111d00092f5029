"""Records to Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.tables import CATEGORIES
from sievelake.functions.text import strip, title_case
from sievelake.operators.cluster import primary_category


def fixed_categories(spark) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "technique string, category string")


def _block(label: str, body: Column, present: Column) -> Column:
    return F.when(present, F.concat(F.lit(f"\n\n{label}"), body)).otherwise(F.lit(""))


def _bullets(items: Column) -> Column:
    return F.concat(F.lit("\n- "), F.array_join(items, "\n- "))


def rendered_trick(challenge: Column) -> Column:
    """One section of a technique file, from the columns of a record."""

    def has(c: str) -> Column:
        return F.coalesce(F.length(c), F.lit(0)) > 0

    def some(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) > 0

    def fenced(c: str) -> Column:
        return F.concat(F.lit("\n\n```\n"), F.col(c), F.lit("\n```"))

    return F.concat(
        F.lit("## "), "title",
        _block("Description: ", F.col("description"), has("description")),
        _block("Conditions: ", F.concat(F.array_join("conditions", "; "), F.lit(";")), some("conditions")),
        _block("Implementation:", _bullets(F.col("implementation_steps")), some("implementation_steps")),
        _block("Key code/payload:", fenced("key_code"), has("key_code")),
        _block("Example:", fenced("example"), has("example")),
        _block("Detection signs:", _bullets(F.col("detection_signs")), some("detection_signs")),
        _block("Example challenge: ", challenge, F.coalesce(F.length(challenge), F.lit(0)) > 0),
        F.lit("\n\n"),
    )


def render_files(tricks: DataFrame, writeups: DataFrame | None = None) -> DataFrame:
    """(name, content): a Markdown file per technique, records by falling confidence, then pos.

    tricks: technique and pos beside the fields of a record. Without an example challenge the
    first source's is named from writeups (url, challenge_title, challenge_source).
    """
    rows = tricks
    challenge = F.when(F.length("example_challenge") > 0, F.col("example_challenge"))
    if writeups is not None:
        of_url = writeups.select(F.col("url").alias("__url"), F.concat("challenge_title", F.lit(" ("), "challenge_source", F.lit(")")).alias("__from"))
        rows = rows.withColumn("__url", F.get("source_writeups", F.lit(0))).join(of_url, "__url", "left")
        challenge = F.coalesce(challenge, F.col("__from"))
    parts = rows.select("technique", "category", "description", "confidence", "pos", rendered_trick(challenge).alias("section"))
    listed = F.array_sort(F.collect_list(F.struct(-F.col("confidence"), "pos", "section", "description")))
    grouped = parts.groupBy("technique").agg(listed.alias("s"))
    category = primary_category(tricks.select("technique", "category"), fixed_categories(tricks.sparkSession))
    first = F.get("s.description", F.lit(0))
    fallback = F.concat(F.lit("Techniques related to "), F.translate("technique", "_", " "), F.lit("."))
    content = F.concat(
        F.lit("---\ncategory: "), "category", F.lit("\ndescription: "), F.when(F.length(first) > 0, first).otherwise(fallback),
        F.lit("\n---\n# "), title_case(F.col("technique")), F.lit("\n\n"), F.array_join("s.section", "\n"),
    )
    tidy = F.concat(strip(F.regexp_replace(content, r"\n{3,}", "\n\n")), F.lit("\n"))
    return grouped.join(category, "technique").select(F.col("technique").alias("name"), tidy.alias("content"))


def preview(tricks: DataFrame) -> DataFrame:
    """(technique, content): a short form without code; steps and signs on one line each, the first record's category."""
    part = F.concat(
        F.lit("## "), "title",
        _block("Description: ", F.col("description"), F.coalesce(F.length("description"), F.lit(0)) > 0),
        _block("Implementation: ", F.array_join("implementation_steps", "; "), F.coalesce(F.size("implementation_steps"), F.lit(0)) > 0),
        _block("Detection signs: ", F.array_join("detection_signs", "; "), F.coalesce(F.size("detection_signs"), F.lit(0)) > 0),
    )
    listed = F.array_sort(F.collect_list(F.struct("pos", part.alias("section"), "category")))
    grouped = tricks.groupBy("technique").agg(listed.alias("s"))
    head = F.concat(F.lit("---\ncategory: "), F.coalesce(F.get("s.category", F.lit(0)), F.lit("misc")), F.lit("\n---\n# "), title_case(F.col("technique")), F.lit("\n\n"))
    return grouped.select("technique", F.concat(head, F.array_join("s.section", "\n\n"), F.lit("\n")).alias("content"))
