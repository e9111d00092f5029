"""Joins, set operations and small aggregates of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_gaps(writeups: DataFrame, tricks: DataFrame, parity: bool = False) -> DataFrame:
    """Writeups whose url no trick names as a source. With parity, nothing is missing while there are no tricks at all."""
    sourced = tricks.select(F.explode("source_writeups").alias("url")).distinct()
    missing = writeups.join(sourced, "url", "left_anti")
    return missing.join(F.broadcast(tricks.limit(1).select(F.lit(1).alias("__any"))), how="left_semi") if parity else missing


def merge_corpora(base: DataFrame, other: DataFrame, order: str = "pos") -> DataFrame:
    """base as it is, and of other the first row (by order) of each url that base lacks; rows of other without url go."""
    first = Window.partitionBy("url").orderBy(order)
    usable = other.where(F.coalesce(F.col("url"), F.lit("")) != "").join(base.select("url").distinct(), "url", "left_anti")
    new = usable.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    return base.unionByName(new)


def merge_report(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: existing, no_url, duplicate, new and total of merge_corpora."""
    known = base.select("url").distinct().withColumn("__known", F.lit(True))
    keyed = other.join(known, "url", "left").withColumn("__none", F.coalesce(F.col("url"), F.lit("")) == "")
    counts = keyed.agg(
        F.count_if("__none").alias("no_url"),
        F.count(F.lit(1)).alias("all"),
        F.count_distinct(F.when(~F.col("__none") & F.col("__known").isNull(), F.col("url"))).alias("new"),
    )
    existing = base.agg(F.count(F.lit(1)).alias("existing"))
    return existing.crossJoin(counts).select(  # one row each
        "existing", "no_url", (F.col("all") - F.col("no_url") - F.col("new")).alias("duplicate"), "new", (F.col("existing") + F.col("new")).alias("total")
    )


def inverted_index(records: DataFrame, id_col: str, list_col: str, key: str = "url") -> DataFrame:
    """key -> sorted ids of the records that list it."""
    return records.select(F.explode(list_col).alias(key), id_col).groupBy(key).agg(F.array_sort(F.collect_set(id_col)).alias("ids"))


def union_of_sources(tricks: DataFrame) -> DataFrame:
    """(technique_name, title) -> distinct sources in order of first appearance; rows carry pos."""
    flat = tricks.where("technique_name <> '' and title <> ''").select("technique_name", "title", "pos", F.posexplode("source_writeups").alias("i", "url"))
    firsts = flat.groupBy("technique_name", "title", "url").agg(F.min(F.struct("pos", "i")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "url")))
    return firsts.groupBy("technique_name", "title").agg(ordered.alias("found")).select("technique_name", "title", F.col("found.url").alias("sources"))


def last_by_url(writeups: DataFrame) -> DataFrame:
    """url -> title and source of the last row (by pos) that has url and title."""
    named = writeups.where("url <> '' and challenge_title <> ''")
    return named.groupBy("url").agg(F.max_by(F.struct("challenge_title", "challenge_source"), "pos").alias("w")).select("url", "w.*")


def search_writeups(writeups: DataFrame, counts: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Writeups whose title or source contains the query, with their trick counts, by title."""
    q = query.strip().lower()
    hit = F.lower("challenge_title").contains(q) | F.lower("challenge_source").contains(q) if q else F.lit(True)
    found = writeups.where(hit).orderBy("challenge_title", "pos").limit(limit)
    return found.join(counts, "url", "left").withColumn("trick_count", F.coalesce("trick_count", F.lit(0)))


def remove_source(records: DataFrame, url: Column | str) -> DataFrame:
    """Records without the url among their sources; those that had no other source go."""
    rest = F.array_remove("source_writeups", F.lit(url) if isinstance(url, str) else url)
    kept = records.withColumn("__rest", rest).where((F.size("__rest") > 0) | (F.size("source_writeups") == 0))
    return kept.withColumn("source_writeups", F.col("__rest")).drop("__rest")


def positions_to_urls(records: DataFrame, batches: DataFrame) -> DataFrame:
    """Sources of extracted records: records (record_id, batch_id, source_indexes, 1-based) and batches (batch_id, urls).

    No indexes mean all urls of the batch; indexes outside the batch are ignored.
    """
    joined = records.join(batches, "batch_id")
    chosen = F.filter(F.transform("source_indexes", lambda i: F.when(i >= 1, F.get(F.col("urls"), (i - 1).cast("int")))), lambda u: u.isNotNull())
    none = F.col("source_indexes").isNull() | (F.size("source_indexes") == 0)
    return joined.withColumn("source_writeups", F.when(none, F.col("urls")).otherwise(chosen)).drop("urls", "source_indexes")


def technique_stats(files: DataFrame) -> DataFrame:
    """Tricks and bytes of each technique file (name, content)."""
    return files.select("name", (F.size(F.split("content", "\n## ")) - 1).alias("tricks"), F.octet_length("content").alias("bytes"))


def check_report(checks: DataFrame) -> DataFrame:
    """Checks by status, and whether any failed."""
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("failed", F.col("status") == "fail")
