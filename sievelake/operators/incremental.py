"""Content-hash incremental updates of chunks, vectors and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import content_hash
from sievelake.models import Embedder, embed_column, question_templates


def chunk_changes(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """(chunk_id, sha256, change): new, changed, same or deleted; state has chunk_id and sha256 of the last run."""
    now = chunks.select("chunk_id", content_hash(F.col("content")).alias("sha256"))
    before = state.select("chunk_id", F.col("sha256").alias("was"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("sha256").isNull(), "deleted").when(F.col("sha256") != F.col("was"), "changed").otherwise("same")
    return now.join(before, "chunk_id", "full_outer").select("chunk_id", "sha256", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """old with the rows of new in place of those with their keys, and without the deleted keys."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new)


def refresh_vectors(chunks: DataFrame, vectors: DataFrame, state: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(vectors, state) after embedding only new and changed chunks and dropping deleted ones, their state included."""
    changes = chunk_changes(chunks, state)
    todo = chunks.join(changes.where("change in ('new', 'changed')").select("chunk_id"), "chunk_id", "left_semi")
    fresh = embed_column(todo, embedder)
    gone = changes.where("change = 'deleted'")
    return upsert(vectors, fresh.select(*vectors.columns), "chunk_id", gone), changes.where("change <> 'deleted'").select("chunk_id", "sha256")


def refresh_questions(chunks: DataFrame, questions: DataFrame, changes: DataFrame) -> DataFrame:
    """Questions (technique_name, question_text): regenerated for techniques with changed chunks, dropped for vanished ones."""
    touched = chunks.join(changes.where("change in ('new', 'changed')"), "chunk_id", "left_semi").select("technique_name").distinct()
    kept = questions.join(touched, "technique_name", "left_anti").join(chunks.select("technique_name").distinct(), "technique_name", "left_semi")
    name = F.translate("technique_name", "_", " ")
    texts = [F.lit(part) for t in question_templates("\x00") for part in t.split("\x00")]
    made = F.array(*(F.concat(texts[i], name, texts[i + 1]) for i in range(0, len(texts), 2)))
    return kept.unionByName(touched.select("technique_name", F.explode(made).alias("question_text")))


def numbered_questions(questions: DataFrame, start: int = 0) -> DataFrame:
    """questions with q_id `q_<n>`, numbered within techniques in order, techniques by name, without one task for all rows."""
    within = Window.partitionBy("technique_name").orderBy("question_text")
    counts = questions.groupBy("technique_name").agg(F.count(F.lit(1)).alias("n"))  # one row per technique
    before = Window.orderBy("technique_name").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("technique_name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = questions.withColumn("nth", F.row_number().over(within)).join(base, "technique_name")
    return numbered.select(F.concat(F.lit("q_"), (F.col("base") + F.col("nth") - 1 + start).cast("string")).alias("q_id"), "technique_name", "question_text")
