"""State that outlives a run: batch status, chunk hashes, the search index, alias overrides, fetched pages."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators.search import TERM, build_postings, terms
from sievelake.sources.files import path_exists, snapshot

BATCH_STATE = "batch_id long, status string, unresolved_urls array<string>, updated_at timestamp"
CHUNK_STATE = "chunk_id string, sha256 string"
#: Files of the index, by hash of the term, so that a query reads few of them.
INDEX_PARTS = 64


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table; a missing or unreadable one is a fresh start."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path)
    try:
        found.limit(1).collect()  # a read is lazy: only this tells whether the files can be read
    except Exception:
        return spark.createDataFrame([], schema)
    return found


def record_batches(done: DataFrame, path: str) -> None:
    """Append outcomes (batch_id, status, unresolved_urls); the latest row of a batch counts."""
    done.withColumn("updated_at", F.current_timestamp()).select("batch_id", "status", "unresolved_urls", "updated_at").write.mode("append").parquet(path)


def latest_batches(spark: SparkSession, path: str) -> DataFrame:
    state = read_state(spark, path, BATCH_STATE)
    newest = state.groupBy("batch_id").agg(F.max_by(F.struct("status", "unresolved_urls"), "updated_at").alias("s"))
    return newest.select("batch_id", "s.*")


def reset_state(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_index(docs: DataFrame, path: str, lowercase: bool = False, pattern: str = TERM) -> None:
    """Replace the inverted index of docs (doc_id, text); postings lie in files by hash of their term, sorted by it, the totals beside them."""
    _laid_out(build_postings(docs, lowercase, pattern)).write.mode("overwrite").partitionBy("part").parquet(path)
    _totals(docs, lowercase, pattern).write.mode("overwrite").parquet(f"{path}.totals")


def _totals(docs: DataFrame, lowercase: bool, pattern: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(terms(F.col("text"), lowercase, pattern))), F.lit(0)).alias("total"))


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row (n, mean): documents of the index and their mean length."""
    return spark.read.parquet(f"{path}.totals").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))


def add_to_index(docs: DataFrame, path: str, lowercase: bool = False) -> None:
    """Append the postings, and the totals, of documents that are not in the index yet."""
    spark = docs.sparkSession
    known = spark.read.parquet(path).select("doc_id").distinct()
    new = docs.join(known, "doc_id", "left_anti")
    totals = _totals(new, lowercase, TERM).collect()  # before the postings are there
    _laid_out(build_postings(new, lowercase)).write.mode("append").partitionBy("part").parquet(path)
    spark.createDataFrame(totals, "n long, total long").write.mode("append").parquet(f"{path}.totals")


def _laid_out(postings: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64("term"), F.lit(INDEX_PARTS)).cast("int")
    return postings.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("part", "term")


def read_index(spark: SparkSession, path: str, query_terms: list[str] | None = None) -> DataFrame:
    """The postings, or those of the query's terms: the parts they hash to are pruned, the term filter reaches the files."""
    postings = spark.read.parquet(path)
    return postings.drop("part") if query_terms is None else of_terms(postings, query_terms)


def of_terms(postings: DataFrame, query_terms: list[str]) -> DataFrame:
    """The postings (with their part) of some terms; their parts are constants that the driver folds, without a job."""
    parts = [F.pmod(F.xxhash64(F.lit(t)), F.lit(INDEX_PARTS)).cast("int") for t in query_terms]
    wanted = sorted(set(postings.sparkSession.sql("SELECT 1").select(F.array(*parts).cast("array<int>")).first()[0]))  # at most INDEX_PARTS
    return postings.where(F.col("part").isin(wanted) & F.col("term").isin(query_terms)).drop("part")


def read_alias_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical, pos) of the `technique_mapping` block of a YAML file of plain `key: value` lines; anything else is ignored."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "alias string, canonical string, pos long")
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?ms)^technique_mapping:[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\z))*)", 1).alias("block"))
    line = F.regexp_extract_all("block", F.lit(r"(?m)^[ \t]+([^:#\n]+?)[ \t]*:[ \t]*([^#\n]+?)[ \t]*(?:#.*)?$"), F.lit(0))
    rows = text.select(F.posexplode(line).alias("pos", "line"))
    bare = lambda c: F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")
    key, value = F.substring_index("line", ":", 1), F.regexp_replace(F.expr("substring(line, length(substring_index(line, ':', 1)) + 2)"), "[ \t]+#.*$", "")
    return rows.select(bare(key).alias("alias"), bare(value).alias("canonical"), F.col("pos").cast("long").alias("pos"))


def write_alias_overrides(aliases: DataFrame, path: str) -> None:
    """The alias table (alias, canonical) as one `technique_mapping` block in order of alias, as read_alias_overrides reads it.

    Names hold no colon, number sign or quote: clean names never do. Null names are left out.
    """
    lines = aliases.where("alias is not null and canonical is not null").select(F.col("alias").alias("at"), F.concat(F.lit("  "), "alias", F.lit(": "), "canonical").alias("value"))
    head = aliases.sparkSession.createDataFrame([(None, "technique_mapping:")], lines.schema)
    block = head.unionByName(lines).coalesce(1).sortWithinPartitions(F.asc_nulls_first("at"), "value")  # a table that people keep by hand
    block.select("value").write.mode("overwrite").text(path)


def save_questions(questions: DataFrame, path: str) -> DataFrame:
    """Append the questions (technique_name, question_text) of techniques that the stored table has none of; returns the table."""
    spark = questions.sparkSession
    if path_exists(spark, path):
        questions = questions.join(spark.read.parquet(path).select("technique_name").distinct(), "technique_name", "left_anti")
    questions.select("technique_name", "question_text").write.mode("append").parquet(path)
    return spark.read.parquet(path)


class Fetcher(Protocol):
    def fetch(self, urls: DataFrame) -> DataFrame:
        """(url, html) of the urls that could be read."""


class TableFetcher:
    """Pages from a table (url, html) instead of the network."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def fetch(self, urls: DataFrame) -> DataFrame:
        return self.pages.select("url", "html").join(urls.select("url").distinct(), "url", "left_semi")


def reset_collection(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table in place of a collection."""
    snapshot(spark.createDataFrame([], schema), path)


def save_urls(urls: DataFrame, path: str) -> None:
    """One URL per line."""
    urls.select("url").orderBy("url").write.mode("overwrite").text(path)
