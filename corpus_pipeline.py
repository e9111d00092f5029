"""A training-data pipeline over the documents table, in five stages.

toxicity (documents it rejects go), line dedup, near-duplicates (one document of each group
stays), PII surrogates, best-fit packing. Each stage takes (spark, docs, sf_dir) and works
on all rows its predecessor kept; between stages the documents are a written Parquet table.
All stages but the last return the columns of documents, with n_chars following the text.
A null text counts as empty: it is never toxic or a near-duplicate and is packed as its end
id. A repeated row is a copy of itself, of which near-duplicates keep one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.line_dedup import drop_frequent_lines
from sievelake.llm.near_dedup import keep_one
from sievelake.llm.packing import pack_documents
from sievelake.llm.pii import replace_pii, session_key
from sievelake.llm.toxicity import score_documents, train
from sievelake.storage import Scratch, ship_package, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    return _recounted(drop_frequent_lines(_documents(docs), least_docs=10, least_chars=1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    return keep_one(_documents(docs), words=5, percent=80, bands=32, rows=5).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    return _recounted(replace_pii(_documents(docs), session_key(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    return pack_documents(_documents(docs), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=2048, end_id=0)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near-duplicates", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL can express neither the trained scores, nor the surrogates, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces and places of the packed sequences made from the documents table."""
    ship_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = scratch.save(docs, name.replace(" ", "-"))
    return docs
