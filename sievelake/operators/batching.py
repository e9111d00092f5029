"""Token-budget batches of documents for a model, and their prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.config import SETTINGS
from sievelake.functions.text import prompt_block, strip
from sievelake.storage import map_texts


def local_batches(writeups: DataFrame, batch_size: int = SETTINGS.batch_size, budget: int = SETTINGS.batch_tokens) -> DataFrame:
    """(id, category, local): numbers of the batches within each category.

    writeups: id, category, challenge_source, tokens, pos. In a category rows go by source
    and pos; a row of the budget or more is a batch of its own; a batch closes before the
    row that would exceed the budget and when it has batch_size rows. Rows arrive sorted
    and are folded as a stream, so a category of any size needs constant memory.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fresh, number, rows, total = None, True, -1, 0, 0
        for batch in batches:
            out = []
            for category, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if fresh or category != group:
                    group, fresh, number, rows, total = category, False, -1, 0, 0
                alone = tokens >= budget
                if not rows or alone or rows >= batch_size or total + tokens > budget:
                    number, rows, total = number + 1, 0, 0
                out.append(number)
                rows, total = (0, 0) if alone else (rows + 1, total + tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["id", "category", "local"])

    rows = writeups.select("id", F.lower(strip(F.col("category"))).alias("category"), "tokens", "challenge_source", "pos")
    ordered = rows.repartition("category").sortWithinPartitions("category", "challenge_source", "pos").select("id", "category", "tokens")
    return map_texts(ordered, fold, "id long, category string, local int")


def number_batches(local: DataFrame, writeups: DataFrame) -> DataFrame:
    """(id, batch_id): batches of the largest category first, categories of one size by first position."""
    first = local.join(writeups.select("id", "pos"), "id").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), (F.max("local") + 1).alias("batches"))
    before = Window.orderBy(F.desc("n"), "first").rowsBetween(Window.unboundedPreceding, -1)  # one row per category
    base = first.select("category", F.coalesce(F.sum("batches").over(before), F.lit(0)).alias("base"))
    return local.join(F.broadcast(base) if base.count() < 100_000 else base, "category").select("id", (F.col("base") + F.col("local")).alias("batch_id"))


def prompts(batched: DataFrame) -> DataFrame:
    """(batch_id, prompt): the numbered documents of each batch; batched has batch_id, pos, challenge_source, challenge_title, challenge_category, cleaned_content."""
    number = F.row_number().over(Window.partitionBy("batch_id").orderBy("pos"))
    block = prompt_block(F.col("n"), F.col("challenge_source"), F.col("challenge_title"), F.col("challenge_category"), F.col("cleaned_content"))
    blocks = batched.withColumn("n", number).select("batch_id", "n", block.alias("block"))
    return blocks.groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "block")))["block"], "\n\n").alias("prompt"))


def unprocessed(batches: DataFrame, done: DataFrame) -> DataFrame:
    """The batches that no finished attempt (batch_id, status) covers; failed and interrupted ones run again."""
    return batches.join(done.where("status = 'completed'").select("batch_id").distinct(), "batch_id", "left_anti")


def micro_batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """rows with the number of their batch of `size` in the given order; for result sets of bounded size."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))
