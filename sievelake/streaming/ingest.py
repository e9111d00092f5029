"""Ingest of new pages as a stream: clean, drop short ones and repeats, append, derive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievelake import schemas
from sievelake.config import SETTINGS
from sievelake.functions.html import clean_html
from sievelake.functions.text import infer_title, strip, worthwhile


def cleaned_pages(pages: DataFrame, least: int = SETTINGS.ingest_min_length) -> DataFrame:
    """url, title, cleaned_content of pages (url, html) long enough to keep; works on tables and streams."""
    cleaned = pages.withColumn("cleaned_content", clean_html(F.col("html")))
    kept = cleaned.where(worthwhile(F.col("cleaned_content"), least))
    return kept.withColumn("title", infer_title(F.col("url"), F.col("cleaned_content")))


def refused_pages(pages: DataFrame, least: int = SETTINGS.ingest_min_length) -> DataFrame:
    """(url, error) of the pages (url, html) that cleaned_pages leaves out: nothing to read, or too little. A null page has nothing to read."""
    text = F.coalesce(clean_html(F.col("html")), F.lit(""))
    rows = pages.select("url", text.alias("text"))
    short = F.concat(F.lit("too short ("), F.length("text").cast("string"), F.lit(" characters)"))
    error = F.when(strip(F.col("text")) == "", "no readable content").when(~F.coalesce(worthwhile(F.col("text"), least), F.lit(False)), short)
    return rows.select("url", error.alias("error")).where("error is not null")


def pasted_writeup(spark: SparkSession, content: str, title: str = "pasted writeup", source: str = "manual", url: str = "", least: int = SETTINGS.ingest_min_length) -> DataFrame:
    """One cleaned writeup of pasted HTML or Markdown; a blank title is inferred, a blank source is 'manual'.

    Raises ValueError with the reason if there is nothing, or too little, to read.
    """
    page = spark.createDataFrame([(url, content)], "url string, html string")
    refused = refused_pages(page, least).first()
    if refused:
        raise ValueError(f"pasted content: {refused.error}")
    cleaned = page.withColumn("cleaned_content", clean_html(F.col("html")))
    named = F.lit(title.strip()) if title.strip() else infer_title(F.col("url"), F.col("cleaned_content"))
    row = cleaned.withColumns({"source": F.lit("content"), "challenge_title": named, "challenge_name": named, "challenge_source": F.lit(source.strip() or "manual")})
    row = row.withColumns({"challenge_category": F.array().cast("array<string>"), "content": F.col("html")})
    return row.select(*(column.split()[0] for column in schemas.WRITEUP.split(", ")))


def new_urls_only(pages: DataFrame, time: str = "ts", late: str = "7 days") -> DataFrame:
    """A stream without urls seen within the watermark, which bounds the state."""
    return pages.withWatermark(time, late).dropDuplicatesWithinWatermark(["url"])


def _replace(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_number={number}")


def start_ingest(pages: DataFrame, accumulator: str, consolidated: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] | None = None, refused: str | None = None) -> StreamingQuery:
    """Write each micro-batch of a page stream as a partition of its own, to the accumulator and from there to the consolidated table.

    A batch overwrites only its own partitions (batch_number=n), so that running it again
    after a failure at any step gives the same tables, and what it costs does not grow with
    what was there before. Every row of the accumulator is in the consolidated table.
    refused names a table of the pages left out and why.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if refused:
            _replace(refused_pages(batch), refused, number)
        rows = (extract or cleaned_pages)(batch).drop("html")
        _replace(rows, accumulator, number)
        _replace(spark.read.schema(rows.schema).parquet(f"{accumulator}/batch_number={number}"), consolidated, number)

    return pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, window: str = "1 hour", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Events per window and type, on a table or a watermarked stream."""
    timed = events.withColumn("__at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__at", late)
    counted = timed.groupBy(F.window("__at", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")
