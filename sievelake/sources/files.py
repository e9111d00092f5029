"""Readers and writers of the pipeline's file formats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake import schemas
from sievelake.config import SETTINGS
from sievelake.functions.html import clean_html
from sievelake.functions.text import worthwhile
from sievelake.storage import map_texts

_LISTS = ("conditions", "implementation_steps", "detection_signs")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def modified(spark: SparkSession, path: str) -> int:
    """Milliseconds of the last change of a file or table; 0 if there is none."""
    if not path_exists(spark, path):
        return 0
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()


def read_json_array(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of JSON arrays; a missing path is an empty table, malformed records go, or fail the read if strict."""
    if not strict and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return _parsed(spark.read.option("multiLine", True), path, schema, strict)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of JSON lines; blank and malformed lines go."""
    if not strict and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return _parsed(spark.read, path, schema, strict)


def _parsed(reader, path: str, schema: str, strict: bool) -> DataFrame:
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sniff_is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first visible character of the file is '['."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1)).head()
    return bool(first) and first[0] == "["


def read_tricks(spark: SparkSession, path: str) -> DataFrame:
    """Records of either layout; null lists are empty, but a record whose source_writeups is null goes, as do malformed ones."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.TRICK)
    schema = T.StructType.fromDDL(schemas.TRICK)
    if sniff_is_array(spark, path):
        found = read_json_array(spark, path, schemas.TRICK)
    else:
        parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), F.get_json_object("value", "$.source_writeups").alias("s"), "value")
        explicit_null = F.col("s").isNull() & F.col("value").rlike(r'"source_writeups"\s*:\s*null')
        found = parsed.where(F.col("r.technique_name").isNotNull() & ~explicit_null).select("r.*")
    return with_trick_defaults(found)


def with_trick_defaults(tricks: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    filled = {c: F.coalesce(c, empty) for c in (*_LISTS, "source_writeups", "original_terms")}
    return tricks.withColumns(filled | {"description": F.coalesce("description", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def read_markdown_dir(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the .md files of a directory, name being the file's stem."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    stem = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/]+)\.md$", 1)
    return files.select(stem.alias("name"), F.col("value").alias("content"))


def clean_writeups(raw: DataFrame, least: int = SETTINGS.min_content_length) -> DataFrame:
    """Raw writeups with cleaned_content, without those too short; a missing title falls back to the name."""
    cleaned = raw.withColumn("cleaned_content", clean_html(F.col("content")))
    cleaned = cleaned.withColumn("challenge_title", F.coalesce("challenge_title", "challenge_name", F.lit("")))
    return cleaned.where(worthwhile(F.col("cleaned_content"), least))


def load_writeups(spark: SparkSession, source: str, cache: str | None = None) -> DataFrame:
    """Cleaned writeups of a JSON array; from the cache table if that is not older than the source, else refreshed into it."""
    if cache and modified(spark, cache) >= max(1, modified(spark, source)):
        return spark.read.parquet(cache)
    cleaned = clean_writeups(read_json_array(spark, source, schemas.WRITEUP))
    if not cache:
        return cleaned
    cleaned.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def lookup_url(url: str, cleaned: DataFrame, raw: DataFrame) -> DataFrame:
    """The first writeup of a url, from the cleaned table, else from the raw one after cleaning it."""
    first = cleaned.where(F.col("url") == url).withColumn("__from", F.lit(0))
    second = clean_writeups(raw.where(F.col("url") == url), 0).withColumn("__from", F.lit(1))
    return first.unionByName(second, allowMissingColumns=True).orderBy("__from").limit(1).drop("__from")


def decoded_upload(data: Column) -> Column:
    """UTF-8 with replacement characters for what is invalid; blank uploads are null."""
    text = F.make_valid_utf8(data.cast("string"))
    return F.when(F.trim(text) != "", text)


def write_markdown(files: DataFrame, path: str, spark: SparkSession) -> None:
    """One .md file per (name, content) under path; files not written now are removed. Names are few, so the driver asks for them in order."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = fs_path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    written = set()
    for row in files.toLocalIterator():
        stream = fs.create(fs_path(f"{path}/{row.name}.md"), True)
        stream.write(bytearray(row.content.encode()))
        stream.close()
        written.add(f"{row.name}.md")
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.endswith(".md") and name not in written:
            fs.delete(status.getPath(), False)


def write_json_array(df: DataFrame, path: str, files: int | None = None) -> None:
    """Records as JSON arrays, a record a line, one array for each file of the directory; `files` bounds their number."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["  # before the first record; a comma before each later one
        for batch in batches:
            lines = []
            for record in batch.column(0).to_pylist():
                lines.append(f"{mark}{record}")
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    records = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    records = records.coalesce(files) if files else records
    map_texts(records, framed, "value string").write.mode("overwrite").text(path)


def snapshot(df: DataFrame, path: str, keep_backup: bool = False, stamp: str = "backup") -> None:
    """Replace a table; with keep_backup the old one stays beside it under a stamped name."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = f"{path}.new"
    df.write.mode("overwrite").parquet(fresh)
    if fs.exists(fs_path(path)):
        if keep_backup:
            fs.rename(fs_path(path), fs_path(f"{path}.{stamp}"))
        else:
            fs.delete(fs_path(path), True)
    fs.rename(fs_path(fresh), fs_path(path))


def append_and_rebuild(new: DataFrame, accumulator: str, consolidated: str) -> DataFrame:
    """Append records to the accumulator and rebuild the consolidated table from all of it."""
    new.write.mode("append").parquet(accumulator)
    everything = new.sparkSession.read.parquet(accumulator)
    snapshot(everything, consolidated)
    return new.sparkSession.read.parquet(consolidated)
