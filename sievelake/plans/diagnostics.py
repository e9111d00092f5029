"""Checks of settings, inputs and outputs before a run; nothing here reads more than a few rows or a directory's names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.config import SETTINGS
from sievelake.functions.text import masked_key
from sievelake.sources.files import path_exists, sniff_is_array
from sievelake.sources.state import BATCH_STATE, latest_batches, read_totals

OK, WARN, FAIL, SKIP = "ok", "warn", "fail", "skip"
Found = tuple[str, str]


@dataclass(frozen=True)
class Setup:
    """What a run is set up with; empty strings stand for what is not set."""

    llm_key: str = ""
    embedding_key: str = ""
    llm_url: str = ""
    embedding_url: str = ""
    max_output_tokens: int = SETTINGS.max_output_tokens
    data: str = ""
    directories: tuple[str, ...] = ()
    batch_state: str = ""
    files: str = ""
    index: str = ""
    #: Name of a service -> a call that reaches it and says what answered.
    probes: Mapping[str, Callable[[], str]] | None = None


def _key(spark: SparkSession, key: str, missing: str) -> Found:
    if not key:
        return missing, "not set"
    return OK, spark.range(1).select(masked_key(F.lit(key))).first()[0]


def _url(url: str) -> Found:
    return (OK, url) if url else (OK, "the service's own")


def _output_tokens(most: int) -> Found:
    if most > SETTINGS.max_output_tokens:
        return WARN, f"{most} exceeds {SETTINGS.max_output_tokens}: this bounds the output, not the context"
    return OK, str(most)


def _data(spark: SparkSession, path: str) -> Found:
    """Whether the file begins as a list and its first records parse; the whole is not read."""
    if not path or not path_exists(spark, path):
        return FAIL, f"not found at {path or '(no path)'}"
    if not sniff_is_array(spark, path):
        return FAIL, f"{path} is not a JSON list"
    broken = spark.read.option("multiLine", True).schema("_corrupt_record string, url string").json(path).limit(1).collect()
    if broken and broken[0]["_corrupt_record"] is not None:
        return FAIL, f"{path} is not valid JSON"
    return OK, path


def _directories(spark: SparkSession, paths: tuple[str, ...]) -> Found:
    jvm = spark.sparkContext._jvm
    problems = []
    for path in paths:
        probe = jvm.org.apache.hadoop.fs.Path(f"{path}/.probe-{uuid.uuid4().hex}")
        try:
            fs = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.create(probe, True).close()
            fs.delete(probe, False)
        except Exception:  # the file system says in many ways that it cannot be written
            problems.append(path)
    return (FAIL, "not writable: " + ", ".join(problems)) if problems else (OK, f"{len(paths)} writable")


def _batches(spark: SparkSession, path: str) -> Found:
    if not path or not path_exists(spark, path):
        return SKIP, "no run has been started"
    try:
        spark.read.schema(BATCH_STATE).parquet(path).limit(1).collect()
    except Exception as e:
        return WARN, f"unreadable: {type(e).__name__}"
    counted = latest_batches(spark, path).groupBy("status").count().orderBy("status").collect()  # a row for each status
    return OK, ", ".join(f"{r['count']} {r['status']}" for r in counted) or "no batch yet"


def _files(spark: SparkSession, path: str) -> Found:
    if not path or not path_exists(spark, path):
        return SKIP, "none yet"
    texts = spark.read.option("pathGlobFilter", "*.md").text(path)
    found = texts.agg(F.count_distinct(F.col("_metadata.file_path")).alias("files"), F.count_if(F.col("value").startswith("## ")).alias("sections")).first()
    return (OK, f"{found.files} files, {found.sections} sections") if found.files else (SKIP, "none yet")


def _index(spark: SparkSession, path: str) -> Found:
    if not path or not path_exists(spark, path):
        return SKIP, "not built yet"
    try:
        n = read_totals(spark, path).first().n
    except Exception as e:
        return FAIL, f"unreadable: {type(e).__name__}"
    return (OK, f"{n} documents") if n else (WARN, "empty")


def _probe(key: str, call: Callable[[], str] | None) -> Found:
    if not key or call is None:
        return SKIP, "no key" if not key else "no probe"
    try:
        return OK, f"reachable ({call()})"
    except Exception as e:
        return FAIL, f"{type(e).__name__}: {e}"


def diagnose(spark: SparkSession, setup: Setup, connect: bool = True) -> tuple[DataFrame, int]:
    """(name, status, detail) of every check in their order, and the exit code: 1 if one failed, else 0."""
    found = {
        "llm key": _key(spark, setup.llm_key, FAIL),
        "embedding key": _key(spark, setup.embedding_key, WARN),
        "llm url": _url(setup.llm_url),
        "embedding url": _url(setup.embedding_url),
        "output tokens": _output_tokens(setup.max_output_tokens),
        "data": _data(spark, setup.data),
        "directories": _directories(spark, setup.directories),
        "batches": _batches(spark, setup.batch_state),
        "technique files": _files(spark, setup.files),
        "index": _index(spark, setup.index),
    }
    if connect:
        probes = setup.probes or {}
        found["llm"] = _probe(setup.llm_key, probes.get("llm"))
        found["embedding"] = _probe(setup.embedding_key, probes.get("embedding"))
    rows = [(n, name, status, detail) for n, (name, (status, detail)) in enumerate(found.items())]
    report = spark.createDataFrame(rows, "n int, name string, status string, detail string")
    return report.orderBy("n").drop("n"), int(any(status == FAIL for status, _ in found.values()))


def as_json(report: DataFrame) -> str:
    """The report as one JSON list; a row for each check."""
    return json.dumps([r.asDict() for r in report.collect()], ensure_ascii=False)
