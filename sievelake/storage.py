"""Shared scratch tables, table loading and worker set-up.

Long lineages are cut by writing a table to the folder that the cluster names in
``spark.checkpoint.dir`` and reading it back: unlike a block in an executor's
memory, such a table survives the loss of executors.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the session names none, one in the warehouse, which driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables that one call writes to the shared folder and may drop again.

    A result that is not computed yet may still read them, so what is not dropped goes when
    the driver's JVM ends; clear_scratch() removes it before, once results have been used.
    """

    _bases: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[str, str] = {}
        fs, where = _located(spark, self.base)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        self._bases.append(self.base)

    def path(self, name: str) -> str:
        self._n += 1
        self._paths[name] = f"{self.base}/{self._n:03d}-{name}"
        return self._paths[name]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table; a table saved earlier under this name is dropped."""
        old = self._paths.get(name)
        path = self.path(name)
        df.write.parquet(path)
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self._paths.pop(name, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        fs, where = _located(self.spark, path)
        fs.delete(where, True)


def _located(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this process; results that still read them must have been written or collected before."""
    while Scratch._bases:
        fs, where = _located(spark, Scratch._bases.pop())
        fs.delete(where, True)


def spare_name(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column (whatever its case) is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes that an operator in Python works on at a time; Spark itself bounds what it sends by spark.sql.execution.arrow.maxBytesPerBatch.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in portions (without copying) of bounded rows and, by a batch's mean, bytes."""
    for batch in batches:
        rows = max(1, min(TEXT_ROWS, batch.num_rows * TEXT_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What a worker process keeps from task to task, for one operator at a time.
_kept: dict[str, Any] = {}


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """What make() gave this worker under this name, kept until a task of another operator comes."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def _forget() -> None:
    _kept.clear()


def map_texts(df: DataFrame, run: Callable, schema: str | StructType, keeps: bool = False) -> DataFrame:
    """df.mapInArrow with this package on the workers, over portions small enough for long texts.

    Unless the operator itself keeps something in its workers, what another one kept there goes.
    """
    ship_package(df.sparkSession)

    def portioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _forget()
        yield from run(_portions(batches))

    return df.mapInArrow(portioned, schema)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers that start from now on find this package beside the driver's copy."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
