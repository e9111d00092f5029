import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
EDGE_TEXTS = [
    None, "", " \t\n", "one", "one two", "One  two\nthree", "one two three", "x" * 50_000, "word " * 30_000, "word " * 30_000,
    "Ünïcode çase ÀÉ ß 日本語 😀 text", "a b c d e f g h i j\n" * 40, "trailing \n lines \n\n", "<|endoftext|> is text", "it's we'll 123 4567!!! \r\n ok",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, i % 3 or None, "c") for i, t in enumerate(EDGE_TEXTS)] + [(3, "one", 0, None), (None, "no id here", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket long, component string")
