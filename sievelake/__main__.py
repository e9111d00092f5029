"""python -m sievelake COMMAND ...

list                            names of the queries
run QUERY DIR [ROWS]            show a query over the tables in DIR
write QUERY DIR TARGET          write its result as Parquet
build-index DOCS INDEX          index a Parquet table (doc_id, text)
add-to-index DOCS INDEX         add the documents that the index lacks
query INDEX TEXT [ROWS]         best documents of a stored index
dedup TRICKS ALIASES TARGET     records of a JSON file to technique files, aliases from a YAML file
check DATA [INDEX]              diagnostics, keys from SIEVELAKE_LLM_KEY and SIEVELAKE_EMBEDDING_KEY; 1 if one fails
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievelake.operators.search import bm25_from_index, terms
from sievelake.plans import catalog
from sievelake.plans.diagnostics import Setup, diagnose
from sievelake.plans.workflow import distil
from sievelake.sources.files import read_tricks, write_markdown
from sievelake.sources.state import add_to_index, read_alias_overrides, read_index, read_totals, write_index
from sievelake.storage import Scratch, ship_package


def _run(spark: SparkSession, name: str, tables: str, rows: str = "20") -> int:
    catalog.QUERIES[name](spark, tables).show(int(rows), truncate=80)
    return 0


def _write(spark: SparkSession, name: str, tables: str, target: str) -> int:
    catalog.QUERIES[name](spark, tables).write.mode("errorifexists").parquet(target)
    return 0


def _build_index(spark: SparkSession, docs: str, index: str) -> int:
    write_index(spark.read.parquet(docs).select("doc_id", "text"), index)
    return 0


def _add_to_index(spark: SparkSession, docs: str, index: str) -> int:
    add_to_index(spark.read.parquet(docs).select("doc_id", "text"), index)
    return 0


def _query(spark: SparkSession, index: str, text: str, rows: str = "10") -> int:
    asked = spark.sql("SELECT 1").select(F.array_distinct(terms(F.lit(text)))).first()[0]
    if asked:
        scores = bm25_from_index(read_index(spark, index, asked), read_totals(spark, index), asked)
        scores.orderBy(F.desc("score"), "doc_id").show(int(rows))
    return 0


def _dedup(spark: SparkSession, tricks: str, aliases: str, target: str) -> int:
    numbered = Scratch(spark, "dedup").save(read_tricks(spark, tricks).withColumn("id", F.monotonically_increasing_id()), "numbered")
    write_markdown(distil(numbered, read_alias_overrides(spark, aliases)), target, spark)
    return 0


def _check(spark: SparkSession, data: str, index: str = "") -> int:
    keys = os.environ.get("SIEVELAKE_LLM_KEY", ""), os.environ.get("SIEVELAKE_EMBEDDING_KEY", "")
    report, code = diagnose(spark, Setup(*keys, data=data, index=index), connect=False)
    report.show(truncate=False)
    return code


#: Command -> (function, least and most arguments).
COMMANDS: dict[str, tuple[Callable[..., int], int, int]] = {
    "run": (_run, 2, 3),
    "write": (_write, 3, 3),
    "build-index": (_build_index, 2, 2),
    "add-to-index": (_add_to_index, 2, 2),
    "query": (_query, 2, 3),
    "dedup": (_dedup, 3, 3),
    "check": (_check, 1, 2),
}


def main(args: list[str]) -> int:
    if args == ["list"]:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    command, least, most = COMMANDS.get(args[0] if args else "", (None, 0, 0))
    given = args[1:]
    if command is None or not least <= len(given) <= most or (command in (_run, _write) and given[0] not in catalog.QUERIES):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("sievelake").getOrCreate()
    ship_package(spark)
    return command(spark, *given)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
