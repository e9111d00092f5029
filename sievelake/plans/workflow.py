"""The pipeline's entry points: extraction, deduplication in two stages, refresh, preview, health report."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake import schemas
from sievelake.config import SETTINGS
from sievelake.functions.text import embed_text, words
from sievelake.models import Embedder, Extractor, Judge, embed_column, extract_resolved
from sievelake.operators import similarity as M
from sievelake.operators.canonical import canonical_names, merged_mapping, regroup
from sievelake.operators.chunking import chunk_files
from sievelake.operators.cluster import leader_clusters, merge_clusters, routed_groups
from sievelake.operators.components import connected_components
from sievelake.operators.evidence import group_evidence, trick_evidence, with_evidence
from sievelake.operators.incremental import refresh_vectors
from sievelake.operators.relational import remove_source
from sievelake.operators.render import preview, render_files
from sievelake.prompts import extraction_message
from sievelake.sources.files import with_trick_defaults
from sievelake.sources.state import write_index
from sievelake.storage import Scratch, map_texts

_STRINGS, _NUMBERS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
_KINDS = {"conditions": _STRINGS, "implementation_steps": _STRINGS, "detection_signs": _STRINGS, "confidence": T.DoubleType(), "source_indexes": _NUMBERS}
_FIELDS = (
    "technique_name", "title", "category", "description", "conditions", "implementation_steps", "key_code", "example", "example_challenge",
    "detection_signs", "confidence", "source_indexes",
)
_RECORD = T.StructType([T.StructField(name, _KINDS.get(name, T.StringType())) for name in _FIELDS])


def _typed(record: dict) -> dict:
    """A model's record with the schema's types; what does not fit is null."""
    out = {}
    for field in _RECORD:
        value = record.get(field.name)
        if isinstance(field.dataType, T.ArrayType):
            numbers = isinstance(field.dataType.elementType, T.IntegerType)
            items = value if isinstance(value, list) else []
            fitting = [v for v in items if (isinstance(v, int) and not isinstance(v, bool)) or not numbers]
            out[field.name] = [v if numbers else str(v) for v in fitting if v is not None] if isinstance(value, list) else None
        elif isinstance(field.dataType, T.DoubleType):
            out[field.name] = float(value) if isinstance(value, int | float) else None
        else:
            out[field.name] = value if value is None or isinstance(value, str) else str(value)
    return out


def batch_items(batched: DataFrame) -> DataFrame:
    """(batch_id, items) of rows with batch_id, pos, url and what a prompt shows; a batch has a bounded number of rows."""
    item = F.struct("pos", "url", "challenge_source", "challenge_title", "challenge_category", "cleaned_content")
    return batched.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _prompt(items: list[dict]) -> str:
    blocks = (
        f"<writeup_{n}>\nSource: {i['challenge_source']}\nChallenge: {i['challenge_title']}\nCategory: {', '.join(i['challenge_category'] or []) or 'unknown'}\n"
        f"Content:\n{i['cleaned_content']}\n</writeup_{n}>"
        for n, i in enumerate(items, 1)
    )
    return extraction_message("\n\n".join(blocks))


def _sources(items: list[dict], indexes: list[int] | None) -> list[str]:
    """URLs at 1-based indexes; of all items where none is given, of none where none is valid."""
    return [items[k - 1]["url"] for k in indexes if 1 <= k <= len(items)] if indexes else [i["url"] for i in items]


def extract_tricks(batches: DataFrame, extractor: Extractor, created_at: str, concurrency: int = 8, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of batches (batch_id, items) by the model, at most `concurrency` at a time.

    A batch that fails its retries is halved, a single document cut and tried once more;
    what stays unresolved is in failures (batch_id, unresolved_urls), with the other
    documents' records kept. Answers are written before use, so no batch is asked twice.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for number, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                answers, unresolved = extract_resolved(extractor, items, _prompt, sleep=sleep)
                typed = [(part, _typed(r)) for part, found in answers for r in found]
                records = [{**r, "source_writeups": _sources(part, r.pop("source_indexes"))} for part, r in typed]
                columns = [pa.array([number]), pa.array([[i["url"] for i in unresolved]], pa.list_(pa.string())), pa.array([records], pa.list_(inner))]
                yield pa.RecordBatch.from_arrays(columns, names=["batch_id", "unresolved_urls", "records"])

    kinds = {T.StringType(): pa.string(), T.DoubleType(): pa.float64(), _STRINGS: pa.list_(pa.string())}
    record = T.StructType([*(f for f in _RECORD if f.name != "source_indexes"), T.StructField("source_writeups", _STRINGS)])
    inner = pa.struct([(f.name, kinds[f.dataType]) for f in record])
    schema = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("unresolved_urls", _STRINGS), T.StructField("records", T.ArrayType(record))])
    answered = map_texts(batches.select("batch_id", "items").repartition(concurrency), run, schema)
    answered = Scratch(batches.sparkSession, "extract").save(answered, "answers")
    flat = answered.select(F.explode("records").alias("r")).select("r.*").where("technique_name <> '' and title <> ''")
    made = flat.withColumns({"original_terms": F.array("technique_name"), "created_at": F.lit(created_at)})
    records = with_trick_defaults(made).select(*(column.split()[0] for column in schemas.TRICK.split(", ")))
    return records, answered.where(F.size("unresolved_urls") > 0).select("batch_id", "unresolved_urls")


def lexical_dedup(tricks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Stage one: records under canonical techniques, near-duplicates of each technique merged. tricks: a record's fields and id."""
    names = canonical_names(tricks.select(F.col("technique_name").alias("name")), aliases)
    named = tricks.join(names, tricks.technique_name == names.name).withColumn("technique", F.col("canonical")).drop("name", "canonical")
    clusters = leader_clusters(named).select("id", F.col("leader").alias("cluster"))
    placed = named.join(clusters, "id").withColumns({"pos": F.col("id"), "technique_name": F.col("technique")})
    return merge_clusters(placed).withColumn("technique", F.col("technique_name")).withColumnRenamed("cluster", "id")


def merge_techniques(tricks: DataFrame, aliases: DataFrame, judge: Judge | None = None) -> tuple[DataFrame, DataFrame]:
    """(mapping old -> merged, judged pairs): techniques alike in name or content, united transitively, judged ones included."""
    scratch = Scratch(tricks.sparkSession, "techniques")
    groups = tricks.groupBy(F.col("technique").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    canon = aliases.select(F.col("canonical").alias("name")).distinct().withColumn("is_canonical", F.lit(True))
    groups = groups.join(canon, "name", "left").withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)))
    by_name = M.name_pairs(groups.select(F.col("name").alias("id")))
    by_content = M.content_pairs(tricks.select("technique", "title"))
    bags = tricks.select(F.col("technique").alias("id"), F.explode(words(F.col("title"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))
    evidence = by_name.join(by_content, ["a", "b"], "left").join(M.bag_jaccard(bags, by_name.select("a", "b")), ["a", "b"])
    decided = scratch.save(M.classify_names(evidence, judged=judge is not None), "decided")
    accepted = decided.where("decision = 'merge'").select("a", "b").union(by_content.select("a", "b"))
    pending = decided.where("decision = 'judge'").withColumn("similarity", F.col("ratio") / 100)
    if judge is not None:
        judged = scratch.save(judge.judge(with_evidence(pending, group_evidence(tricks))), "judged")  # no pair is asked about twice
        accepted = accepted.union(judged.where("verdict = 'merge'").select("a", "b"))
    return merged_mapping(groups, accepted.distinct(), scratch), pending


def dedup_tricks(tricks: DataFrame, embedder: Embedder | None = None, judge: Judge | None = None) -> DataFrame:
    """Stage two over lexically deduplicated records (id, technique, ...): candidates of three joins, decided by vectors and judge, merged and routed."""
    scratch = Scratch(tricks.sparkSession, "tricks")
    rows = scratch.save(tricks.withColumn("cluster", F.col("id")), "rows")
    pairs = M.dedup_candidates(rows)
    texts = rows.select("id", embed_text(F.col("title"), F.col("description")).alias("content"))
    vectors = embed_column(texts, embedder).select("id", "embedding") if embedder else rows.sparkSession.createDataFrame([], "id long, embedding array<float>")
    decided = scratch.save(M.vector_decisions(pairs, vectors, judged=judge is not None), "decided")
    accepted = decided.where("decision = 'merge'").select("a", "b")
    if judge is not None:
        grey = decided.where("decision = 'grey'").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
        judged = scratch.save(judge.judge(with_evidence(grey, trick_evidence(rows))), "judged")
        accepted = accepted.union(judged.where("verdict = 'merge'").select("a", "b"))
    labels = scratch.save(connected_components(accepted, scratch), "labels")
    routes = routed_groups(rows.select("id", "technique", "confidence"), labels)
    placed = rows.drop("cluster").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component")
    routed = placed.drop("technique").join(routes.withColumnRenamed("component", "cluster"), "cluster")
    merged = merge_clusters(routed.withColumns({"pos": F.col("id"), "technique_name": F.col("technique")}))
    return merged.withColumn("technique", F.col("technique_name")).withColumnRenamed("cluster", "id")


def distil(tricks: DataFrame, aliases: DataFrame, writeups: DataFrame | None = None) -> DataFrame:
    """(name, content): records to technique files, by way of lexical dedup and merged techniques."""
    merged = lexical_dedup(tricks, aliases)
    mapping, _ = merge_techniques(merged, aliases)
    return render_files(regroup(merged, mapping), writeups)


def reprocess(tricks: DataFrame, aliases: DataFrame, embedder: Embedder, vectors: DataFrame, state: DataFrame, index_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, vectors, state) after deduplication, with vectors of changed chunks only and the search index rebuilt at index_path."""
    scratch = Scratch(tricks.sparkSession, "reprocess")
    files = scratch.save(distil(tricks, aliases), "files")
    chunks = scratch.save(chunk_files(files), "chunks")
    fresh, now = refresh_vectors(chunks, vectors, state, embedder)
    write_index(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), index_path)
    return files, scratch.save(fresh, "vectors"), scratch.save(now, "state")


def replace_url(tricks: DataFrame, url: str, fresh: DataFrame) -> DataFrame:
    """Records after one source was extracted anew: its old records go, or lose the source, and the fresh ones are added."""
    return remove_source(tricks, url).unionByName(fresh, allowMissingColumns=True)


def preview_chunks(tricks: DataFrame) -> DataFrame:
    """What would be embedded for records, without storing anything."""
    return chunk_files(preview(tricks).withColumnRenamed("technique", "name"))


def dedup_stats(before: DataFrame, after: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: records before and after, merges, candidate pairs."""
    one = [before.agg(F.count(F.lit(1)).alias("tricks")), after.agg(F.count(F.lit(1)).alias("clusters")), candidates.agg(F.count(F.lit(1)).alias("candidates"))]
    joined = reduce(lambda a, b: a.crossJoin(b), one)  # one row each
    return joined.withColumn("merges", F.col("tricks") - F.col("clusters"))


def health(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(name, status, rows): ok, warn if empty, fail if missing, of each table."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    counted = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items() if df is not None]
    missing = spark.createDataFrame([(n, None) for n, df in tables.items() if df is None], "name string, rows long")
    every = reduce(lambda a, b: a.unionByName(b), counted).unionByName(missing)
    return every.withColumn("status", F.when(F.col("rows").isNull(), "fail").when(F.col("rows") == 0, "warn").otherwise("ok"))


def token_usage(writeups: DataFrame) -> DataFrame:
    return writeups.agg(F.sum(F.floor(F.length("cleaned_content") / SETTINGS.chars_per_token)).alias("tokens"))
