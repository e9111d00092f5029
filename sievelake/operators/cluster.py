"""Leader clustering of near-duplicate records, and merging of clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.operators.similarity import CODE, DESCRIPTION, DUPLICATE, SAME_CODE, SHORT_SIMILARITY, SHORT_TOKENS, STEPS, TITLE, with_tokens
from sievelake.storage import map_texts

_WORDS = re.compile(r"\w+")


def _share(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class _Tokens:
    def __init__(self, title: str | None, description: str | None, steps: list[str] | None, code: str | None):
        texts = (title or "", description or "", " ".join(steps or []), code or "")
        self.title, self.desc, self.steps, self.code = (frozenset(_WORDS.findall(t.lower())) for t in texts)
        self.total = sum(map(len, (self.title, self.desc, self.steps, self.code)))
        self.all = self.title | self.desc | self.steps | self.code

    def duplicates(self, other: _Tokens) -> bool:
        if (self.title or self.desc) and self.title == other.title and self.desc == other.desc:
            return True
        code = _share(self.code, other.code)
        likeness = TITLE * _share(self.title, other.title) + DESCRIPTION * _share(self.desc, other.desc) + STEPS * _share(self.steps, other.steps) + CODE * code
        if code >= SAME_CODE:
            likeness = max(code, likeness)
        if likeness < DUPLICATE:
            return False
        return code >= SAME_CODE or not (self.total < SHORT_TOKENS and other.total < SHORT_TOKENS and likeness < SHORT_SIMILARITY)


def leader_clusters(tricks: DataFrame) -> DataFrame:
    """(id, technique, leader): in each technique, by falling confidence and size, a record joins the earliest leader it duplicates, else leads.

    tricks: id, technique, title, description, implementation_steps, key_code, confidence,
    created_at. The rule depends on order, so a technique is one ordered fold. Its rows come
    sorted from the shuffle and are streamed: only leaders stay in memory, and a record
    meets only leaders that share a word with it.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: str | None = None
        started = False
        leaders: list[tuple[int, _Tokens]] = []
        by_word: dict[str, list[int]] = {}
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if not started or row["technique"] != group:
                    group, started, leaders, by_word = row["technique"], True, [], {}
                tokens = _Tokens(row["title"], row["description"], row["implementation_steps"], row["key_code"])
                near = sorted({k for word in tokens.all for k in by_word.get(word, ())})
                leader = next((leaders[k][0] for k in near if leaders[k][1].duplicates(tokens)), None)
                if leader is None:
                    leader = row["id"]
                    for word in tokens.all:
                        by_word.setdefault(word, []).append(len(leaders))
                    leaders.append((leader, tokens))
                found.append(leader)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("technique"), pa.array(found, pa.int64())], names=["id", "technique", "leader"])

    sized = with_tokens(tricks).withColumn("__total", sum((F.size(F.col("tok")[c]) for c in ("title", "desc", "steps", "code")), F.lit(0))).drop("tok")
    ordered = sized.repartition("technique").sortWithinPartitions("technique", F.desc("confidence"), F.desc("__total"), "title", "created_at", "id")
    columns = ["id", "technique", "title", "description", "implementation_steps", "key_code"]
    return map_texts(ordered.select(*columns), fold, "id long, technique string, leader long")


def merge_clusters(tricks: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One record per cluster: scalars of the best member, lists united in order, mean confidence, earliest date.

    tricks carry pos, their order. The best member has the highest confidence, then the most
    content, then the most sources, then the first position.
    """
    size = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("description", F.lit("")))
    size = size + F.aggregate(F.coalesce("implementation_steps", F.array().cast("array<string>")), F.lit(0), lambda s, x: s + F.length(x))
    rank = F.struct("confidence", size, F.size(F.coalesce("source_writeups", F.array().cast("array<string>"))), -F.col("pos"))
    best = F.max_by(F.struct("technique_name", "title", "category", "description", "implementation_steps", "example_challenge"), rank)

    def in_order(column: str, present: str | None = None) -> Column:
        value = F.struct("pos", F.col(column).alias("v"))
        return F.array_sort(F.collect_list(F.when(F.expr(present), value) if present else value))["v"]

    def united(column: str) -> Column:
        return F.array_distinct(F.flatten(F.filter(in_order(column), lambda v: v.isNotNull()))).alias(column)

    codes = F.array_distinct(in_order("key_code", "key_code <> ''"))
    merged = tricks.groupBy(cluster).agg(
        best.alias("b"),
        united("source_writeups"),
        united("conditions"),
        united("detection_signs"),
        united("original_terms"),
        F.when(F.size(codes) > 0, F.array_join(codes, "\n\n---\n\n")).alias("key_code"),
        F.get(in_order("example", "example <> ''"), F.lit(0)).alias("example"),
        F.avg("confidence").alias("confidence"),
        F.min("created_at").alias("created_at"),
        F.min("pos").alias("pos"),
    )
    terms = F.array_distinct(F.concat(F.array("b.technique_name"), "original_terms"))
    return merged.select(
        cluster, "b.*", "source_writeups", "conditions", "detection_signs", terms.alias("original_terms"), "key_code", "example",
        F.round("confidence", 6).alias("confidence"), "created_at", "pos",
    )


def routed_groups(tricks: DataFrame, components: DataFrame) -> DataFrame:
    """(component, technique): each component goes to the technique of its best member; tricks (id, technique, confidence)."""
    joined = tricks.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return joined.groupBy("component").agg(F.max_by("technique", F.struct("confidence", -F.col("id"))).alias("technique"))


def primary_category(tricks: DataFrame, fixed: DataFrame) -> DataFrame:
    """(technique, category): a fixed one (technique, category), else the most frequent non-empty one, ties alphabetical, else misc."""
    counts = tricks.where("category <> ''").groupBy("technique", "category").agg(F.count(F.lit(1)).alias("n"))
    best = counts.join(counts.groupBy("technique").agg(F.max("n").alias("n")), ["technique", "n"]).groupBy("technique").agg(F.min("category").alias("mode"))
    known = tricks.select("technique").distinct().join(fixed.withColumnRenamed("category", "fixed"), "technique", "left").join(best, "technique", "left")
    return known.select("technique", F.coalesce("fixed", "mode", F.lit("misc")).alias("category"))
