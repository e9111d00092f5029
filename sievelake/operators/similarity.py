"""Blocked similarity joins and the decisions over candidate pairs.

Every join is on an equality (a shared token, title or source), never all against all.
Rows of the inputs carry an id; pairs come out once, as a < b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import antonym_swap, cosine, jaccard, lcs_ratio, significant_tokens, word_dice, word_set

TITLE, DESCRIPTION, STEPS, CODE = 0.35, 0.35, 0.2, 0.1
DUPLICATE, SAME_CODE, SHORT_TOKENS, SHORT_SIMILARITY = 0.72, 0.6, 12, 0.95
NAME_CANDIDATE, NAME_MERGE, NAME_DICE, SHARED_TITLES, JUDGE_CONTENT = 85, 90, 0.7, 2, 0.1
TITLE_CANDIDATE, TITLE_FREQUENCY = 0.5, 100
VECTOR_MERGE, VECTOR_GREY = 0.90, 0.75


def with_tokens(tricks: DataFrame) -> DataFrame:
    """tricks with struct `tok` of the distinct words of title, description, steps and code."""
    parts = {
        "title": F.col("title"),
        "desc": F.col("description"),
        "steps": F.array_join(F.coalesce("implementation_steps", F.array().cast("array<string>")), " "),
        "code": F.col("key_code"),
    }
    return tricks.withColumn("tok", F.struct(*(word_set(F.coalesce(c, F.lit(""))).alias(n) for n, c in parts.items())))


def trick_similarity(x: Column, y: Column) -> Column:
    """Weighted Jaccard of two token structs; similar code alone is enough evidence."""
    code = jaccard(x["code"], y["code"])
    combined = TITLE * jaccard(x["title"], y["title"]) + DESCRIPTION * jaccard(x["desc"], y["desc"]) + STEPS * jaccard(x["steps"], y["steps"]) + CODE * code
    return F.when(code >= SAME_CODE, F.greatest(code, combined)).otherwise(combined)


def _total(x: Column) -> Column:
    return F.size(x["title"]) + F.size(x["desc"]) + F.size(x["steps"]) + F.size(x["code"])


def _same_set(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def is_duplicate(x: Column, y: Column) -> Column:
    """Whether two tricks are one: equal title and description words, or similar enough, with more asked of very short ones."""
    equal = _same_set(x["title"], y["title"]) & _same_set(x["desc"], y["desc"]) & (F.size(x["title"]) + F.size(x["desc"]) > 0)
    similarity = trick_similarity(x, y)
    short = (_total(x) < SHORT_TOKENS) & (_total(y) < SHORT_TOKENS) & (similarity < SHORT_SIMILARITY)
    return F.when(equal, True).when(similarity < DUPLICATE, False).when(jaccard(x["code"], y["code"]) >= SAME_CODE, True).otherwise(~short)


def _pairs(rows: DataFrame, key: str, keep: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (a, b, ...) of rows (id, key, more) with equal keys and a < b."""
    left = rows.select(F.col(key), F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in more))
    right = rows.select(F.col(key), F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in more))
    joined = left.join(right, key).where(F.col("a") < F.col("b"))
    return (joined.where(keep) if keep is not None else joined).drop(key).distinct()


def pairs_by_source(tricks: DataFrame) -> DataFrame:
    """Tricks (id, technique, cluster, source_writeups) of one technique and one source in different lexical clusters."""
    rows = tricks.select("id", "cluster", "technique", F.explode("source_writeups").alias("url")).withColumn("key", F.struct("technique", "url")).drop("technique", "url")
    return _pairs(rows, "key", F.col("cluster_a") != F.col("cluster_b"), ("cluster",)).select("a", "b").distinct()


def pairs_by_title_token(tricks: DataFrame, most: int = TITLE_FREQUENCY) -> DataFrame:
    """Tricks of one technique that share a title word of four letters in at most `most` titles, with titles alike by half."""
    rows = tricks.select("id", "technique", "cluster", word_set(F.col("title")).alias("t"), F.explode(significant_tokens(F.col("title"))).alias("token"))
    rare = rows.groupBy("technique", "token").agg(F.count_distinct("id").alias("n")).where(F.col("n") <= most).select("technique", "token")
    rows = rows.join(rare, ["technique", "token"]).withColumn("key", F.struct("technique", "token")).drop("technique", "token")
    enough = (F.size("t_a") >= 3) & (F.size("t_b") >= 3) & (jaccard(F.col("t_a"), F.col("t_b")) >= TITLE_CANDIDATE)
    return _pairs(rows, "key", (F.col("cluster_a") != F.col("cluster_b")) & enough, ("cluster", "t")).select("a", "b").distinct()


def pairs_by_title(tricks: DataFrame) -> DataFrame:
    """Tricks of different techniques and clusters whose titles have equal word sets."""
    rows = tricks.select("id", "technique", "cluster", F.array_sort(word_set(F.col("title"))).alias("key"))
    apart = (F.col("cluster_a") != F.col("cluster_b")) & (F.col("technique_a") != F.col("technique_b"))
    return _pairs(rows, "key", apart, ("technique", "cluster")).select("a", "b").distinct()


def dedup_candidates(tricks: DataFrame) -> DataFrame:
    return pairs_by_source(tricks).union(pairs_by_title_token(tricks)).union(pairs_by_title(tricks)).distinct()


def name_pairs(names: DataFrame, threshold: int = NAME_CANDIDATE) -> DataFrame:
    """(a, b, ratio, dice) of names (id) that share a word and are alike in letters."""
    rows = names.select("id", F.explode(F.array_distinct(F.split("id", "_"))).alias("key")).where("key <> ''")
    pairs = _pairs(rows, "key").withColumn("ratio", F.round(lcs_ratio(F.col("a"), F.col("b")), 4))
    return pairs.where(F.col("ratio") >= threshold).withColumn("dice", F.round(word_dice(F.col("a"), F.col("b")), 6))


def content_pairs(tricks: DataFrame, least: int = SHARED_TITLES) -> DataFrame:
    """(a, b, shared) of techniques with at least so many title word sets in common; tricks (technique, title)."""
    rows = tricks.select(F.col("technique").alias("id"), F.array_sort(word_set(F.col("title"))).alias("key")).where(F.size("key") > 0).distinct()
    left, right = rows.select("key", F.col("id").alias("a")), rows.select("key", F.col("id").alias("b"))
    shared = left.join(right, "key").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.where(F.col("shared") >= least)


def bag_jaccard(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the multiset Jaccard of their token counts; tokens (id, token, n)."""
    size = tokens.groupBy("id").agg(F.sum("n").alias("size"))
    a = pairs.join(tokens.select(F.col("id").alias("a"), "token", F.col("n").alias("n_a")), "a")
    common = a.join(tokens.select(F.col("id").alias("b"), "token", F.col("n").alias("n_b")), ["b", "token"])
    least = common.groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("least"))
    out = pairs.join(size.select(F.col("id").alias("a"), F.col("size").alias("size_a")), "a", "left").join(size.select(F.col("id").alias("b"), F.col("size").alias("size_b")), "b", "left")
    out = out.join(least, ["a", "b"], "left").withColumn("least", F.coalesce("least", F.lit(0)))
    whole = F.coalesce("size_a", F.lit(0)) + F.coalesce("size_b", F.lit(0)) - F.col("least")
    empty = (F.coalesce("size_a", F.lit(0)) == 0) | (F.coalesce("size_b", F.lit(0)) == 0)
    return out.select("a", "b", F.when(empty, 0.0).otherwise(F.round(F.col("least") / whole, 6)).alias("content"))


def classify_names(pairs: DataFrame, judged: bool) -> DataFrame:
    """name pairs (a, b, ratio, dice, shared, content) with decision merge, judge or keep."""
    words_a, words_b = F.array_distinct(F.split("a", "_")), F.array_distinct(F.split("b", "_"))
    inside = (F.size(F.array_except(words_a, words_b)) == 0) | (F.size(F.array_except(words_b, words_a)) == 0)
    alike = ~antonym_swap(F.col("a"), F.col("b")) & (F.col("ratio") >= NAME_MERGE) & ((F.col("dice") >= NAME_DICE) | inside)
    decision = F.when(F.coalesce("shared", F.lit(0)) >= SHARED_TITLES, "merge").when(alike, "merge")
    if judged:
        decision = decision.when(F.col("content") >= JUDGE_CONTENT, "judge")
    return pairs.withColumn("decision", decision.otherwise("keep"))


def vector_decisions(pairs: DataFrame, vectors: DataFrame, judged: bool) -> DataFrame:
    """pairs (a, b) with similarity and decision merge, grey or keep; vectors (id, embedding) are joined by id.

    A pair without a vector is grey if a judge follows, else kept.
    """
    a = vectors.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    b = vectors.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    both = F.col("va").isNotNull() & F.col("vb").isNotNull()
    out = out.withColumn("similarity", F.when(both, F.round(cosine(F.col("va"), F.col("vb")), 6))).drop("va", "vb")
    doubt = "grey" if judged else "keep"
    decision = F.when(F.col("similarity").isNull(), doubt).when(F.col("similarity") >= VECTOR_MERGE, "merge").when(F.col("similarity") >= VECTOR_GREY, "grey")
    return out.withColumn("decision", decision.otherwise("keep"))
