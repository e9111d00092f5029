"""BM25, coarse keyword search, exact vector search, question boost and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.config import SETTINGS
from sievelake.functions.text import cosine, word_set
from sievelake.models import OverlapReranker, Reranker

TERM = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def terms(text: Column, lowercase: bool = False, pattern: str = TERM) -> Column:
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(pattern), F.lit(0))


def build_postings(docs: DataFrame, lowercase: bool = False, pattern: str = TERM) -> DataFrame:
    """(term, doc_id, tf, dl) of docs (doc_id, text): the inverted index, to be written partitioned by a hash of the term."""
    tokenised = docs.select("doc_id", terms(F.col("text"), lowercase, pattern).alias("t")).withColumn("dl", F.size("t"))
    return tokenised.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def _bm25(tf: Column, dl: Column, df: Column, n: Column, mean: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def bm25_scores(docs: DataFrame, query: DataFrame, lowercase: bool = False) -> DataFrame:
    """(doc_id, score > 0) of docs (doc_id, text) for the one text in query (text).

    For a corpus without an index: the texts are read once for the totals and once for the
    hits, which alone are shuffled; the query's terms and three corpus totals are broadcast.
    """
    asked = F.broadcast(query.select(F.explode(F.array_distinct(terms(F.col("text"), lowercase))).alias("term")))
    tokenised = docs.select("doc_id", terms(F.col("text"), lowercase).alias("t")).withColumn("dl", F.size("t"))
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count("text", F.lit(TERM))).alias("mean"))  # one row
    hits = tokenised.select("doc_id", "dl", F.explode("t").alias("term")).join(asked, "term")
    tf = hits.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most the query's terms
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    score = F.sum(_bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("mean")))
    return scored.groupBy("doc_id").agg(F.round(score, 6).alias("score")).where("score > 0")


def bm25_from_index(postings: DataFrame, stats: DataFrame, query_terms: list[str]) -> DataFrame:
    """(doc_id, score) from written postings and one row of stats (n, mean); the term filter reaches the scan."""
    hits = postings.where(F.col("term").isin(query_terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    score = F.sum(_bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("mean")))
    return scored.groupBy("doc_id").agg(F.round(score, 6).alias("score")).where("score > 0")


def corpus_stats(postings: DataFrame) -> DataFrame:
    lengths = postings.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))


def bm25_topk(docs: DataFrame, query: DataFrame, k: int = SETTINGS.recall_k, lowercase: bool = False) -> DataFrame:
    """The k best documents, ties by doc_id: a distributed top-k, no global sort."""
    return bm25_scores(docs, query, lowercase).orderBy(F.desc("score"), "doc_id").limit(k)


def coarse_search(records: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """records (pos, title, content) by matches: 3 per query token in the title, else 1 in the content, 5 for the whole query in the title."""
    whole = query.lower().strip()
    tokens = word_set(F.lit(query))
    title, content = word_set(F.col("title")), word_set(F.col("content"))
    in_title = F.array_intersect(tokens, title)
    elsewhere = F.array_intersect(F.array_except(tokens, title), content)
    bonus = F.when(F.lower("title").contains(whole), 5).otherwise(0) if whole else F.lit(0)
    scored = records.withColumn("score", (3 * F.size(in_title) + F.size(elsewhere) + bonus).cast("double"))
    return scored.where("score > 0").orderBy(F.desc("score"), "pos").limit(max(1, min(limit, 100)))


def coarse_from_index(titles: DataFrame, postings: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """coarse_search by an index of the contents' words: titles (pos, title), postings (term, doc_id) of small letters, doc_id being pos."""
    whole = query.lower().strip()
    tokens = word_set(F.lit(query))
    held = postings.groupBy(F.col("doc_id").alias("pos")).agg(F.collect_set("term").alias("held"))  # at most the query's words
    in_title = F.array_intersect(tokens, word_set(F.col("title")))
    elsewhere = F.array_except(F.coalesce("held", F.array().cast("array<string>")), in_title)
    bonus = F.when(F.lower("title").contains(whole), 5).otherwise(0) if whole else F.lit(0)
    scored = titles.join(held, "pos", "left").withColumn("score", (3 * F.size(in_title) + F.size(elsewhere) + bonus).cast("double"))
    return scored.drop("held").where("score > 0").orderBy(F.desc("score"), "pos").limit(max(1, min(limit, 100)))


def vector_topk(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(id, similarity): the k vectors (id, embedding) nearest to the one vector in query (q) by cosine, exactly."""
    one = F.broadcast(query.select("q").limit(1))
    scored = vectors.crossJoin(one).select("id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def question_boost(questions: DataFrame, query: DataFrame, k: int = SETTINGS.question_k) -> DataFrame:
    """(technique, boost): the largest positive similarity among the k questions (id, technique, embedding) nearest to the query."""
    near = vector_topk(questions, query, k).where("similarity > 0")
    return near.join(questions.select("id", "technique"), "id").where("technique <> ''").groupBy("technique").agg(F.max("similarity").alias("boost"))


def blend(reranked: DataFrame, boosts: DataFrame, weight: float = SETTINGS.boost_weight, top_k: int = SETTINGS.top_k) -> DataFrame:
    """rank 1..top_k by rerank_score + weight * boost; reranked has (id, technique, rerank_score, recall_rank)."""
    order = Window.orderBy(F.desc("rerank_score"), "recall_rank")
    placed = reranked.withColumn("rerank_rank", F.row_number().over(order))  # at most the recall's rows
    joined = placed.join(F.broadcast(boosts), "technique", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    final = joined.withColumn("final_score", F.round(F.col("rerank_score") + weight * F.col("boost"), 6))
    best = final.orderBy(F.desc("final_score"), "rerank_rank").limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "rerank_rank"))).drop("rerank_rank")


def hybrid_search(
    chunks: DataFrame, query: DataFrame, questions: DataFrame | None, query_vector: DataFrame | None, reranker: Reranker | None = None,
    recall_k: int = SETTINGS.recall_k, top_k: int = SETTINGS.top_k, scores: DataFrame | None = None,
) -> DataFrame:
    """BM25 recall, rerank of the recall only, boost by questions, blend. chunks (doc_id, technique, text), query (text).

    Without questions or a query vector no technique is boosted. scores (doc_id, score) are
    those of a stored index, if there is one.
    """
    recalled = bm25_topk(chunks.select("doc_id", "text"), query, recall_k) if scores is None else scores.orderBy(F.desc("score"), "doc_id").limit(recall_k)
    recalled = recalled.withColumn("recall_rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # at most recall_k rows
    candidates = chunks.join(F.broadcast(recalled), "doc_id").withColumnRenamed("score", "bm25_score")
    reranked = (reranker or OverlapReranker()).rerank(candidates, query)
    if questions is None or query_vector is None:
        boosts = chunks.sparkSession.createDataFrame([], "technique string, boost double")
    else:
        boosts = question_boost(questions, query_vector)
    return blend(reranked.drop("text"), boosts, SETTINGS.boost_weight, top_k)
