"""The training-data operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.byte_bpe import encode_and_decode
from sievelake.llm.exact_dedup import exact_duplicates
from sievelake.llm.line_dedup import digest_of_lines, drop_frequent_lines
from sievelake.llm.near_dedup import near_duplicates
from sievelake.llm.packing import pack_documents
from sievelake.llm.pii import replace_pii, session_key
from sievelake.llm.sharding import shard_documents
from sievelake.llm.token_files import token_table
from sievelake.llm.topk import search_table
from sievelake.llm.toxicity import is_held_out, score_documents, train
from sievelake.storage import table

LIBRARY_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, bands=32, rows=7)


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), LIBRARY_FILE, public_tokenizers.PATTERN, end_id=2)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), LIBRARY_FILE, public_tokenizers.PATTERN, capacity=2048, end_id=0)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_table(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), session_key(spark)).select("doc_id", "n_pii", F.col("text").alias("clean_text"))


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), RANKS_FILE, public_tokenizers.PATTERN)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_of_lines(drop_frequent_lines(docs, least_docs=10, least_chars=1))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_id_output": op2_token_id_output,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_hash_tree_sharding": op8_hash_tree_sharding,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                           ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w
        ), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
        ), both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, p.b FROM reach r JOIN both_ways p ON p.a = r.seen),
        least_of AS (SELECT node, min(seen) AS low FROM reach GROUP BY node)
        SELECT doc_id, len(sh) AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept FROM s LEFT JOIN least_of ON node = doc_id
    """,
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(s) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY s)
    """,
    "op4_exact_top_k": r"""
        WITH usable AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.r <> q.r
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY r, doc_id
    """,
}
