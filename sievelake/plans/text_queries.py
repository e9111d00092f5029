"""Queries of the scalar text functions, sectioning and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import text as X
from sievelake.functions.html import clean_html
from sievelake.operators.batching import local_batches, number_batches, prompts
from sievelake.operators.chunking import chunk_files, trick_sections
from sievelake.operators.relational import technique_stats
from sievelake.storage import table

#: Keywords that occur in the synthetic prose, for the tagging query.
PROSE_TAGS = {"the": ["article"], "of the": ["phrase"], "apache license": ["license", "legal"], "license": ["legal"], "und": ["german"], "les": ["french", "web"], "stupid": ["abuse"]}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))


def text_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(X.clean_text(F.col("text")), 256).alias("clean_sha256"))


def worthwhile_filter(spark, sf):
    return _docs(spark, sf).where(X.worthwhile(F.col("text"), 500)).select("doc_id", "n_chars")


def token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def word_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(X.words(F.col("text"))).alias("n_words"), F.size(X.word_set(F.col("text"))).alias("n_distinct"))


def keyword_hints(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(X.keyword_hints(F.col("text"), PROSE_TAGS), ",").alias("hints"))


def categorize(spark, sf):
    given = F.when(F.col("lang") != "en", F.array(F.lit(" "), F.upper("lang")))
    return _docs(spark, sf).select("doc_id", X.categorise(given, X.keyword_hints(F.col("text"), PROSE_TAGS)).alias("category"))


def content_hash(spark, sf):
    return _docs(spark, sf).select(X.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"), X.content_hash(F.col("text")).alias("sha256"))


def trick_ids(spark, sf):
    title = F.substring_index("text", "\n", 1)
    return _docs(spark, sf).select("doc_id", X.trick_id(F.col("source"), title).alias("trick_id"))


def infer_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.infer_title(F.col("url"), F.lit("")).alias("title"))


def name_functions(spark, sf):
    rows = [("sql_injection", "sk-12345678901"), ("blind_SQL_json_leak", "short"), ("heap", ""), ("Cross-Site (XSS) Tricks", None)]
    df = spark.createDataFrame(rows, "name string, key string")
    return df.select("name", X.title_case(F.col("name")).alias("title"), X.clean_name(F.col("name")).alias("clean"), X.masked_key(F.col("key")).alias("masked"))


def ingest_progress(spark, sf):
    events = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("done"))
    total = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("total"))
    return events.crossJoin(F.broadcast(total)).select("event_type", X.progress_percent(F.col("done"), F.col("total")).alias("percent"))


def html_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", clean_html(F.col("html")).alias("cleaned"))


def chunk_documents(spark, sf):
    return chunk_files(_files(spark, sf))


def _headed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files, every line a section."""
    return _docs(spark, sf).select(F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("# "), "source", F.lit("\n\n## "), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("content"))


def document_sections(spark, sf):
    return trick_sections(_headed_files(spark, sf)).select("technique", "n", "title")


def file_stats(spark, sf):
    return technique_stats(_files(spark, sf))


def _writeups(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("category"), F.col("source").alias("challenge_source"), X.token_estimate(F.col("text")).alias("tokens")
    )


def token_batches(spark, sf):
    writeups = _writeups(spark, sf)
    return number_batches(local_batches(writeups, 20, 25_000), writeups)


def batch_prompts(spark, sf):
    turns = table(spark, sf, "conversations")
    rows = turns.select(
        F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"), F.col("role").alias("challenge_source"), F.lit("turn").alias("challenge_title"),
        F.array("role", F.lit("chat")).alias("challenge_category"), F.col("text").alias("cleaned_content"),
    )
    return prompts(rows).select("batch_id", F.sha2("prompt", 256).alias("prompt_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, worthwhile_filter, token_estimate, word_tokens, keyword_hints, categorize, content_hash, trick_ids, infer_title, name_functions,
        ingest_progress, html_clean, chunk_documents, document_sections, file_stats, token_batches, batch_prompts,
    )
}

_HINTS = r"""
    -- Word boundaries of any script: each separator is doubled, so that neighbouring keywords need not share one.
    tags(k, tag) AS (VALUES ('the', 'article'), ('of  the', 'phrase'), ('apache  license', 'license'), ('apache  license', 'legal'), ('license', 'legal'),
                            ('und', 'german'), ('les', 'french'), ('stupid', 'abuse')),
    found AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([^\p{L}\p{N}_])', '\1\1', 'g'),
                  '(?:^|[^\p{L}\p{N}_])(apache  license|license|of  the|stupid|the|und|les)(?:$|[^\p{L}\p{N}_])', 1)) AS k FROM documents),
    hinted AS (SELECT doc_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS hints, min(tag) AS first FROM found JOIN tags USING (k) GROUP BY doc_id)
"""

ORACLE_SQL = {
    "text_normalize": r"""
        WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
                     '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '_{3,}', '---', 'g'), '\[(?:__|http[^\]]*)\]\([^)]*\)', '', 'g'), 'http\S+', '', 'g') AS t
                   FROM documents),
             b AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda l:
                     NOT (regexp_replace(l, '^\s+|\s+$', '', 'g') IN ('---', '***', '___')
                          OR regexp_matches(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^[\s\-_*]{3,}$')
                          OR regexp_matches(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^https?://\S+$'))), chr(10)) AS t FROM a)
        SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_sha256 FROM b
    """,
    "worthwhile_filter": r"SELECT doc_id, n_chars FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 500",
    "token_estimate": "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents",
    "word_tokens": r"""
        SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)
    """,
    "keyword_hints": f"WITH {_HINTS} SELECT d.doc_id, coalesce(hints, '') AS hints FROM documents d LEFT JOIN hinted USING (doc_id)",
    "categorize": f"""
        WITH {_HINTS} SELECT d.doc_id, CASE WHEN lang <> 'en' THEN lang ELSE coalesce(first, 'uncategorized') END AS category
        FROM documents d LEFT JOIN hinted USING (doc_id)
    """,
    "content_hash": "SELECT source || '__c' || doc_id AS chunk_id, sha256(text) AS sha256 FROM documents",
    "trick_ids": "SELECT doc_id, source || '::' || substr(sha1(string_split(text, chr(10))[1]), 1, 10) AS trick_id FROM documents",
    "infer_title": r"""
        WITH s AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)
        SELECT page_id, CASE WHEN len(p) = 0 OR p[-1] = 'index' THEN url ELSE
            array_to_string(list_transform(regexp_extract_all(replace(replace(p[-1], '-', ' '), '_', ' '), '\p{L}+|[^\p{L}]+'),
                                           lambda x: upper(x[1]) || lower(x[2:])), '') END AS title FROM s
    """,
    "name_functions": """
        SELECT * FROM (VALUES ('sql_injection', 'SQL Injection', 'sql_injection', 'sk-1...8901'),
                              ('blind_SQL_json_leak', 'Blind SQL JSON Leak', 'blind_sql_json_leak', '***'),
                              ('heap', 'Heap', 'heap', '(empty)'),
                              ('Cross-Site (XSS) Tricks', 'Cross-site (xss) tricks', 'cross_site_xss_tricks', '(empty)')) t(name, title, clean, masked)
    """,
    "ingest_progress": "SELECT event_type, round(count(*) / (SELECT count(*) FROM events) * 100, 1) AS percent FROM events GROUP BY event_type",
    "document_sections": r"""
        WITH s AS (SELECT doc_id::VARCHAR AS technique, string_split('# ' || source || chr(10) || chr(10) || '## ' || replace(text, chr(10), chr(10) || '## '), chr(10) || '## ') AS p FROM documents),
             e AS (SELECT technique, unnest(p) AS part, (generate_subscripts(p, 1) - 1)::INT AS n FROM s),
             r AS (SELECT technique, n, CASE WHEN n > 0 THEN '## ' || part ELSE part END AS section FROM e)
        SELECT technique, n, trim(substr(string_split(section, chr(10))[1], 4)) AS title FROM r WHERE starts_with(section, '## ')
    """,
    "file_stats": "SELECT doc_id::VARCHAR AS name, (len(string_split(text, chr(10) || '## ')) - 1)::INT AS tricks, strlen(text)::INT AS bytes FROM documents",
    "token_batches": """
        WITH RECURSIVE w AS (
            SELECT doc_id AS id, lower(trim(lang)) AS c, greatest(1, length(text) // 4) AS t,
                   row_number() OVER (PARTITION BY lower(trim(lang)) ORDER BY source, doc_id) AS rn FROM documents
        ), f AS (
            SELECT id, c, rn, 0 AS local, CASE WHEN t >= 25000 THEN 0 ELSE 1 END AS k, CASE WHEN t >= 25000 THEN 0 ELSE t END AS total FROM w WHERE rn = 1
            UNION ALL
            SELECT w.id, w.c, w.rn, f.local + (f.k = 0 OR w.t >= 25000 OR f.k >= 20 OR f.total + w.t > 25000)::INT,
                   CASE WHEN w.t >= 25000 THEN 0 WHEN f.k = 0 OR f.k >= 20 OR f.total + w.t > 25000 THEN 1 ELSE f.k + 1 END,
                   CASE WHEN w.t >= 25000 THEN 0 WHEN f.k = 0 OR f.k >= 20 OR f.total + w.t > 25000 THEN w.t ELSE f.total + w.t END
            FROM f JOIN w ON w.c = f.c AND w.rn = f.rn + 1
        ), g AS (SELECT c, count(*) AS n, min(id) AS first, max(local) + 1 AS b FROM f GROUP BY c),
        o AS (SELECT c, coalesce(sum(b) OVER (ORDER BY n DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g)
        SELECT id, (base + local)::BIGINT AS batch_id FROM f JOIN o USING (c)
    """,
    "batch_prompts": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
        SELECT conv_id AS batch_id, sha256(string_agg('<writeup_' || i || '>' || chr(10) || 'Source: ' || role || chr(10) || 'Challenge: turn' || chr(10)
            || 'Category: ' || role || ', chat' || chr(10) || 'Content:' || chr(10) || text || chr(10) || '</writeup_' || i || '>', chr(10) || chr(10) ORDER BY i)) AS prompt_sha256
        FROM n GROUP BY conv_id
    """,
}
