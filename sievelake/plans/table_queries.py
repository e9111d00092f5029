"""Queries of the relational, incremental and search operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions.text import WORD
from sievelake.operators import relational as R
from sievelake.operators import search as S
from sievelake.operators.cluster import primary_category
from sievelake.operators.components import connected_components
from sievelake.operators.incremental import chunk_changes, numbered_questions, upsert
from sievelake.operators.similarity import bag_jaccard, vector_decisions
from sievelake.sources.state import of_terms, read_totals, write_index
from sievelake.storage import Scratch, table
from sievelake.streaming.ingest import progress


def _customers(spark, sf):
    """Customers as writeups, under two URLs for every name so that some have no order."""
    c = table(spark, sf, "customer")
    url = F.concat(F.lit("/c/"), (F.col("c_custkey") * 2).cast("string"))
    return c.select(url.alias("url"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("challenge_title"), F.col("c_mktsegment").alias("challenge_source"))


def _orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.array(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string"))).alias("source_writeups"))


def gap_report(spark, sf):
    return R.fill_gaps(_customers(spark, sf), _orders(spark, sf)).select("url", "pos")


def _merge_sides(spark, sf):
    base = table(spark, sf, "orders").select(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderkey").alias("pos"))
    nation = F.when(F.col("c_nationkey") == 0, F.lit("")).otherwise(F.concat(F.lit("/c/"), (F.floor(F.col("c_custkey") / 2) * 4).cast("string")))
    return base, table(spark, sf, "customer").select(nation.alias("url"), F.col("c_custkey").alias("pos"))


def corpus_merge(spark, sf):
    return R.merge_corpora(*_merge_sides(spark, sf))


def corpus_merge_report(spark, sf):
    return R.merge_report(*_merge_sides(spark, sf))


def inverted_index(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.array("l_partkey", "l_suppkey").alias("keys"))
    return R.inverted_index(lines, "l_orderkey", "keys", "key").select("key", F.size("ids").alias("n"), F.array_join("ids", ",").alias("orders"))


def url_lookup(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("url"), F.col("o_orderpriority").alias("challenge_title"), F.col("o_orderstatus").alias("challenge_source"), F.col("o_orderkey").alias("pos"))
    return R.last_by_url(rows)


def writeup_search(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("url"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("challenge_title"), F.col("p_brand").alias("challenge_source"))
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("url")).agg(F.count(F.lit(1)).alias("trick_count"))
    return R.search_writeups(parts, counts, " Widget ", 50).select("url", "challenge_title", "trick_count")


def trick_sources(spark, sf):
    lines = table(spark, sf, "lineitem")
    rows = lines.select(F.col("l_returnflag").alias("technique_name"), F.col("l_linestatus").alias("title"), F.struct("l_orderkey", "l_linenumber").alias("pos"), F.array(F.col("l_suppkey").cast("string")).alias("source_writeups"))
    found = R.union_of_sources(rows)
    return found.select("technique_name", "title", F.array_join("sources", ",").alias("sources"))


def check_report(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "warn").otherwise("ok")
    return R.check_report(table(spark, sf, "orders").select(status.alias("status")))


def category_mode(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("technique"), F.col("lang").alias("category"))
    fixed = spark.createDataFrame([("src3", "fixed")], "technique string, category string")
    return primary_category(docs, fixed)


def component_labels(spark, sf):
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    name = lambda letter, c: F.concat(F.lit(letter), F.lpad(F.col(c).cast("string"), 9, "0"))
    edges = supplier.select(name("s", "s_suppkey").alias("a"), name("n", "s_nationkey").alias("b"))
    edges = edges.union(nation.select(name("n", "n_nationkey").alias("a"), name("r", "n_regionkey").alias("b")))
    return connected_components(edges, Scratch(spark, "component-labels"))


def incremental_changes(spark, sf):
    docs = table(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    old = docs.where("lang <> 'fr'").select(F.col("doc_id").cast("string").alias("chunk_id"), F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    gone = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("chunk_id"), F.lit("0").alias("sha256"))
    return chunk_changes(chunks, old.union(gone))


def chunk_upsert(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("chunk_id"), F.lit("old").alias("state"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("chunk_id"), F.lit("new").alias("state"))
    gone = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("chunk_id"))
    return upsert(old, new, "chunk_id", gone)


def question_ids(spark, sf):
    q = table(spark, sf, "benchmark").select(F.concat(F.lit("t"), (F.col("item_id") % 7).cast("string")).alias("technique_name"), F.col("text").alias("question_text"))
    return numbered_questions(q).select("q_id", "technique_name", F.md5("question_text").alias("question_md5"))


def event_progress(spark, sf):
    return progress(table(spark, sf, "events")).select("start", "event_type", "n", F.round("value", 4).alias("value"))


def _question(spark, sf):
    return table(spark, sf, "benchmark").where("item_id = 0").select("text")


def _chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


_indexes: dict[tuple, tuple] = {}


def _index(spark, sf, lowercase=False, pattern=S.TERM):
    """Postings, with their part, and totals of the documents' index, written when a session first asks for it."""
    name = (spark.sparkContext.applicationId, sf, lowercase, pattern)
    if name not in _indexes:
        path = Scratch(spark, "index").path("postings")
        write_index(_chunks(spark, sf), path, lowercase, pattern)
        _indexes[name] = (spark.read.parquet(path), read_totals(spark, path).first())
    return _indexes[name]


def _scores(spark, sf):
    """BM25 scores of the question's documents, from the index; its words are those of one text."""
    asked = _question(spark, sf).select(F.array_distinct(S.terms(F.col("text")))).first()
    (postings, totals), words = _index(spark, sf), asked[0] if asked else []
    one = spark.sql("SELECT 1").select(F.lit(totals.n).cast("long").alias("n"), F.lit(totals["mean"]).cast("double").alias("mean"))
    return S.bm25_from_index(of_terms(postings, words), one, words)


def bm25_topk(spark, sf):
    return _scores(spark, sf).orderBy(F.desc("score"), "doc_id").limit(10)


def bm25_scores(spark, sf):
    return _chunks(spark, sf).select("doc_id").join(S.bm25_scores(_chunks(spark, sf), _question(spark, sf)), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_index(spark, sf):
    return S.build_postings(_chunks(spark, sf)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def coarse_search(spark, sf):
    docs = table(spark, sf, "documents")
    titles = docs.select(F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"))
    asked = "the Apache license"
    postings, _ = _index(spark, sf, lowercase=True, pattern=WORD)
    return S.coarse_from_index(titles, of_terms(postings, asked.lower().split()), asked, 20).select("pos", "score")


def coarse_scan(spark, sf):
    docs = table(spark, sf, "documents")
    records = docs.select(F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    return S.coarse_search(records, "the Apache license", 20).select("pos", "score")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("src"), F.col("label").cast("string")).alias("technique"), "embedding")


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def vector_topk(spark, sf):
    return S.vector_topk(_vectors(spark, sf), _query_vector(spark, sf), 10)


def question_boost(spark, sf):
    return S.question_boost(_vectors(spark, sf), _query_vector(spark, sf), 50)


def hybrid_search(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", F.col("source").alias("technique"), "text")
    found = S.hybrid_search(chunks, _question(spark, sf), _vectors(spark, sf), _query_vector(spark, sf), scores=_scores(spark, sf))
    return found.select("rank", "doc_id", "bm25_score", "rerank_score", "boost", "final_score")


def vector_tiers(spark, sf):
    v = _vectors(spark, sf).select("id", "embedding")
    pairs = v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return vector_decisions(pairs, v, judged=True)


def content_bags(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("token"), F.col("l_quantity").cast("int").alias("q"))
    tokens = lines.groupBy("id", F.concat("token", F.col("q").cast("string")).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf, "supplier")
    return bag_jaccard(tokens, s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b")))


QUERIES = {
    f.__name__: f
    for f in (
        gap_report, corpus_merge, corpus_merge_report, inverted_index, url_lookup, writeup_search, trick_sources, check_report, category_mode,
        component_labels, incremental_changes, chunk_upsert, question_ids, event_progress, bm25_topk, bm25_scores, bm25_index, coarse_search, coarse_scan,
        vector_topk, question_boost, hybrid_search, vector_tiers, content_bags,
    )
}

_BM25 = r"""
    tok AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS t FROM documents),
    q AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS term FROM benchmark WHERE item_id = 0),
    totals AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
    tf AS (SELECT doc_id, len(any_value(t)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) JOIN q USING (term) GROUP BY doc_id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm25 AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
             FROM tf JOIN df USING (term) CROSS JOIN totals GROUP BY doc_id HAVING score > 0)
"""
_SIMILAR = r"""
    v AS (SELECT vec_id AS id, 'src' || label AS technique, embedding::DOUBLE[] AS e FROM embeddings),
    sim AS (SELECT id, technique, round(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 6) AS similarity
            FROM v CROSS JOIN (SELECT e AS q FROM v WHERE id = 0)),
    near AS (SELECT * FROM sim ORDER BY similarity DESC, id LIMIT 50),
    boosts AS (SELECT technique, max(similarity) AS boost FROM near WHERE similarity > 0 GROUP BY technique)
"""
_SIDES = """
    base AS (SELECT '/c/' || o_custkey AS url, o_orderkey AS pos FROM orders),
    other AS (SELECT CASE WHEN c_nationkey = 0 THEN '' ELSE '/c/' || (c_custkey // 2 * 4) END AS url, c_custkey AS pos FROM customer),
    new AS (SELECT url, min(pos) AS pos FROM other WHERE url <> '' AND url NOT IN (SELECT url FROM base) GROUP BY url)
"""

ORACLE_SQL = {
    "gap_report": "SELECT '/c/' || (c_custkey * 2) AS url, c_custkey AS pos FROM customer WHERE c_custkey * 2 NOT IN (SELECT o_custkey FROM orders)",
    "corpus_merge": f"WITH {_SIDES} SELECT * FROM base UNION ALL SELECT url, pos FROM new",
    "corpus_merge_report": f"""
        WITH {_SIDES}, c AS (SELECT (SELECT count(*) FROM base) AS existing, (SELECT count(*) FROM other WHERE url = '') AS no_url,
                             (SELECT count(*) FROM new) AS new, (SELECT count(*) FROM other) AS everything)
        SELECT existing, no_url, everything - no_url - new AS duplicate, new, existing + new AS total FROM c
    """,
    "inverted_index": """
        WITH e AS (SELECT DISTINCT unnest([l_partkey, l_suppkey]) AS key, l_orderkey FROM lineitem)
        SELECT key, count(*)::INT AS n, string_agg(l_orderkey, ',' ORDER BY l_orderkey) AS orders FROM e GROUP BY key
    """,
    "url_lookup": """
        SELECT o_custkey::VARCHAR AS url, arg_max(o_orderpriority, o_orderkey) AS challenge_title, arg_max(o_orderstatus, o_orderkey) AS challenge_source
        FROM orders WHERE o_orderpriority <> '' GROUP BY o_custkey
    """,
    "writeup_search": """
        SELECT p_partkey AS url, p_name AS challenge_title, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS trick_count
        FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_brand), 'widget') ORDER BY p_name, p_partkey LIMIT 50
    """,
    "trick_sources": """
        WITH f AS (SELECT l_returnflag, l_linestatus, l_suppkey, min((l_orderkey, l_linenumber)) AS seen_at FROM lineitem GROUP BY ALL)
        SELECT l_returnflag AS technique_name, l_linestatus AS title, string_agg(l_suppkey, ',' ORDER BY seen_at, l_suppkey::VARCHAR) AS sources FROM f GROUP BY ALL
    """,
    "check_report": """
        SELECT CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'warn' ELSE 'ok' END AS status, count(*) AS n, status = 'fail' AS failed FROM orders GROUP BY 1
    """,
    "category_mode": """
        WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang <> '' GROUP BY ALL),
             m AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c)
        SELECT source AS technique, CASE WHEN source = 'src3' THEN 'fixed' ELSE lang END AS category FROM m WHERE r = 1
    """,
    "component_labels": """
        WITH RECURSIVE e AS (
            SELECT 's' || lpad(s_suppkey::VARCHAR, 9, '0') AS a, 'n' || lpad(s_nationkey::VARCHAR, 9, '0') AS b FROM supplier
            UNION ALL SELECT 'n' || lpad(n_nationkey::VARCHAR, 9, '0'), 'r' || lpad(n_regionkey::VARCHAR, 9, '0') FROM nation
        ), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.seen)
        SELECT node, min(seen) AS component FROM reach GROUP BY node
    """,
    "incremental_changes": """
        SELECT doc_id::VARCHAR AS chunk_id, sha256(text) AS sha256, CASE lang WHEN 'fr' THEN 'new' WHEN 'de' THEN 'changed' ELSE 'same' END AS change FROM documents
        UNION ALL SELECT 'p' || page_id, NULL, 'deleted' FROM pages
    """,
    "chunk_upsert": """
        SELECT c_custkey AS chunk_id, 'old' AS state FROM customer
        WHERE c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier) AND c_custkey NOT IN (SELECT n_nationkey + 1 FROM nation)
        UNION ALL SELECT s_suppkey * 3, 'new' FROM supplier
    """,
    "question_ids": """
        SELECT 'q_' || (row_number() OVER (ORDER BY 't' || (item_id % 7), text) - 1) AS q_id, 't' || (item_id % 7) AS technique_name, md5(text) AS question_md5 FROM benchmark
    """,
    "event_progress": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, score FROM bm25 ORDER BY score DESC, doc_id LIMIT 10",
    "bm25_scores": f"WITH {_BM25} SELECT d.doc_id, coalesce(score, 0) AS score FROM documents d LEFT JOIN bm25 USING (doc_id)",
    "bm25_index": r"""
        WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS term FROM documents)
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term
    """,
    "coarse_search": r"""
        WITH d AS (SELECT doc_id AS pos, string_split(text, chr(10))[1] AS title, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS c FROM documents),
             s AS (SELECT pos, list_sum(list_transform(['the', 'apache', 'license'], lambda w: CASE
                        WHEN list_contains(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+'), w) THEN 3 WHEN list_contains(c, w) THEN 1 ELSE 0 END))
                      + CASE WHEN contains(lower(title), 'the apache license') THEN 5 ELSE 0 END AS score FROM d)
        SELECT pos, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, pos LIMIT 20
    """,
    "vector_topk": f"WITH {_SIMILAR} SELECT id, similarity FROM sim ORDER BY similarity DESC, id LIMIT 10",
    "question_boost": f"WITH {_SIMILAR} SELECT * FROM boosts",
    "hybrid_search": rf"""
        WITH {_BM25}, {_SIMILAR},
        recall AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rr FROM (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 100)),
        asked AS (SELECT list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM benchmark WHERE item_id = 0),
        re AS (SELECT r.doc_id, source, r.score, rr, round(len(list_intersect(w, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')))) / len(w), 6) AS rerank_score
               FROM recall r JOIN documents USING (doc_id) CROSS JOIN asked),
        placed AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, rr) AS pr FROM re),
        final AS (SELECT p.*, coalesce(boost, 0) AS boost, round(rerank_score + 0.3 * coalesce(boost, 0), 6) AS final_score FROM placed p LEFT JOIN boosts b ON b.technique = p.source)
        SELECT row_number() OVER (ORDER BY final_score DESC, pr)::INT AS rank, doc_id, score AS bm25_score, rerank_score, boost, final_score
        FROM final ORDER BY final_score DESC, pr LIMIT 10
    """,
    "vector_tiers": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        p AS (SELECT x.vec_id AS a, x.vec_id + 1 AS b, round(list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))), 6) AS similarity
              FROM v x LEFT JOIN v y ON y.vec_id = x.vec_id + 1)
        SELECT a, b, similarity, CASE WHEN similarity IS NULL THEN 'grey' WHEN similarity >= 0.9 THEN 'merge' WHEN similarity >= 0.75 THEN 'grey' ELSE 'keep' END AS decision FROM p
    """,
    "content_bags": """
        WITH t AS (SELECT l_suppkey AS id, l_returnflag || l_quantity::INT AS token, count(*) AS n FROM lineitem GROUP BY ALL),
        p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier),
        size AS (SELECT id, sum(n) AS size FROM t GROUP BY id),
        both_of AS (SELECT a, b, sum(least(x.n, y.n)) AS least FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b AND y.token = x.token GROUP BY a, b)
        SELECT a, b, CASE WHEN sa.size IS NULL OR sb.size IS NULL THEN 0 ELSE round(coalesce(least, 0) / (sa.size + sb.size - coalesce(least, 0)), 6) END AS content
        FROM p LEFT JOIN size sa ON sa.id = a LEFT JOIN size sb ON sb.id = b LEFT JOIN both_of USING (a, b)
    """,
}
ORACLE_SQL["coarse_scan"] = ORACLE_SQL["coarse_search"]
