"""Queries of the record operators: over tables with mapped columns, some over small literal records, since no driver table has technique names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.functions.text import legacy_list_similarity, legacy_text_similarity, token_estimate
from sievelake.models import TitleExtractor
from sievelake.operators import canonical as C
from sievelake.operators import similarity as M
from sievelake.operators.batching import local_batches, number_batches, unprocessed
from sievelake.operators.chunking import parse_tricks
from sievelake.operators.cluster import leader_clusters, merge_clusters, routed_groups
from sievelake.operators.evidence import group_evidence, trick_evidence
from sievelake.operators.relational import positions_to_urls, remove_source
from sievelake.operators.render import preview, render_files
from sievelake.plans import workflow as W
from sievelake.storage import Scratch, table

_TRICK = "id long, technique string, title string, description string, implementation_steps array<string>, key_code string, confidence double, created_at string, source_writeups array<string>"
_ROWS = [
    (1, "sqli", "time based blind probe", "sleep the database to leak one bit per request", ["find a parameter", "inject a delay"], "SLEEP(10)", 0.9, "2024-01-02", ["u1"]),
    (2, "sqli", "delay oracle on login", "measure how long a reply takes after injection", ["measure"], "SLEEP(10)", 0.8, "2024-01-01", ["u2"]),
    (3, "sqli", "union select columns", "count columns and read other tables with union", ["count the columns"], None, 0.7, "2024-01-03", ["u1", "u3"]),
    (4, "xss", "union select columns", "tables with union read other and count columns", [], None, 0.6, "2024-01-04", ["u4"]),
    (5, "xss", "stored script in profile field", "put a script in the profile so that visitors run it", ["edit the profile"], "<script>", 0.9, "2024-01-05", ["u5"]),
    (6, "xss", "stored script in comment field", "put a script in a comment so that visitors run it", ["write a comment"], "<img onerror>", 0.5, "2024-01-06", ["u5"]),
    (7, "sqli", "columns union select", "with union count columns and read other tables", ["none"], None, 0.95, "2024-01-07", []),
]


def _tricks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ROWS, _TRICK)


def _document_tricks(spark, sf):
    """Documents as records: source as technique, first line as title, text as description, language and source as step and code."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("technique"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"),
        F.array("lang").alias("implementation_steps"), F.col("source").alias("key_code"),
    )


def trick_similarity(spark, sf):
    t = M.with_tokens(_document_tricks(spark, sf))
    a, b = t.select(F.col("id").alias("a"), F.col("tok").alias("x")), t.select(F.col("id").alias("b"), F.col("tok").alias("y"))
    pairs = a.join(b, F.col("a") + 1 == F.col("b"))
    return pairs.select("a", "b", F.round(M.trick_similarity(F.col("x"), F.col("y")), 9).alias("similarity"), M.is_duplicate(F.col("x"), F.col("y")).alias("duplicate"))


def legacy_similarity(spark, sf):
    """Each document with the next one: their texts, and their sources and languages as lists."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.array("source", "lang").alias("kinds"))
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"), F.col("kinds").alias("next_kinds"))
    text, kinds = legacy_text_similarity(F.col("text"), F.col("next")), legacy_list_similarity(F.col("kinds"), F.col("next_kinds"))
    return d.join(following, "doc_id").select("doc_id", F.round(text, 9).alias("text_similarity"), F.round(kinds, 9).alias("list_similarity"))


def judge_trick_evidence(spark, sf):
    shown = F.from_json("evidence", "technique string, title string, description string, key_code string")
    return trick_evidence(_document_tricks(spark, sf)).select("id", shown.alias("e")).select("id", "e.technique", F.md5("e.title").alias("title_md5"), F.md5("e.description").alias("description_md5"), "e.key_code")


def judge_group_evidence(spark, sf):
    """Orders as records, with their priority as technique, status and year as title."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("technique"), F.concat_ws(" ", "o_orderstatus", F.year("o_orderdate").cast("string")).alias("title"))
    shown = F.from_json("evidence", "name string, trick_count long, sample_titles array<string>")
    return group_evidence(o).select(shown.alias("e")).select("e.name", "e.trick_count", F.array_join("e.sample_titles", ";").alias("sample_titles"))


def lexical_clusters(spark, sf):
    return leader_clusters(_tricks(spark))


def _clustered(spark: SparkSession) -> DataFrame:
    return _tricks(spark).join(leader_clusters(_tricks(spark)).select("id", F.col("leader").alias("cluster")), "id")


def dedup_candidates(spark, sf):
    return M.dedup_candidates(_clustered(spark))


def cluster_merge(spark, sf):
    empty = F.array().cast("array<string>")
    rows = _clustered(spark).withColumnsRenamed({"technique": "technique_name"}).withColumns(
        {
            "pos": F.col("id"), "category": F.lit("web"), "conditions": F.array(F.lit("always"), F.concat(F.lit("c"), "id")), "detection_signs": empty,
            "original_terms": F.array("technique_name"), "example": F.when(F.col("id") == 2, "an example"), "example_challenge": F.lit(None).cast("string"),
        }
    )
    found = merge_clusters(rows)
    lists = [F.array_join(c, ",").alias(c) for c in ("source_writeups", "conditions", "original_terms")]
    return found.select("cluster", "technique_name", "title", *lists, "key_code", "example", "confidence", "created_at")


def group_routing(spark, sf):
    """Suppliers of every second nation are one component, named after the least of them; the others stand alone."""
    s = table(spark, sf, "supplier")
    even = s.where("s_nationkey % 2 = 0")
    comps = even.join(even.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("component")), "s_nationkey").select(F.col("s_suppkey").alias("node"), "component")
    return routed_groups(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("technique"), F.col("s_acctbal").cast("double").alias("confidence")), comps)


def technique_name_pairs(spark, sf):
    names = "php_disable_functions_bypass php_disabled_functions_bypass disable_functions_bypass aslr_bypass kaslr_bypass json_injection jsonp_injection heap_integer_overflow heap_integer_underflow"
    pairs = M.name_pairs(spark.createDataFrame([(n,) for n in names.split()], "id string"))
    return M.classify_names(pairs.withColumn("shared", F.lit(0)).withColumn("content", F.lit(0.2)), judged=True).select("a", "b", "ratio", "dice", "decision")


def technique_content_pairs(spark, sf):
    return M.content_pairs(_document_tricks(spark, sf).select("technique", "title"))


def canonical_names(spark, sf):
    aliases = spark.createDataFrame([("sqli", "sql_injection", 0), ("sql_injection", "sql_injection", 1), ("blind_sql_injection", "sql_injection", 2), ("xss", "xss", 3), ("c", "c", 4)], "alias string, canonical string, pos long")
    custom = spark.createDataFrame([("xss", "cross_site_scripting", 0)], "alias string, canonical string, pos long")
    names = spark.createDataFrame([("SQLi",), ("blind SQL injection",), ("XSS",), ("unknown-trick (rare)",), ("a very long name about blind_sql_injection in a login form",), ("a quite long unknown technique of the kind",)], "name string")
    return C.canonical_names(names, C.with_overrides(aliases, custom))


def fuzzy_names(spark, sf):
    unknown = spark.createDataFrame([("heap_overflows",), ("totally_other",)], "name string")
    return C.fuzzy_matches(unknown, spark.createDataFrame([("heap_overflow",), ("heap_spray",), ("stack_overflow",)], "name string"))


def merged_mapping(spark, sf):
    """Nations as groups with their suppliers as records; those of one region whose numbers follow each other are accepted pairs."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    counts = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("count"))
    groups = n.join(counts, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("name"), F.coalesce("count", F.lit(0)).alias("count"), (F.col("n_nationkey") % 7 == 0).alias("is_canonical"))
    nexts = F.lead("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))  # 25 rows
    accepted = n.select(F.col("n_name").alias("a"), nexts.alias("b")).where("b is not null")
    return C.merged_mapping(groups, accepted, Scratch(spark, "merged-mapping"))


def source_positions(spark, sf):
    """Lines of an order as records, the order's two pages as its sources; a line without positions has them all."""
    lines, page = table(spark, sf, "lineitem"), F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string"), F.lit("/"))
    batches = table(spark, sf, "orders").select(F.col("o_orderkey").alias("batch_id"), F.array(F.concat(page, F.lit("a")), F.concat(page, F.lit("b"))).alias("urls"))
    number = F.col("l_linenumber").cast("int")
    records = lines.select(
        (F.col("l_orderkey") * 10 + number).alias("record_id"), F.col("l_orderkey").alias("batch_id"), F.when(number != 5, F.array(number, number - 2)).alias("source_indexes")
    )
    return positions_to_urls(records, batches).select("record_id", F.array_join("source_writeups", ",").alias("sources"))


def source_removal(spark, sf):
    lines = table(spark, sf, "lineitem")
    rows = lines.select("l_orderkey", "l_linenumber", F.array_distinct(F.array("l_returnflag", "l_linestatus")).alias("source_writeups"))
    return remove_source(rows, "O").select("l_orderkey", "l_linenumber", F.array_join("source_writeups", ",").alias("sources"))


def _records(spark: SparkSession) -> DataFrame:
    return _tricks(spark).withColumns(
        {
            "pos": F.col("id"), "category": F.lit("web"), "conditions": F.array(F.lit("a parameter"), F.lit("a database")), "example": F.lit("curl x"),
            "detection_signs": F.array(F.lit("slow replies")), "example_challenge": F.lit(None).cast("string"),
        }
    )


def rendered_files(spark, sf):
    writeups = spark.createDataFrame([("u1", "Login", "CTF 1"), ("u5", "Blog", "CTF 2")], "url string, challenge_title string, challenge_source string")
    return render_files(_records(spark), writeups)


def rendered_round_trip(spark, sf):
    parsed = parse_tricks(rendered_files(spark, sf))
    return parsed.select("technique", "title", "description", F.array_join("conditions", ";").alias("conditions"), F.array_join("implementation_steps", ";").alias("steps"), "key_code", "example_challenge")


def rendered_preview(spark, sf):
    return preview(_records(spark))


def extracted_records(spark, sf):
    docs = table(spark, sf, "documents")
    writeups = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("category"), F.col("source").alias("challenge_source"), token_estimate(F.col("text")).alias("tokens"))
    batched = number_batches(local_batches(writeups), writeups).join(docs, F.col("id") == F.col("doc_id")).select(
        "batch_id", F.col("doc_id").alias("pos"), F.concat(F.lit("/d/"), "doc_id").alias("url"), F.col("source").alias("challenge_source"),
        F.concat(F.lit("Document "), "doc_id").alias("challenge_title"), F.array("lang").alias("challenge_category"), F.col("text").alias("cleaned_content"),
    )
    records, _ = W.extract_tricks(W.batch_items(batched), TitleExtractor(), "2024-01-01")
    return records.select("technique_name", "title", F.array_join("source_writeups", ",").alias("sources"), "confidence")


def alias_persistence(spark, sf):
    d = table(spark, sf, "documents")
    mapping = d.select(F.concat("source", F.lit("_"), "lang").alias("old"), F.concat("source", F.lit("_en")).alias("merged")).distinct()
    curated = d.where("lang = 'de'").select(F.concat("source", F.lit("_"), "lang").alias("alias")).distinct()
    return C.new_aliases(mapping, curated)


def batches_to_resume(spark, sf):
    turns = table(spark, sf, "conversations")
    done = turns.select(F.col("conv_id").alias("batch_id"), F.when(F.col("turn") == 3, "completed").otherwise("failed").alias("status"))
    return unprocessed(turns.select(F.col("conv_id").alias("batch_id")).distinct(), done)


def health_report(spark, sf):
    found = W.health({n: table(spark, sf, n) for n in ("documents", "pages", "embeddings")} | {"nothing": table(spark, sf, "region").where("r_regionkey < 0"), "missing": None})
    return found.select("name", "status", "rows")


def merged_techniques(spark, sf):
    aliases = spark.createDataFrame([("xss", "xss", 0)], "alias string, canonical string, pos long")
    rows = [("php_disable_functions_bypass", "t1"), ("php_disabled_functions_bypass", "t2"), ("php_disable_functions_bypass", "t3"), ("type_juggling", "loose compare"), ("type_juggling", "magic hash"), ("php_juggling", "compare loose"), ("php_juggling", "hash magic"), ("xss", "t1")]
    return W.merge_techniques(spark.createDataFrame(rows, "technique string, title string"), aliases)[0]


QUERIES = {
    f.__name__: f
    for f in (
        trick_similarity, lexical_clusters, dedup_candidates, cluster_merge, group_routing, technique_name_pairs, technique_content_pairs, canonical_names,
        fuzzy_names, merged_mapping, source_positions, source_removal, rendered_files, rendered_round_trip, rendered_preview, extracted_records,
        alias_persistence, batches_to_resume, health_report, merged_techniques, legacy_similarity, judge_trick_evidence, judge_group_evidence,
    )
}


def _values(rows: list[tuple]) -> str:
    def cell(v) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(map(cell, v)) + "]::VARCHAR[]"
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+'))"
_TOKENS = f"""
    tricks(id, technique, title, description, steps, code, confidence, created_at, sources) AS (VALUES {_values(_ROWS)}),
    tok AS (SELECT *, {_WORDS.format('title')} AS tt, {_WORDS.format('description')} AS td, {_WORDS.format("array_to_string(steps, ' ')")} AS ts, {_WORDS.format('code')} AS tc FROM tricks),
    sized AS (SELECT *, len(tt) + len(td) + len(ts) + len(tc) AS total FROM tok)
"""
_DOCUMENT_TOKENS = f"""
    tok AS (SELECT doc_id AS id, source AS technique, {_WORDS.format("string_split(text, chr(10))[1]")} AS tt, {_WORDS.format('text')} AS td, {_WORDS.format('lang')} AS ts, {_WORDS.format('source')} AS tc FROM documents),
    sized AS (SELECT *, len(tt) + len(td) + len(ts) + len(tc) AS total FROM tok)
"""


def _jaccard(c: str) -> str:
    return f"(CASE WHEN len(x.{c}) = 0 OR len(y.{c}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x.{c}, y.{c}))::DOUBLE / len(list_distinct(list_concat(x.{c}, y.{c}))) END)"


_COMBINED = f"(0.35 * {_jaccard('tt')} + 0.35 * {_jaccard('td')} + 0.2 * {_jaccard('ts')} + 0.1 * {_jaccard('tc')})"
_LIKENESS = f"(CASE WHEN {_jaccard('tc')} >= 0.6 THEN greatest({_jaccard('tc')}, {_COMBINED}) ELSE {_COMBINED} END)"
_DUPLICATE = f"""(CASE WHEN list_sort(x.tt) = list_sort(y.tt) AND list_sort(x.td) = list_sort(y.td) AND len(x.tt) + len(x.td) > 0 THEN true
    WHEN {_LIKENESS} < 0.72 THEN false WHEN {_jaccard('tc')} >= 0.6 THEN true
    ELSE NOT (x.total < 12 AND y.total < 12 AND {_LIKENESS} < 0.95) END)"""
_CLUSTERS = f"""
    ordered AS (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY confidence DESC, total DESC, title, created_at, id) AS rn FROM sized),
    dup AS (SELECT x.technique, x.rn AS r1, y.rn AS r2 FROM ordered x JOIN ordered y ON x.technique = y.technique AND x.rn < y.rn WHERE {_DUPLICATE}),
    fold AS (
        SELECT technique, 1 AS rn, [1::BIGINT] AS leaders, 1::BIGINT AS leader FROM ordered WHERE rn = 1
        UNION ALL
        SELECT f.technique, f.rn + 1,
               CASE WHEN l IS NULL THEN list_append(f.leaders, f.rn + 1) ELSE f.leaders END, coalesce(l, f.rn + 1)
        FROM (SELECT f.*, (SELECT min(r1) FROM dup WHERE dup.technique = f.technique AND r2 = f.rn + 1 AND list_contains(f.leaders, r1)) AS l FROM fold f) f
        WHERE EXISTS (SELECT 1 FROM ordered o WHERE o.technique = f.technique AND o.rn = f.rn + 1)
    ),
    clusters AS (SELECT o.id, o.technique, p.id AS leader FROM fold f JOIN ordered o ON o.technique = f.technique AND o.rn = f.rn JOIN ordered p ON p.technique = f.technique AND p.rn = f.leader)
"""

ORACLE_SQL = {
    "legacy_similarity": f"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS t, {_WORDS.format("concat_ws(' ', source, lang)")} AS k FROM documents),
             p AS (SELECT a.doc_id, a.text = '' AND b.text = '' AS none, len(list_intersect(a.t, b.t)) AS ti, len(list_intersect(a.k, b.k)) AS ki,
                          len(a.t) AS ta, len(b.t) AS tb, len(a.k) AS ka, len(b.k) AS kb FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
        SELECT doc_id, round(CASE WHEN none THEN 1.0::DOUBLE WHEN ta = 0 OR tb = 0 THEN 0 ELSE ti / (ta + tb - ti) END, 9) AS text_similarity,
               round(CASE WHEN ka = 0 OR kb = 0 THEN 0.0::DOUBLE ELSE ki / (ka + kb - ki) END, 9) AS list_similarity FROM p
    """,
    "judge_trick_evidence": """
        SELECT doc_id AS id, source AS technique, md5(string_split(text, chr(10))[1]) AS title_md5, md5(substring(coalesce(text, ''), 1, 300)) AS description_md5, coalesce(source, '') AS key_code FROM documents
    """,
    "judge_group_evidence": r"""
        WITH t AS (SELECT o_orderpriority AS name, array_to_string(list_sort(regexp_extract_all(lower(o_orderstatus || ' ' || year(o_orderdate)), '[\p{L}\p{N}_]+')), ' ') AS title FROM orders),
             c AS (SELECT name, title, count(*) AS n FROM t GROUP BY ALL),
             r AS (SELECT *, sum(n) OVER (PARTITION BY name) AS total, row_number() OVER (PARTITION BY name ORDER BY n DESC, title) AS nth FROM c)
        SELECT name, max(total)::BIGINT AS trick_count, string_agg(title, ';' ORDER BY nth) FILTER (nth <= 6) AS sample_titles FROM r GROUP BY name
    """,
    "extracted_records": "SELECT lang AS technique_name, 'Document ' || doc_id AS title, '/d/' || doc_id AS sources, 0.5::DOUBLE AS confidence FROM documents",
    "alias_persistence": "SELECT DISTINCT source || '_' || lang AS old, source || '_en' AS merged FROM documents WHERE lang NOT IN ('en', 'de')",
    "batches_to_resume": "SELECT DISTINCT conv_id AS batch_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 3)",
    "health_report": """
        SELECT 'documents' AS name, 'ok' AS status, (SELECT count(*) FROM documents) AS rows UNION ALL SELECT 'pages', 'ok', (SELECT count(*) FROM pages)
        UNION ALL SELECT 'embeddings', 'ok', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'nothing', 'warn', 0 UNION ALL SELECT 'missing', 'fail', NULL
    """,
    "merged_techniques": """
        SELECT * FROM (VALUES ('php_disable_functions_bypass', 'php_disable_functions_bypass'), ('php_disabled_functions_bypass', 'php_disable_functions_bypass'),
                              ('type_juggling', 'php_juggling'), ('php_juggling', 'php_juggling'), ('xss', 'xss')) t(old, merged)
    """,
    "trick_similarity": f"WITH {_DOCUMENT_TOKENS} SELECT x.id::BIGINT AS a, y.id::BIGINT AS b, round({_LIKENESS}, 9) AS similarity, {_DUPLICATE} AS duplicate FROM sized x JOIN sized y ON x.id + 1 = y.id",
    "lexical_clusters": f"WITH RECURSIVE {_TOKENS}, {_CLUSTERS} SELECT id::BIGINT AS id, technique, leader::BIGINT AS leader FROM clusters",
    "dedup_candidates": f"""
        WITH RECURSIVE {_TOKENS}, {_CLUSTERS}, t AS (SELECT s.*, leader AS cluster FROM sized s JOIN clusters c ON c.id = s.id)
        SELECT x.id::BIGINT AS a, y.id::BIGINT AS b FROM t x JOIN t y ON x.id < y.id AND x.cluster <> y.cluster
        WHERE (x.technique = y.technique AND len(list_intersect(x.sources, y.sources)) > 0)
           OR (x.technique = y.technique AND len(list_filter(list_intersect(x.tt, y.tt), lambda w: length(w) >= 4)) > 0
               AND len(x.tt) >= 3 AND len(y.tt) >= 3 AND {_jaccard('tt')} >= 0.5)
           OR (x.technique <> y.technique AND list_sort(x.tt) = list_sort(y.tt))
    """,
    "cluster_merge": f"""
        WITH RECURSIVE {_TOKENS}, {_CLUSTERS},
        t AS (SELECT s.*, leader AS cluster, length(title) + length(description) + coalesce(list_sum(list_transform(steps, lambda x: length(x))), 0) AS size FROM sized s JOIN clusters c ON c.id = s.id),
        best AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, size DESC, len(sources) DESC, id) = 1),
        s AS (SELECT cluster, u, min((id, i)) AS seen_at FROM (SELECT cluster, id, unnest(sources) AS u, generate_subscripts(sources, 1) AS i FROM t) GROUP BY ALL),
        k AS (SELECT cluster, code, min(id) AS seen_at FROM t WHERE code <> '' GROUP BY ALL)
        SELECT b.cluster::BIGINT AS cluster, b.technique AS technique_name, b.title,
               coalesce((SELECT string_agg(u, ',' ORDER BY seen_at) FROM s WHERE s.cluster = b.cluster), '') AS source_writeups,
               'always,' || (SELECT string_agg('c' || id, ',' ORDER BY id) FROM t WHERE t.cluster = b.cluster) AS conditions,
               b.technique AS original_terms,
               (SELECT string_agg(code, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seen_at) FROM k WHERE k.cluster = b.cluster) AS key_code,
               CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.cluster = b.cluster AND id = 2) THEN 'an example' END AS example,
               (SELECT round(avg(confidence::DOUBLE), 6) FROM t WHERE t.cluster = b.cluster) AS confidence,
               (SELECT min(created_at) FROM t WHERE t.cluster = b.cluster) AS created_at
        FROM best b
    """,
    "group_routing": """
        SELECT component, technique FROM (
            SELECT component, s_name AS technique, row_number() OVER (PARTITION BY component ORDER BY s_acctbal DESC, s_suppkey) AS r
            FROM (SELECT *, CASE WHEN s_nationkey % 2 = 0 THEN min(s_suppkey) OVER (PARTITION BY s_nationkey) ELSE s_suppkey END AS component FROM supplier)) WHERE r = 1
    """,
    "technique_name_pairs": """
        SELECT a, b, ratio::DOUBLE AS ratio, dice::DOUBLE AS dice, decision FROM (VALUES ('php_disable_functions_bypass', 'php_disabled_functions_bypass', 98.2456, 0.75, 'merge'),
                              ('disable_functions_bypass', 'php_disable_functions_bypass', 92.3077, 0.857143, 'merge'),
                              ('disable_functions_bypass', 'php_disabled_functions_bypass', 90.566, 0.571429, 'judge'),
                              ('aslr_bypass', 'kaslr_bypass', 95.6522, 0.5, 'judge'),
                              ('json_injection', 'jsonp_injection', 96.5517, 0.5, 'judge'),
                              ('heap_integer_overflow', 'heap_integer_underflow', 88.3721, 0.666667, 'judge')) t(a, b, ratio, dice, decision)
    """,
    "technique_content_pairs": f"""
        WITH t AS (SELECT DISTINCT source AS s, list_sort({_WORDS.format("string_split(text, chr(10))[1]")}) AS w FROM documents)
        SELECT x.s AS a, y.s AS b, count(*) AS shared FROM t x JOIN t y ON x.w = y.w AND x.s < y.s WHERE len(x.w) > 0 GROUP BY x.s, y.s HAVING count(*) >= 2
    """,
    "canonical_names": """
        SELECT * FROM (VALUES ('SQLi', 'sql_injection'), ('blind SQL injection', 'sql_injection'), ('XSS', 'cross_site_scripting'), ('unknown-trick (rare)', 'unknown_trick_rare'),
                              ('a very long name about blind_sql_injection in a login form', 'sql_injection'), ('a quite long unknown technique of the kind', 'c')) t(name, canonical)
    """,
    "fuzzy_names": "SELECT 'heap_overflows' AS name, 'heap_overflow' AS match, 96.2963::DOUBLE AS ratio",
    "merged_mapping": """
        WITH g AS (SELECT n_name, n_regionkey, n_nationkey % 7 <> 0 AS other, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation)
        SELECT n_name AS old, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY other, n DESC, length(n_name), n_name) AS merged FROM g
    """,
    "source_positions": """
        WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS record_id, l_linenumber, '/o/' || l_orderkey || '/a' AS a, '/o/' || l_orderkey || '/b' AS b FROM lineitem)
        SELECT record_id, CASE l_linenumber WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN a WHEN 4 THEN b WHEN 5 THEN a || ',' || b ELSE '' END AS sources FROM l
    """,
    "source_removal": """
        SELECT l_orderkey, l_linenumber, array_to_string(list_filter(CASE WHEN l_returnflag = l_linestatus THEN [l_returnflag] ELSE [l_returnflag, l_linestatus] END, lambda u: u <> 'O'), ',') AS sources
        FROM lineitem WHERE NOT (l_returnflag = 'O' AND l_linestatus = 'O')
    """,
    "rendered_round_trip": f"""
        WITH {_TOKENS} SELECT technique, title, description, 'a parameter;a database' AS conditions, array_to_string(steps, ';') AS steps, code AS key_code,
               CASE sources[1] WHEN 'u1' THEN 'Login (CTF 1)' WHEN 'u5' THEN 'Blog (CTF 2)' END AS example_challenge FROM tricks
    """,
}
