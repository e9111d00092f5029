import json

from pyspark.sql import functions as F

from sievelake import models
from sievelake.operators.chunking import parse_tricks
from sievelake.plans import workflow as W
from sievelake.sources import state
from tests.conftest import SMALL

ALIASES = [("sqli", "sql_injection", 0), ("sql_injection", "sql_injection", 1), ("xss", "xss", 2)]


class Canned:
    """Three records, two of one payload; prompts with 'broken' fail."""

    def extract(self, prompt):
        if "broken" in prompt:
            raise ValueError("no answer")
        if "other" in prompt:
            return "[]"
        records = [
            {"technique_name": "sqli", "title": "time based blind", "category": "web", "description": "sleep to leak bits", "key_code": "SLEEP(10)", "implementation_steps": ["inject"], "confidence": 0.9, "source_indexes": [1]},
            {"technique_name": "sql_injection", "title": "delay on login", "category": "web", "description": "measure replies", "key_code": "SLEEP(10)", "implementation_steps": None, "confidence": 0.8, "source_indexes": [2, 99]},
            {"technique_name": "sqli", "title": "union columns", "category": "web", "description": "count and read", "confidence": 0.7},
            {"title": "nameless"},
        ]
        return "```json\n" + json.dumps(records) + "\n```"


def _no_wait(_):
    return None


def _extracted(spark):
    rows = [(1, 1, "u1", "text"), (1, 2, "u2", "text"), (1, 3, "u3", "text"), (2, 1, "u4", "broken"), (2, 2, "u5", "other")]
    batched = spark.createDataFrame(rows, "batch_id long, pos long, url string, cleaned_content string")
    named = batched.withColumns({"challenge_source": F.lit("s"), "challenge_title": F.lit("t"), "challenge_category": F.array(F.lit("web"))})
    return W.extract_tricks(W.batch_items(named), Canned(), "2024-01-01", sleep=_no_wait)


def test_extract_and_distil(spark):
    records, failures = _extracted(spark)
    assert sorted((r.title, r.source_writeups) for r in records.collect()) == [("delay on login", ["u2"]), ("time based blind", ["u1"]), ("union columns", ["u1", "u2", "u3"])]
    assert [tuple(r) for r in failures.collect()] == [(2, ["u4"])]
    tricks = records.orderBy("title").withColumn("id", F.when(F.col("title").startswith("t"), 1).when(F.col("title").startswith("d"), 2).otherwise(3).cast("long"))
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string, pos long")
    files = W.distil(tricks, aliases)
    assert [r.name for r in files.collect()] == ["sql_injection"]
    parsed = {r.title: r for r in parse_tricks(files).collect()}
    assert set(parsed) == {"time based blind", "union columns"}
    merged = W.lexical_dedup(tricks, aliases)
    assert {tuple(r.source_writeups) for r in merged.collect()} == {("u1", "u2"), ("u1", "u2", "u3")}
    assert W.preview_chunks(merged).count() >= 2
    stats = W.dedup_stats(tricks, merged, merged.limit(0)).first()
    assert (stats.tricks, stats.clusters, stats.merges) == (3, 2, 1)
    again = W.replace_url(merged, "u1", merged.limit(0))
    assert {tuple(r.source_writeups) for r in again.collect()} == {("u2",), ("u2", "u3")}


def test_reprocess_embeds_only_changes(spark, tmp_path):
    records, _ = _extracted(spark)
    tricks = records.withColumn("id", F.when(F.col("title").startswith("t"), 1).otherwise(F.length("title")).cast("long"))
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string, pos long")
    none = spark.createDataFrame([], "chunk_id string, embedding array<float>"), spark.createDataFrame([], "chunk_id string, sha256 string")
    files, vectors, now = W.reprocess(tricks, aliases, models.HashEmbedder(8), *none, f"file://{tmp_path}/index")
    assert vectors.count() == now.count() >= 3

    class Refuses:
        def embed(self, texts):
            raise AssertionError("nothing has changed")

    _, again, _ = W.reprocess(tricks, aliases, Refuses(), vectors, now, f"file://{tmp_path}/index")
    assert sorted(map(str, again.collect())) == sorted(map(str, vectors.collect()))
    assert state.read_index(spark, f"file://{tmp_path}/index", ["SLEEP"]).count() == 1


def test_techniques_and_second_stage(spark):
    rows = [
        (1, "php_disable_functions_bypass", "ld preload library trick", "load a library", 0.9),
        (2, "php_disabled_functions_bypass", "ld preload library hook", "load a library", 0.8),
        (3, "php_disable_functions_bypass", "imap open command", "call imap", 0.8),
        (4, "aslr_bypass", "leak a pointer", "leak", 0.5),
        (5, "kaslr_bypass", "time the prefetch", "time", 0.5),
    ]
    df = spark.createDataFrame(rows, "id long, technique string, title string, description string, confidence double")
    empty = F.array().cast("array<string>")
    text = F.lit(None).cast("string")
    df = df.withColumns({c: empty for c in ("implementation_steps", "source_writeups", "conditions", "detection_signs", "original_terms")})
    df = df.withColumns({c: text for c in ("key_code", "example", "example_challenge", "created_at", "category")}).withColumn("technique_name", F.col("technique"))
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string, pos long")
    mapping, pending = W.merge_techniques(df, aliases, judge=models.ThresholdJudge(0.99))
    found = {r.old: r.merged for r in mapping.collect()}
    assert found["php_disabled_functions_bypass"] == "php_disable_functions_bypass"
    assert found["aslr_bypass"] != found["kaslr_bypass"]
    same = df.withColumn("technique", F.when(F.col("technique").startswith("php"), "php").otherwise(F.col("technique")))
    merged = W.dedup_tricks(same, models.HashEmbedder(64), models.ThresholdJudge(0.5))
    assert merged.count() == 4
    assert W.dedup_tricks(same).count() == 5


def test_state_and_index(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert state.latest_batches(spark, path).count() == 0
    for status in ("failed", "completed"):
        state.record_batches(spark.createDataFrame([(1, status, ["u"])], "batch_id long, status string, unresolved_urls array<string>"), path)
    assert [r.status for r in state.latest_batches(spark, path).collect()] == ["completed"]
    state.reset_state(spark, path, state.BATCH_STATE)
    assert state.read_state(spark, path, state.BATCH_STATE).count() == 0
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c")], "doc_id long, text string")
    state.write_index(docs.limit(1), f"file://{tmp_path}/index")
    state.add_to_index(docs, f"file://{tmp_path}/index")
    rows = state.read_index(spark, f"file://{tmp_path}/index", ["b"]).collect()
    assert sorted((r.doc_id, r.tf, r.dl) for r in rows) == [(1, 2, 3), (2, 1, 2)]
    (tmp_path / "m.yaml").write_text("other: 1\ntechnique_mapping:\n  sqli: sql_injection  # note\n  'x-y': \"cross site\"\nmore:\n  a: b\n")
    got = [(r.alias, r.canonical) for r in state.read_alias_overrides(spark, f"file://{tmp_path}/m.yaml").orderBy("pos").collect()]
    assert got == [("sqli", "sql_injection"), ("x-y", "cross site")]
    assert state.read_alias_overrides(spark, f"file://{tmp_path}/none.yaml").count() == 0
    pages = spark.createDataFrame([("u1", "<p>x</p>")], "url string, html string")
    assert state.TableFetcher(pages).fetch(spark.createDataFrame([("u1",), ("u2",)], "url string")).count() == 1
    report = {r.name: r.status for r in W.health({"a": docs, "b": docs.limit(0), "c": None}).collect()}
    assert report == {"a": "ok", "b": "warn", "c": "fail"}


def test_command_line(spark, tmp_path, capsys):
    from sievelake.__main__ import main

    assert main(["list"]) == 0
    assert "bm25_topk" in capsys.readouterr().out
    assert main(["run", "no_such_query", "x"]) == 2
    assert main(["run", "merged_mapping", SMALL]) == 0
    assert main(["write", "merged_mapping", SMALL, f"file://{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 25  # a row for each nation
