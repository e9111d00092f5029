"""Services that fail, sinks, evidence, refused pages and diagnostics."""

import json

import pytest
from pyspark.sql import functions as F

from sievelake import models, prompts
from sievelake.functions.text import legacy_list_similarity, legacy_text_similarity
from sievelake.operators.evidence import group_evidence, trick_evidence, with_evidence
from sievelake.plans import diagnostics as D
from sievelake.plans import workflow as W
from sievelake.sources import files, state
from sievelake.streaming import ingest


class NameJudge:
    """Merges pairs with equal titles; batches that show 'broken' fail, pair 1 of a batch gets no verdict."""

    def answer(self, system, prompt):
        assert system == prompts.JUDGE
        if "broken" in prompt:
            raise ValueError("no answer")
        pairs = json.loads(prompt)
        assert len(pairs) <= 20
        verdicts = [{"pair_id": p["pair_id"], "verdict": "MERGE" if p["a"]["title"] == p["b"]["title"] else "keep"} for p in pairs if p["pair_id"] != 1]
        return json.dumps({"verdicts": verdicts})


def _pairs(spark, titles):
    rows = [(n, n + 1000, json.dumps({"title": a}), json.dumps({"title": b})) for n, (a, b) in enumerate(titles)]
    return spark.createDataFrame(rows, "a long, b long, evidence_a string, evidence_b string")


def test_judge_batches(spark):
    judge = models.ServiceJudge(NameJudge(), concurrency=1)
    many = judge.judge(_pairs(spark, [("x", "x" if n % 2 == 0 else "y") for n in range(45)])).collect()
    assert len(many) == 45
    assert sum(r.verdict == "merge" for r in many) in range(20, 24)  # one pair of each of three batches has no verdict
    assert all(r.a % 2 == 0 for r in many if r.verdict == "merge")
    assert [r.verdict for r in judge.judge(_pairs(spark, [("x", "x"), ("broken", "broken")])).collect()] == ["keep", "keep"]
    assert judge.judge(_pairs(spark, []).where("a < 0")).count() == 0


def test_evidence(spark):
    rows = [(n, "t", f"B a {n % 8}", "d" * 500, None) for n in range(20)] + [(20, "u", None, None, "c" * 500)]
    df = spark.createDataFrame(rows, "id long, technique string, title string, description string, key_code string")
    shown = {r.id: json.loads(r.evidence) for r in trick_evidence(df).collect()}
    assert shown[0] == {"technique": "t", "title": "B a 0", "description": "d" * 300, "key_code": ""}
    assert shown[20] == {"technique": "u", "title": None, "description": "", "key_code": "c" * 200}
    groups = {r.id: json.loads(r.evidence) for r in group_evidence(df).collect()}
    assert groups["t"] == {"name": "t", "trick_count": 20, "sample_titles": [f"{n} a b" for n in (0, 1, 2, 3, 4, 5)]}
    assert groups["u"] == {"name": "u", "trick_count": 1, "sample_titles": [""]}
    pair = with_evidence(spark.createDataFrame([("t", "gone")], "a string, b string"), group_evidence(df)).first()
    assert json.loads(pair.evidence_a)["name"] == "t" and pair.evidence_b is None
    assert group_evidence(df.limit(0)).count() == 0


class Scores:
    def __init__(self, found):
        self.found = found

    def score(self, query, documents):
        if self.found is None:
            raise OSError("unreachable")
        assert (query, documents) == ("asked", ["one", "", "three"])
        return self.found


@pytest.mark.parametrize(("found", "want"), [([(2, 0.9), (0, 0.4), (7, 1.0), (-1, 1.0)], [0.4, 0.0, 0.9]), ([], [0.0] * 3), (None, [0.0] * 3), ([(0, 1.0), (1, "x")], [0.0] * 3)])
def test_reranker_falls_back(spark, found, want):
    rows = spark.createDataFrame([(1, "one", 1), (2, None, 2), (3, "three", 3)], "doc_id long, text string, recall_rank int")
    asked = spark.createDataFrame([("asked",)], "text string")
    got = models.ServiceReranker(Scores(found)).rerank(rows, asked).orderBy("recall_rank").collect()
    assert [r.rerank_score for r in got] == want
    assert got[0].asDict().keys() == {"doc_id", "text", "recall_rank", "rerank_score"}


def test_optional_signal():
    now, calls = [0.0], []

    def fails():
        calls.append(1)
        raise OSError

    signal = models.OptionalSignal(120, lambda: now[0])
    assert signal.ask(lambda: 5) == 5
    assert signal.ask(fails) is None
    now[0] = 119.0
    assert signal.ask(fails) is None and len(calls) == 1
    now[0] = 120.0
    assert signal.ask(lambda: 6) == 6


class Asker:
    def answer(self, system, prompt):
        assert system == prompts.QUESTIONS and len(prompt) <= 32_000
        if "broken" in prompt:
            raise ValueError
        return json.dumps({"questions": ["short", "how is it done?", 123456789]} if "dict" in prompt else ["when to use it?", "x"])


def test_questions(spark, tmp_path):
    rows = [("a", "dict"), ("b", "x" * 50_000), ("c", "broken"), ("d", None)]
    found = models.generate_questions(spark.createDataFrame(rows, "name string, content string"), Asker())
    got = sorted((r.technique_name, r.question_text) for r in found.collect())
    assert got == [("a", "123456789"), ("a", "how is it done?"), ("b", "when to use it?"), ("d", "when to use it?")]
    path = f"file://{tmp_path}/questions"
    assert state.save_questions(found.where("technique_name = 'a'"), path).count() == 2
    assert state.save_questions(found, path).count() == 4


def test_prompt_keeps_case(spark):
    row = spark.createDataFrame([("Some TEXT {x}",)], "t string").select(prompts.extraction_prompt(F.col("t")).alias("p")).first().p
    assert row.system == prompts.EXTRACT and row.user == prompts.extraction_message("Some TEXT {x}") and "Some TEXT {x}" in row.user


def test_sinks(spark, tmp_path):
    rows = [("b", 'q"\n', None), ("a", "é", "z"), ("c", None, "")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    for n, frame in enumerate((df.repartition(3), df.limit(0), df)):
        path = f"file://{tmp_path}/j{n}"
        files.write_json_array(frame, path, 1 if n == 2 else None)
        back = files.read_json_array(spark, path, "x string, y string, z string", strict=True)
        assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    written = next((tmp_path / "j2").glob("part-*")).read_text()
    assert [r["x"] for r in json.loads(written)] == ["b", "a", "c"]
    aliases = spark.createDataFrame([("xss", "cross_site"), ("a_b", "a"), (None, "x")], "alias string, canonical string")
    state.write_alias_overrides(aliases, f"file://{tmp_path}/alias")
    back = state.read_alias_overrides(spark, f"file://{tmp_path}/alias").orderBy("pos").collect()
    assert [(r.alias, r.canonical) for r in back] == [("a_b", "a"), ("xss", "cross_site")]


def test_legacy_similarity(spark):
    rows = [(None, "", 1.0), ("a", "", 0.0), ("..", "--", 0.0), ("A b", "b c", 1 / 3)]
    for a, b, want in rows:
        r = spark.createDataFrame([(a, b)], "a string, b string")
        lists = [F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>")) for c in (F.col("a"), F.col("b"))]
        got = r.select(legacy_text_similarity(F.col("a"), F.col("b")).alias("t"), legacy_list_similarity(*lists).alias("l")).first()
        assert (got.t, got.l) == (want, want)


def test_refused_and_pasted(spark):
    pages = spark.createDataFrame([("u1", "<p>" + "word " * 60 + "</p>"), ("u2", "<p>few</p>"), ("u3", ""), ("u4", None)], "url string, html string")
    refused = {r.url: r.error for r in ingest.refused_pages(pages).collect()}
    assert refused == {"u2": "too short (3 characters)", "u3": "no readable content", "u4": "no readable content"}
    assert [r.url for r in ingest.cleaned_pages(pages).collect()] == ["u1"]
    row = ingest.pasted_writeup(spark, "Some words. " * 20, title=" ", source=" ", url="https://x.y/a-b").first()
    assert (row.source, row.challenge_title, row.challenge_source, row.url) == ("content", "A B", "manual", "https://x.y/a-b")
    for content in ("", " ", "too little"):
        with pytest.raises(ValueError, match="pasted content"):
            ingest.pasted_writeup(spark, content)


def test_merging_asks_the_service(spark):
    rows = [(1, "php", "same title of both", "load"), (2, "php", "same title of both again", "run"), (3, "xss", "broken thing of all", "x")]
    df = spark.createDataFrame(rows, "id long, technique string, title string, description string").withColumn("confidence", F.lit(0.5).cast("double"))
    empty, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    df = df.withColumns({c: empty for c in ("implementation_steps", "source_writeups", "conditions", "detection_signs", "original_terms")})
    df = df.withColumns({c: text for c in ("key_code", "example", "example_challenge", "created_at", "category")}).withColumn("technique_name", F.col("technique"))
    assert W.dedup_tricks(df, judge=models.ServiceJudge(NameJudge())).count() == 3


def test_diagnose(spark, tmp_path):
    def unreachable():
        raise OSError("down")

    report, code = D.diagnose(spark, D.Setup())
    found = {r.name: r.status for r in report.collect()}
    assert code == 1
    assert found == {
        "llm key": "fail", "embedding key": "warn", "llm url": "ok", "embedding url": "ok", "output tokens": "ok", "data": "fail", "directories": "ok",
        "batches": "skip", "technique files": "skip", "index": "skip", "llm": "skip", "embedding": "skip",
    }
    (tmp_path / "data.json").write_text('[{"url": "u"}]')
    (tmp_path / "broken.json").write_text('[{"url": ')
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.md").write_text("# A\n\n## One\n\n## Two\n")
    base = f"file://{tmp_path}"
    state.record_batches(spark.createDataFrame([(1, "completed", ["u"])], "batch_id long, status string, unresolved_urls array<string>"), f"{base}/state")
    state.write_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), f"{base}/index")
    setup = D.Setup(
        "k" * 20, "e" * 20, data=f"{base}/data.json", directories=(base,), batch_state=f"{base}/state", files=f"{base}/files", index=f"{base}/index",
        probes={"llm": lambda: "model", "embedding": unreachable},
    )
    report, code = D.diagnose(spark, setup)
    got = {r["name"]: (r["status"], r["detail"]) for r in json.loads(D.as_json(report))}
    assert code == 1 and got["embedding"] == ("fail", "OSError: down") and got["llm"] == ("ok", "reachable (model)")
    assert got["llm key"] == ("ok", "kkkk...kkkk") and got["batches"] == ("ok", "1 completed")
    assert got["technique files"] == ("ok", "1 files, 2 sections") and got["index"] == ("ok", "1 documents") and got["data"][0] == "ok"
    assert D.diagnose(spark, setup, connect=False)[1] == 0
    broken = {r.name: r.status for r in D.diagnose(spark, D.Setup(data=f"{base}/broken.json"), connect=False)[0].collect()}
    assert broken["data"] == "fail"


def test_commands(spark, tmp_path, capsys):
    from sievelake.__main__ import main

    base = f"file://{tmp_path}"
    spark.createDataFrame([(1, "heap spray"), (2, "stack pivot pivot")], "doc_id long, text string").write.parquet(f"{base}/docs")
    spark.createDataFrame([(2, "stack pivot pivot"), (3, "heap heap")], "doc_id long, text string").write.parquet(f"{base}/more")
    assert main(["build-index", f"{base}/docs", f"{base}/index"]) == 0
    assert main(["add-to-index", f"{base}/more", f"{base}/index"]) == 0
    capsys.readouterr()
    assert main(["query", f"{base}/index", "heap?"]) == 0
    shown = capsys.readouterr().out
    assert [line.split("|")[1].strip() for line in shown.splitlines() if line.startswith("|")] == ["doc_id", "3", "1"]
    assert main(["query", f"{base}/index", "..."]) == 0
    record = {"technique_name": "SQLi", "title": "time based", "category": "web", "description": "sleep", "source_writeups": ["u"], "confidence": 0.5}
    (tmp_path / "tricks.json").write_text(json.dumps([record, record, {**record, "title": "union", "description": "columns"}]))
    (tmp_path / "alias.yaml").write_text("technique_mapping:\n  sqli: sql_injection\n")
    assert main(["dedup", f"{base}/tricks.json", f"{base}/alias.yaml", f"{base}/out"]) == 0
    text = (tmp_path / "out" / "sql_injection.md").read_text()
    assert text.count("time based") == 1 and "union" in text
    assert main(["check", f"{base}/tricks.json"]) == 1  # no key is set
    assert main(["check"]) == 2 and main([]) == 2 and main(["query", "x"]) == 2
