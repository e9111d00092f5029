import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sievelake import models, schemas
from sievelake.operators.batching import local_batches, number_batches, unprocessed
from sievelake.operators.canonical import fuzzy_matches
from sievelake.operators.chunking import chunk_files, overlap_tail, parse_section, sections, split_section
from sievelake.operators.cluster import leader_clusters
from sievelake.operators.components import connected_components
from sievelake.operators.incremental import chunk_changes, refresh_questions, refresh_vectors
from sievelake.operators.relational import fill_gaps, merge_corpora
from sievelake.operators.search import build_postings, bm25_from_index, bm25_scores, corpus_stats, terms
from sievelake.sources import files as S
from sievelake.storage import Scratch
from sievelake.streaming import ingest
from sievelake.streaming.ingest import cleaned_pages, new_urls_only, start_ingest


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(None, 1), (7, 7)]
    rng.shuffle(edges)
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in found.collect()} == label
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_sections():
    text = "intro\n## A\nx\n```\n## not one\n```\n## B ```inline```\ny"
    assert sections(text) == [("overview", "intro"), ("A", "## A\nx\n```\n## not one\n```"), ("B ```inline```", "## B ```inline```\ny")]
    assert sections("## A\n## B") == [("A", "## A"), ("B", "## B")]
    assert sections("") == [("overview", "")]
    assert sections("\n## A") == [("overview", ""), ("A", "## A")]


def test_splitting():
    assert split_section("short") == ["short"]
    paragraph = "word " * 100
    parts = split_section("\n\n".join([paragraph.strip()] * 9))
    assert len(parts) > 2
    assert all(len(p) <= 2000 + 200 + 2 for p in parts)
    sentences = split_section("One sentence here. " * 300)
    assert len(sentences) > 2
    assert overlap_tail("abc", 5) == "abc"
    assert overlap_tail("a\nb" * 4 + "cc", 4) == "bcc"
    assert overlap_tail("abcdefgh", 3) == "fgh"


def test_chunk_numbers(spark):
    df = spark.createDataFrame([("t", "intro\n## A\n" + "p. " * 1500 + "\n## A\nz"), ("u", None)], "name string, content string")
    ids = [r.chunk_id for r in chunk_files(df).where("technique_name = 't'").collect()]
    assert ids == [f"t__c{i}" for i in range(len(ids))]
    assert len(ids) > 3


def test_parse_section_keeps_fences():
    text = "## T\n\nDescription: d: e\nConditions: a; b;\n\nKey code/payload:\n\n```\nDescription: no\n- x\n```\n\nExample:\n\n```\n\n```\n\nDetection signs:\n- s\n- t\n\nExample challenge: c (s)"
    assert parse_section(text) == ("d: e", ["a", "b"], [], "Description: no\n- x", None, ["s", "t"], "c (s)")


def test_batches_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Web ", "pwn", ""]), rng.choice("ab"), rng.choice([1, 40, 99, 100, 150]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, category string, challenge_source string, tokens int, pos long")
    got = {r.id: r.batch_id for r in number_batches(local_batches(df, 5, 100), df).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1].strip().lower(), []).append(r)
    batches = []
    for group in sorted(groups.values(), key=len, reverse=True):
        held, total = [], 0
        for r in sorted(group, key=lambda r: (r[2], r[4])):
            if r[3] >= 100:
                batches += [held] * bool(held) + [[r]]
                held, total = [], 0
                continue
            if held and total + r[3] > 100:
                batches.append(held)
                held, total = [], 0
            held, total = [*held, r], total + r[3]
            if len(held) >= 5:
                batches.append(held)
                held, total = [], 0
        batches += [held] * bool(held)
    assert got == {r[0]: n for n, b in enumerate(batches) for r in b}
    done = spark.createDataFrame([(0, "completed"), (1, "failed")], "batch_id long, status string")
    assert 0 not in {r.batch_id for r in unprocessed(spark.createDataFrame([(0,), (1,), (2,)], "batch_id long"), done).collect()}


def test_leaders_do_not_depend_on_row_order(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, rng.choice("xy"), " ".join(rng.sample(words, 3)), " ".join(rng.sample(words, 4)), [rng.choice(words)], rng.choice([None, "code one", "code two"]), rng.choice([0.5, 0.9]), f"2024-01-{i % 28 + 1:02d}") for i in range(80)]
    schema = "id long, technique string, title string, description string, implementation_steps array<string>, key_code string, confidence double, created_at string"
    first = {r.id: r.leader for r in leader_clusters(spark.createDataFrame(rows, schema)).collect()}
    rng.shuffle(rows)
    assert {r.id: r.leader for r in leader_clusters(spark.createDataFrame(rows, schema).repartition(5)).collect()} == first
    assert len(set(first.values())) < 80
    assert all(first[leader] == leader for leader in first.values())


def test_gaps_and_merge(spark):
    w = spark.createDataFrame([("u1", 1), ("u2", 2)], "url string, pos long")
    t = spark.createDataFrame([(["u1", "u9"],)], "source_writeups array<string>")
    assert [r.url for r in fill_gaps(w, t).collect()] == ["u2"]
    assert fill_gaps(w, t.limit(0)).count() == 2
    assert fill_gaps(w, t.limit(0), parity=True).count() == 0
    assert fill_gaps(w, t, parity=True).count() == 1
    merged = merge_corpora(w, spark.createDataFrame([("u2", 1), ("u3", 5), ("u3", 4), ("", 1), (None, 2)], "url string, pos long"))
    assert sorted(tuple(r) for r in merged.collect()) == [("u1", 1), ("u2", 2), ("u3", 4)]
    assert sorted(tuple(r) for r in merge_corpora(merged, merged).collect()) == sorted(tuple(r) for r in merged.collect())


def test_index_and_scan_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    query = spark.createDataFrame([("The the license of Apache",)], "text string")
    postings = build_postings(docs)
    asked = query.select(F.array_distinct(terms(F.col("text"))).alias("t")).first().t
    assert sorted(map(tuple, bm25_from_index(postings, corpus_stats(postings), asked).collect())) == sorted(map(tuple, bm25_scores(docs, query).collect()))


def test_unchanged_chunks_need_nothing(spark):
    chunks = spark.createDataFrame([("a__c0", "a", "", "text one", 2), ("b__c0", "b", "", "text two", 2)], schemas.CHUNK)
    empty_v = spark.createDataFrame([], "chunk_id string, embedding array<float>")
    empty_s = spark.createDataFrame([], "chunk_id string, sha256 string")
    vectors, state = refresh_vectors(chunks, empty_v, empty_s, models.HashEmbedder(8))
    assert chunk_changes(chunks, state).where("change <> 'same'").count() == 0
    later = spark.createDataFrame([("a__c0", "a", "", "text three", 2)], schemas.CHUNK)
    changes = chunk_changes(later, state)
    assert {r.chunk_id: r.change for r in changes.collect()} == {"a__c0": "changed", "b__c0": "deleted"}
    vectors2, state2 = refresh_vectors(later, vectors, state, models.HashEmbedder(8))
    assert [r.chunk_id for r in vectors2.collect()] == [r.chunk_id for r in state2.collect()] == ["a__c0"]
    asked = spark.createDataFrame([("a", "old?"), ("b", "old?")], "technique_name string, question_text string")
    found = {(r.technique_name, r.question_text) for r in refresh_questions(later, asked, changes).collect()}
    assert found == {("a", q) for q in models.question_templates("a")}


def test_model_wrappers():
    class Fussy:
        calls = 0

        def embed(self, texts):
            self.calls += 1
            if self.calls == 1:
                raise OSError("flaky")
            if len(texts) > 2:
                raise ValueError("batch larger than max")
            return [[float(len(t))] for t in texts]

    texts = ["a", "bb", "ccc", "dddd", "eeeee"]
    assert models.embed_all(Fussy(), texts, sleep=lambda _: None) == [[1.0], [2.0], [3.0], [4.0], [5.0]]
    assert models.parse_json('say ```json\n[{"technique_name": 1}]\n``` ok') == [{"technique_name": 1}]
    assert models.records_of(models.parse_json('text [1] and [{"technique_name": "x"}] and {cut}')) == [{"technique_name": "x"}]
    assert models.records_of(models.parse_json("nothing")) == []
    assert models.verdicts_of({"results": [{"id": 1, "verdict": "MERGE"}, {"pair_id": 2, "verdict": "keep"}, {"id": "3", "verdict": "keep"}, {"id": 4, "verdict": "?"}]}) == {1: "merge", 2: "keep"}

    class Half:
        def extract(self, prompt):
            if "bad" in prompt or prompt.count(",") > 1:
                raise ValueError
            return json.dumps([{"technique_name": prompt}])

    found, failed = models.extract_resolved(Half(), ["a", "bad", "c", "d"], ",".join, sleep=lambda _: None)
    assert failed == ["bad"]
    assert [items for items, _ in found] == [["a"], ["c", "d"]]


def test_files(spark, tmp_path):
    records = [{"technique_name": "a", "title": "t", "source_writeups": ["u"], "conditions": None}, {"technique_name": "b", "title": "t2", "source_writeups": None}]
    (tmp_path / "t.jsonl").write_text(json.dumps(records[0]) + "\n\nnot json\n" + json.dumps(records[1]) + "\n")
    (tmp_path / "t.json").write_text(json.dumps(records[:1]))
    for name in ("t.jsonl", "t.json"):
        rows = S.read_tricks(spark, f"file://{tmp_path}/{name}").collect()
        assert [(r.technique_name, r.conditions, r.source_writeups) for r in rows] == [("a", [], ["u"])]
    assert S.read_tricks(spark, f"file://{tmp_path}/none.json").count() == 0
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        S.read_jsonl(spark, f"file://{tmp_path}/t.jsonl", schemas.TRICK, strict=True).collect()
    files = spark.createDataFrame([("one two", "# 1\n"), ("b", "## x\n")], "name string, content string")
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "stale.md").write_text("old")
    S.write_markdown(files, f"file://{tmp_path}/md", spark)
    assert sorted(map(tuple, S.read_markdown_dir(spark, f"file://{tmp_path}/md").collect())) == [("b", "## x\n"), ("one two", "# 1\n")]
    upload = spark.createDataFrame([(bytearray(b"ok \xff"),), (bytearray(b"  "),)], "data binary")
    assert [r[0] for r in upload.select(S.decoded_upload(F.col("data"))).collect()] == ["ok �", None]


def test_writeup_cache(spark, tmp_path):
    body = "<p>" + "long text " * 80 + "</p>"
    raw = [{"url": "u1", "challenge_name": "n", "content": body}, {"url": "u2", "challenge_title": "", "challenge_name": "n", "content": "short"}]
    source, cache = f"file://{tmp_path}/raw.json", f"file://{tmp_path}/cache"
    (tmp_path / "raw.json").write_text(json.dumps(raw))
    assert [(r.url, r.challenge_title) for r in S.load_writeups(spark, source, cache).collect()] == [("u1", "n")]
    assert S.load_writeups(spark, source, cache).count() == 1
    table = S.read_json_array(spark, source, schemas.WRITEUP)
    assert S.lookup_url("u2", S.load_writeups(spark, source, cache), table).first().cleaned_content == "short"
    assert S.lookup_url("u9", S.load_writeups(spark, source, cache), table).count() == 0


def test_stream(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.repartition(3).write.parquet(f"file://{tmp_path}/in")
    out = [f"file://{tmp_path}/{n}" for n in ("acc", "all", "chk")]
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        start_ingest(stream, *out).awaitTermination()
    got = spark.read.parquet(out[1])
    assert sorted(r.url for r in got.collect()) == sorted(r.url for r in cleaned_pages(pages).collect())
    timed = spark.readStream.schema("url string, html string, ts timestamp").parquet(f"file://{tmp_path}/in")
    assert new_urls_only(timed).isStreaming


@pytest.mark.parametrize("step", [1, 2, 4])
def test_stream_after_a_failure(spark, tmp_path, monkeypatch, step):
    """The write of either table fails once, in the first or second batch; the next run gives all rows, none twice."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.repartition(2).write.parquet(f"file://{tmp_path}/in")
    out = [f"file://{tmp_path}/{n}" for n in ("acc", "all", "chk")]
    write, calls = ingest._replace, []

    def failing(rows, path, number):
        calls.append(path)
        if len(calls) == step:
            raise RuntimeError("lost")
        write(rows, path, number)

    monkeypatch.setattr(ingest, "_replace", failing)
    for _ in range(2):
        query = start_ingest(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), *out)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            assert len(calls) == step
    want = sorted(r.url for r in cleaned_pages(pages).collect())
    assert [sorted(r.url for r in spark.read.parquet(path).collect()) for path in out[:2]] == [want, want]


def _ratio(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return round(200 * last[-1] / (len(a) + len(b)), 4) if a or b else 100.0


def test_fuzzy_matches_against_all_pairs(spark):
    """Names that share no word with their match, and edits of random names, against brute force."""
    rng = random.Random(4)
    known = ["heap_overflow", "sql_injection", "deserialization", "xss", "", *("".join(rng.choice("abcdefgh_") for _ in range(rng.randint(3, 20))) for _ in range(150))]
    unknown = ["heapoverflow", "sqlinjection", "deserialisation", "ß", "", *("".join(c for c in rng.choice(known) + rng.choice("abé") if rng.random() < 0.85) for _ in range(60))]
    want = {}
    for name in set(unknown):
        ratio, match = min((-_ratio(name, k), k) for k in set(known))
        if -ratio >= 70:
            want[name] = (match, -ratio)
    got = fuzzy_matches(*(spark.createDataFrame([(n,) for n in [*x, None, x[0]]], "name string") for x in (unknown, known))).collect()
    assert {r.name: (r.match, r.ratio) for r in got} == want
    assert len(got) == len(want)
    assert [want[n][0] for n in unknown[:3]] == known[:3]
