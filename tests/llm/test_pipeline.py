import corpus_pipeline
from sievelake.llm.line_dedup import line_key
from sievelake.llm.pii import MENTION
from sievelake.storage import table
from tests.conftest import SMALL
from tests.llm.test_documents import _components


def _by_hand(spark):
    """The pipeline with brute force where there is one: lines and near-duplicates."""
    docs = corpus_pipeline.toxicity(spark, table(spark, SMALL, "documents"), SMALL)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    held = {}
    for doc, text in rows.items():
        for key in {line_key(line.encode()) for line in text.split("\n")}:
            held.setdefault(key, set()).add(doc)
    gone = {k for k, d in held.items() if k and len(d) >= 10}
    rows = {d: "\n".join(line for line in t.split("\n") if line_key(line.encode()) not in gone) for d, t in rows.items()}
    kept = {c for _, _, c in _components(list(rows.items()), 5, 80)}
    return {d: t for d, t in rows.items() if d in kept}


def test_stages_and_run(spark):
    docs = table(spark, SMALL, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "pii", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at.count(), stage(spark, at, SMALL)
        assert at.columns == docs.columns, name
        assert at.schema.simpleString() == docs.schema.simpleString()
        assert at.count() <= before
        if name == "near-duplicates":
            assert {r.doc_id: r.text for r in at.collect()} == _by_hand(spark)
    assert at.where("n_chars <> length(text)").count() == 0
    whole = {tuple(r)[:5] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert whole == {tuple(r)[:5] for r in corpus_pipeline.packing(spark, at, SMALL).collect()}
    assert {r[0] for r in whole} == {r.doc_id for r in at.select("doc_id").collect()}
    assert MENTION
