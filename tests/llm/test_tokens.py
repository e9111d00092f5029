import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievelake.llm import queries
from sievelake.llm.byte_bpe import encode_and_decode, load_ranks
from sievelake.llm.packing import Placement, cut, pack_documents, plan_bins, sequences
from sievelake.llm.token_files import Segment, documents_at, pack_segment, read_token_files, token_table, tokens_at, write_token_files
from tests.conftest import EDGE_TEXTS, SMALL


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference_bpe():
    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_strings_of_added_tokens(library):
    """As the library is loaded, the string of its end token in a text is that token."""
    from sievelake.llm.pieces import LibraryEncoder

    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|", None, "", "日本 <|endoftext|>", "<|endoftext|><|endoftext|> x"]
    assert [ids.tolist() for ids in LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN).encode(texts)] == [library(t) for t in texts]
    assert 50256 in library(texts[0])


def test_matrix_merges_equal_tiktoken(reference_bpe):
    bpe = load_ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    texts = EDGE_TEXTS + ["".join(rng.choice("etaoin shrdlu é!\n0") for _ in range(rng.randint(0, 400))) for _ in range(100)]
    texts += ["".join(rng.choice("etaoin") for _ in range(n)) for n in (1023, 1024, 1025, 4000)]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids.tolist() == reference_bpe.encode_ordinary(text or "")
        assert bpe.decode(ids) == (text or "").encode()


def test_op9_rows(spark, edge_docs, reference_bpe):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), edge_docs, edge_docs.limit(0)):
        want = []
        for row in docs.collect():
            ids = reference_bpe.encode_ordinary(row.text or "")
            shown = " ".join(map(str, ids))
            want.append((row.doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
        got = [tuple(r) for r in encode_and_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_op2_rows(spark, edge_docs, library):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), edge_docs, edge_docs.limit(0)):
        got = token_table(docs, P.path("byte_bpe_50k.json"), P.PATTERN, end_id=2).orderBy("start").collect()
        left = sorted(((r.doc_id, len(ids := [*library(r.text), 2]), _crc(ids)) for r in docs.collect()), key=str)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == left
        assert [r.doc_id or -1 for r in got] == sorted(r.doc_id if r.doc_id is not None else -1 for r in got) or any(r.doc_id == 0 for r in got)
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_segments_give_any_token():
    rng = np.random.default_rng(1)
    for top in (200, 60_000, 5_000_000):
        docs = [rng.integers(0, top, n).astype(np.uint32) for n in (0, 1, 511, 512, 513, 3000)]
        segment = Segment(pack_segment([None, 5, 6, 7, 8, 9], docs))
        ids = np.concatenate(docs)
        assert segment.doc_ids == [None, 5, 6, 7, 8, 9]
        assert [segment.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
        assert all((segment.document(k) == d).all() for k, d in enumerate(docs))
        assert (segment.slice(510, 1030) == ids[510:1030]).all()
        with pytest.raises(IndexError):
            segment.token(len(ids))
    assert Segment(pack_segment([], [])).tokens == 0


def test_many_segments_and_shards(spark, tmp_path, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    write_token_files(docs, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"), P.PATTERN, 2, segment_tokens=5000)
    got = read_token_files(spark, f"file://{tmp_path}/t", with_ids=True).orderBy("doc_id").collect()
    at = 0
    for row, doc in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        assert (row.doc_id, row.start, row.ids) == (doc.doc_id, at, [*library(doc.text), 2])
        at += row.n_tokens
    directory = spark.read.parquet(f"file://{tmp_path}/t/directory").orderBy("first").collect()
    assert len(directory) > 5
    assert [r.first for r in directory] == [sum(x.n_tokens for x in directory[:i]) for i in range(len(directory))]
    flat = [i for row in got for i in row.ids]
    asked = [0, 1, 4999, 5000, 12_345, at - 1, at, -1]
    assert {r.position: r.token for r in tokens_at(spark, f"file://{tmp_path}/t", asked).collect()} == {p: flat[p] for p in asked[:-2]}
    some = {got[0].doc_id, got[57].doc_id, got[-1].doc_id}
    assert {r.doc_id: r.ids for r in documents_at(spark, f"file://{tmp_path}/t", [*some, 10**12]).collect()} == {r.doc_id: r.ids for r in got if r.doc_id in some}
    assert tokens_at(spark, f"file://{tmp_path}/t", []).count() == 0


def test_op3_rows(spark, edge_docs, library):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), edge_docs, edge_docs.limit(0)):
        got = pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, 2048, 0, with_ids=True)
        rows = got.collect()
        want = []
        for r in docs.collect():
            ids = [*library(r.text), 0]
            assert sum(n for _, n in cut(len(ids), 2048)) == len(ids)
            want += [(r.doc_id, k, s, n, _crc(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), 2048))]
        assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert sorted(bins) == list(range(len(bins)))
        assert len(bins) <= 1.03 * -(-sum(r.length for r in rows) // 2048) + 1
        assert {r.sequence_id: len(r.ids) for r in sequences(got).collect()} == {k: sum(n for _, n in v) for k, v in bins.items()}


def test_cut():
    assert cut(1, 4) == [(0, 1)]
    assert cut(4, 4) == [(0, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert cut(8, 4) == [(0, 4), (4, 4)]


def test_two_fit_replaces_the_smallest():
    counts = np.zeros(11, np.int64)
    for size in (6, 3, 2, 2):  # greedy: 6 + 3, gap 1; 3 gives way to 2 + 2
        counts[size] += 1
    assert plan_bins(counts)[0] == ([6, 2, 2], 1)
    assert Placement(np.zeros(11, np.int64)).bins == 0
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(rng.geometric(0.004, 20_000), 2048), minlength=2049)
    used = np.zeros(2049, np.int64)
    for held, times in plan_bins(counts):
        assert sum(held) <= 2048
        np.add.at(used, held, times)
    assert (used == counts).all()


def test_queries_run(spark):
    for name in ("op2_token_id_output", "op3_best_fit_packing", "op9_byte_bpe"):
        assert queries.QUERIES[name](spark, SMALL).count() >= 200
