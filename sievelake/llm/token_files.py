"""Token ids in files of directly addressable codes.

Each id is split into chunks of 8 bits, least significant first. Level k holds the k-th
chunks of all ids that have one; a bitmap beside it tells which ids go on to level k + 1,
and a rank directory counts the ones before each block of 512 bits. The position of an
id's next chunk is the rank of its bit, so any token is read with one rank per level and
nothing before it is decoded.

Documents are range-partitioned by doc_id, so that a shard is one range and its tokens lie
in ascending order. A shard is written as segments of a bounded number of tokens (a single
longer document makes a longer segment); each row of the written table holds one segment's
bytes, uncompressed. A directory beside them names each segment's first token in the whole
corpus and its documents, so that a token or a document is found by its number and only its
segment is read. Spark's committed writer stores both, so any shared file system will do
and a task that is lost is simply run again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.llm.pieces import library_encoder
from sievelake.storage import Scratch, map_texts

MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sIQQ")  # magic, levels, documents, tokens
_BLOCK = 512
SEGMENT_TOKENS = 1 << 20


def pack_segment(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """One segment: header, documents' ids and ends, then per level its size, chunks, bitmap and rank directory."""
    ids = np.concatenate(documents).astype(np.uint32) if documents else np.empty(0, np.uint32)
    ends = np.cumsum([len(d) for d in documents], dtype=np.int64)
    levels, rest = [], ids
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8)
        rest = rest[more] >> 8
        if not len(rest):
            levels.append((chunks, b"", b""))
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (_BLOCK // 8), np.uint8)))
        ones = np.bitwise_count(bits.reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.int64)
        levels.append((chunks, bits.tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()))
    known = np.array([i is not None for i in doc_ids], np.uint8)
    names = np.array([i or 0 for i in doc_ids], "<i8")
    out = [_HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)), names.tobytes(), known.tobytes(), ends.astype("<i8").tobytes()]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<QQ", len(chunks), len(bits)), chunks.tobytes(), bits, ranks]
    return b"".join(out)


class Segment:
    """Reads tokens of a packed segment by number, by document or all."""

    def __init__(self, data: bytes):
        magic, levels, docs, self.tokens = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = _HEAD.size
        names = np.frombuffer(data, "<i8", docs, at)
        known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [n if k else None for n, k in zip(names.tolist(), known.tolist(), strict=True)]
        self.ends = np.frombuffer(data, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        self.levels = []
        for _ in range(levels):
            n, width = struct.unpack_from("<QQ", data, at)
            at += 16
            chunks, bits = np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, width, at + n)
            ranks = np.frombuffer(data, "<u8", width * 8 // _BLOCK, at + n + width)
            self.levels.append((chunks, bits, ranks))
            at += n + width + 8 * len(ranks)

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // _BLOCK
        if block == len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[-_BLOCK // 8 :]).sum()) if block else 0
        whole = i // 8
        ones = int(np.bitwise_count(bits[block * _BLOCK // 8 : whole]).sum())
        return int(ranks[block]) + ones + int(bits[whole] & ((1 << i % 8) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The i-th id, by one rank per level."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not len(bits) or not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def slice(self, first: int, stop: int) -> np.ndarray:
        """Ids first to stop - 1; their further chunks lie together on each level."""
        out = np.zeros(max(0, stop - first), np.uint32)
        going, shift = np.arange(len(out)), 0
        for chunks, bits, ranks in self.levels:
            out[going] |= chunks[first:stop].astype(np.uint32) << shift
            if not len(bits) or not len(going):
                break
            more = np.unpackbits(bits[first // 8 : stop // 8 + 1], bitorder="little")[first % 8 : first % 8 + stop - first].astype(bool)
            going = going[more]
            first = self._rank(bits, ranks, first)
            stop, shift = first + len(going), shift + 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_token_files(docs: DataFrame, target: str, path: str, pattern: str, end_id: int, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode the whole texts of docs (doc_id, text; other columns are ignored), end each with end_id, and write segments and their directory under target.

    Ids are those of the tokenizers library as it is loaded, without added ones. Tokens lie
    in ascending doc_id (null first; rows with one doc_id in the order of their texts'
    hashes). A null text counts as empty: its end id alone. A text of any length is encoded
    whole and lies in one segment. Repeated rows are written once each. An empty table
    writes no segment. The tokenizer's file must lie at the same path on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path, pattern)
        shard, seq, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        count = 0

        def segment() -> pa.RecordBatch:
            known = [n for n in names if n is not None]
            columns = [[shard], [seq], [before], [count], [min(known, default=None)], [max(known, default=None)], [pack_segment(names, held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_SEGMENT)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                names.append(name)
                held.append(np.append(ids, np.uint32(end_id)))
                count += len(ids) + 1
                if count >= segment_tokens:
                    yield segment()
                    names, held, seq, before, count = [], [], seq + 1, before + count, 0
        if names:
            yield segment()

    types = [*[pa.int64()] * 6, pa.binary()]
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    segments = map_texts(ordered, run, ", ".join(f"{c} long" for c in _SEGMENT[:-1]) + ", data binary", keeps=True)
    # Codes are compact already; uncompressed, without a dictionary, a segment's bytes lie in the file as they are.
    segments.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{target}/segments")
    _located(docs.sparkSession, target).drop("data").write.parquet(f"{target}/directory")


_SEGMENT = ["shard", "seq", "first", "n_tokens", "least_doc", "most_doc", "data"]


def _located(spark: SparkSession, source: str) -> DataFrame:
    """The segments, their first token's number counted over all shards."""
    segments = spark.read.parquet(f"{source}/segments")
    # One row per range partition, so its size is bounded by the partition count of the write.
    sizes = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.join(F.broadcast(sizes.select("shard", before.alias("base"))), "shard").withColumn("first", F.col("base") + F.col("first")).select(*_SEGMENT)


def read_token_files(spark: SparkSession, source: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files; with_ids adds ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(data.as_py())
                crcs, all_ids = [], []
                ids = segment.slice(0, segment.tokens).astype("<u4", copy=False)
                begins = np.concatenate(([0], segment.ends[:-1])) if len(segment.ends) else segment.ends
                for begin, end in zip(begins.tolist(), segment.ends.tolist(), strict=True):
                    crcs.append(zlib.crc32(ids[begin:end]))
                    if with_ids:
                        all_ids.append(ids[begin:end].astype(np.int32))
                starts, sizes = begins + first, segment.ends - begins
                columns = [pa.array(c, pa.int64()) for c in (segment.doc_ids, starts, sizes, crcs)]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [column.split()[0] for column in schema.split(", ")]
    return map_texts(_located(spark, source).select("first", "data"), run, schema)


def _segments_with(spark: SparkSession, source: str, wanted: Column) -> DataFrame:
    """first and data of the segments that the directory finds; their names are pushed to the scan, which skips all others."""
    found = spark.read.parquet(f"{source}/directory").where(wanted).select("shard", "seq", "first").collect()  # those of a few lookups
    named = reduce(or_, ((F.col("shard") == r.shard) & (F.col("seq") == r.seq) for r in found), F.lit(False))
    first = F.coalesce(*(F.when((F.col("shard") == r.shard) & (F.col("seq") == r.seq), r.first) for r in found), F.lit(0)).cast("long")
    return spark.read.parquet(f"{source}/segments").where(named).select(first.alias("first"), "data")


def tokens_at(spark: SparkSession, source: str, positions: list[int]) -> DataFrame:
    """(position, token) of single ids by their number in the whole corpus, each by one rank per level; numbers beyond it have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(data.as_py())
                here = [p for p in positions if first <= p < first + segment.tokens]
                tokens = [segment.token(p - first) for p in here]
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(tokens, pa.int64())], names=["position", "token"])

    inside = (((F.col("first") <= p) & (F.lit(p) < F.col("first") + F.col("n_tokens"))) for p in positions)
    return map_texts(_segments_with(spark, source, reduce(or_, inside, F.lit(False))), run, "position long, token long")


def documents_at(spark: SparkSession, source: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of documents by their id, decoded alone; an id that is not there has no row, a repeated one several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = set(doc_ids)
        for batch in batches:
            for data in batch.column(1):
                segment = Segment(data.as_py())
                here = [k for k, name in enumerate(segment.doc_ids) if name in asked]
                ids = [segment.document(k).astype(np.int32) for k in here]
                yield pa.RecordBatch.from_arrays([pa.array([segment.doc_ids[k] for k in here], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    inside = (F.lit(d).between(F.col("least_doc"), F.col("most_doc")) for d in doc_ids)
    return map_texts(_segments_with(spark, source, reduce(or_, inside, F.lit(False))), run, "doc_id long, ids array<int>")


def token_table(docs: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """Write docs to token files in the shared folder and read them back."""
    spark = docs.sparkSession
    target = Scratch(spark, "token-files").path("tokens")
    write_token_files(docs, target, path, pattern, end_id)
    return read_token_files(spark, target)
