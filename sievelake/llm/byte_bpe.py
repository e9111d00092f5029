"""Byte-level BPE by padded numpy matrices, encoding and decoding.

Distinct pieces of a chunk of texts become rows of byte ids, bucketed by length and padded.
In each round every row merges its leftmost pair of least rank, the matrix loses a column,
and rows without a mergeable pair leave it. Ranks of pairs come from an open-addressing
hash table that is probed for whole matrices at once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievelake.llm.pieces import PieceCache
from sievelake.storage import map_texts, worker_memory

_NONE = np.int32(2**31 - 1)
#: Cells of one padded matrix, and the longest row in one; longer pieces are merged by a heap.
CELLS, LONGEST_ROW = 1 << 20, 1024


class PairTable:
    """(left id, right id) -> rank of the merged token, by linear probing."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        slots, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] == -1
            _, first = np.unique(slots[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left.astype(np.int64) << 32) | right).ravel()
        slots = self._home(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slots[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class ByteTable:
    """Byte strings by index; gathers the concatenation for an array of indexes."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def gather(self, index: np.ndarray) -> bytes:
        out = []
        for k in range(0, len(index), 1 << 18):
            part = index[k : k + (1 << 18)]
            size = self.size[part]
            ends = np.cumsum(size, dtype=np.int32)
            at = np.repeat(self.start[part] - (ends - size), size) + np.arange(ends[-1], dtype=np.int32)
            out.append(self.flat[at].tobytes())
        return b"".join(out)


class ByteBPE:
    """Encoder and decoder for tiktoken-style ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        top = max(ranks.values()) + 1
        self.pad = np.int32(top)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    merged.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(merged, np.int32))
        strings = [b""] * top
        for token, rank in ranks.items():
            strings[rank] = token
        self.tokens = ByteTable(strings)
        self.decimals = ByteTable([b"%d " % i for i in range(top)])
        self.cache = PieceCache(pattern, self._encode_pieces)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return self.cache.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.gather(ids)

    def id_text(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by one space."""
        return self.decimals.gather(ids)[:-1]

    def _encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        raw = [piece.encode() for piece in pieces]
        found: list[np.ndarray | None] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, data in enumerate(raw):
            whole = self.ranks.get(data)
            if whole is not None:
                found[i] = np.array([whole], np.int32)
            elif len(data) > LONGEST_ROW:
                found[i] = self._merge_long(data)
            else:
                buckets.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_rows([raw[i] for i in part], width), strict=True):
                    found[i] = ids
        return found  # type: ignore[return-value]

    def _merge_rows(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        size = np.array([len(r) for r in rows])
        ids = np.full((len(rows), width), self.pad, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        owner = np.arange(len(rows))
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        while len(owner):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(owner)), at]
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[owner[i]] = ids[i, : size[owner[i]]]
                keep = ~done
                ids, rank, owner, at, best = ids[keep], rank[keep], owner[keep], at[keep], best[keep]
                if not len(owner):
                    break
            each = np.arange(len(owner))
            ids[each, at] = best
            size[owner] -= 1
            rest = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, rest + (rest > at[:, None]), axis=1)
            if ids.shape[1] == 1:
                for i, own in enumerate(owner):
                    out[own] = ids[i, :1]
                break
            rest = rest[:-1]
            rank = np.take_along_axis(rank, rest + (rest >= at[:, None]), axis=1)
            before = at > 0
            rank[each[before], at[before] - 1] = self.pairs.find(ids[each[before], at[before] - 1], ids[each[before], at[before]])
            after = at < rank.shape[1]
            rank[each[after], at[after]] = self.pairs.find(ids[each[after], at[after]], ids[each[after], at[after] + 1])
        return out

    def _merge_long(self, data: bytes) -> np.ndarray:
        """The same rule for one long piece: a heap of (rank, position) over a linked list."""
        ids = self.byte_ids[np.frombuffer(data, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        ids, nxt, prev = ids.tolist(), list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        known = {}

        def rank_of(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs.find(np.array([a]), np.array([b]))[0])
            return known[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        end = len(data)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else end
            if j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            nxt[i] = k = nxt[j]
            if k < end:
                prev[k] = i
                if (r := rank_of(rank, ids[k])) != _NONE:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := prev[i]) >= 0 and (r := rank_of(ids[h], rank)) != _NONE:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int32)


def load_ranks(path: str, pattern: str) -> ByteBPE:
    """The worker's encoder for a file of base64 tokens and ranks, kept from task to task."""

    def load() -> ByteBPE:
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        return ByteBPE({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)

    return worker_memory(f"ranks of {path}", load)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token counts and digests of each row of docs (doc_id, text; other columns are ignored), one row per row.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 (of the bytes that the ids decode to); with_ids adds ids array<int>.
    A null text counts as empty; an empty text has no ids. There is no shuffle. The
    tokenizer's file must lie at the same path on each executor, as an installed
    package's files do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_ranks(path, pattern)
        for batch in batches:
            counts, shas, back, all_ids = [], [], [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                counts.append(len(ids))
                shas.append(hashlib.sha256(bpe.id_text(ids)).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [column.split()[0] for column in schema.split(", ")]
    return map_texts(docs.select("doc_id", "text"), run, schema, keeps=True)
