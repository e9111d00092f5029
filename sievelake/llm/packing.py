"""Best-two-fit packing of token sequences.

The packing is planned on the histogram of piece lengths, which has at most `capacity`
entries whatever the corpus: a bin is filled greedily with the longest piece that fits;
then its smallest piece is replaced by the two unpacked pieces that fill the gap, widened
by that piece, most tightly. A filled bin is a pattern of lengths and is repeated while
its lengths last, so the plan has at most a few patterns per length. Pieces of one length
are interchangeable: a piece's rank among those of its length decides its place. Ranks come
from counts per task and length, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.pieces import library_encoder
from sievelake.storage import Scratch, map_texts


def plan_bins(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns [(lengths in a bin, how many such bins)] for counts[length] pieces; the capacity is len(counts) - 1."""
    capacity, left = len(counts) - 1, counts.astype(np.int64).copy()
    left[0] = 0
    plan = []
    while left.any():
        spare = left.copy()
        held: list[int] = []
        gap = capacity
        while gap:
            fits = np.flatnonzero(spare[1 : gap + 1])
            if not len(fits):
                break
            size = int(fits[-1]) + 1
            times = min(int(spare[size]), gap // size)
            held += [size] * times
            spare[size] -= times
            gap -= size * times
        if gap and held:
            smallest = held[-1]
            pair = _best_pair(spare, gap + smallest)
            if pair and sum(pair) > smallest:
                held[-1:] = pair
        sizes, uses = np.unique(held, return_counts=True)
        times = int((left[sizes] // uses).min())
        left[sizes] -= uses * times
        plan.append((held, times))
    return plan


def _best_pair(spare: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum within room; of equal sums the pair with the longest piece."""
    sizes = np.flatnonzero(spare[: room + 1])
    if not len(sizes):
        return None
    below = np.zeros(room + 1, np.int64)
    below[sizes] = sizes
    below = np.maximum.accumulate(below)
    partner = below[np.minimum(room - sizes, sizes)]
    lone = (partner == sizes) & (spare[sizes] < 2)
    partner[lone] = below[np.maximum(sizes[lone] - 1, 0)]
    total = np.where(partner > 0, sizes + partner, 0)
    best = len(total) - 1 - int(total[::-1].argmax())
    return (int(sizes[best]), int(partner[best])) if total[best] else None


class Placement:
    """(length, rank among the pieces of that length) -> (bin, offset), in arrays sorted by length and first rank."""

    def __init__(self, counts: np.ndarray):
        taken = np.zeros(len(counts), np.int64)
        runs: list[tuple[int, int, int, int, int]] = []
        first_bin = 0
        for held, times in plan_bins(counts):
            offset = 0
            for size in held:
                runs.append((size, int(taken[size]), first_bin, offset, times))
                taken[size] += times
                offset += size
            first_bin += times
        runs.sort()
        self.size, self.rank, self.bin, self.offset, _ = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else [[]] * 5))
        self.bins = first_bin

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = int(self.rank.max()) + 1 + int(rank.max()) if len(rank) else 1
        at = np.searchsorted(self.size * scale + self.rank, size * scale + rank, side="right") - 1
        return self.bin[at] + rank - self.rank[at], self.offset[at]


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n_tokens, capacity)]


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text; other columns are ignored) and their places in sequences.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids
    array<int>. A document's ids are those of the tokenizers library for its whole text,
    then end_id; a null text counts as empty and is packed as its end id. Documents longer
    than capacity are cut, others never. Repeated rows are packed once each. Sequences are
    gapless from offset 0, none is longer than capacity, and their numbers run from 0.
    An empty table gives no sequences.
    """
    scratch = Scratch(docs.sparkSession, "packing")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path, pattern)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            kept_ids = []
            for i, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((i, piece, start, length, zlib.crc32(part.astype("<u4").tobytes()), int(seen[length])))
                    seen[length] += 1
                    if with_ids:
                        kept_ids.append(part.astype(np.int32))
            owner, piece, start, length, crc, rank = zip(*rows, strict=True) if rows else [[]] * 6
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array([task] * len(rows), pa.int64()), pa.array(rank, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(kept_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>" if with_ids else ""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + more
    names = [column.split()[0] for column in schema.split(", ")]
    pieces = scratch.save(map_texts(docs.select("doc_id", "text"), tokenise, schema, keeps=True), "pieces")

    per_task = scratch.save(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    placement = Placement(counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rank = where["nth"].to_numpy() + where["base"].to_numpy()
            bins, offsets = placement.place(where["length"].to_numpy(), rank)
            where |= {"sequence_id": pa.array(bins, pa.int64()), "offset": pa.array(offsets, pa.int64())}
            yield pa.RecordBatch.from_arrays([where[name] for name in placed_names], names=placed_names)

    placed = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + more
    placed_names = [column.split()[0] for column in placed.split(", ")]
    # One row of base per task and length: it grows with the input, so it must not be broadcast.
    return map_texts(pieces.join(base.hint("merge"), ["task", "length"]), place, placed)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids and ids of each packed sequence, from pack_documents(with_ids=True); a sequence holds at most its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids")
    )
