"""Exact top-k by inner product: tiled matrix products and a tree of merges.

Candidates are dealt into shards of bounded size, each row into one. The queries, the
smaller side, go to every shard and stream past it in strips; a strip's scores with the
shard are one matrix product, of which each query keeps its best k. Lists of up to eight
shards are merged at a time until one is left per query. No task ever holds more than a
shard and a strip, and what leaves a shard is k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.storage import map_texts

#: Candidates of a shard (at least, and at most where there are enough for all cores), queries scored at a time, and lists merged at a time.
LEAST_SHARD, MOST_SHARD, STRIP, FAN_IN = 8192, 65_536, 64, 8


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double; null unless all components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(rows: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of the vectors, shorter ones padded with zeros, cut to a width where one is given."""
    sizes = np.diff(rows.offsets.to_numpy())
    own = int(sizes.max(initial=0))
    out = np.zeros((len(rows), own), np.int64)
    out[np.arange(own) < sizes[:, None]] = rows.flatten().to_numpy()
    if width is None or own == width:
        return out
    return out[:, :width] if own > width else np.pad(out, ((0, 0), (0, width - own)))


class _Shard:
    """The candidates that the queries are compared with, in ascending order of their ids, so that ties go to the smaller."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks().sort_by("id")
        self.ids, self.own = (table.column(c).to_numpy() for c in ("id", "own"))
        self.exact = _matrix(table.column("vector").combine_chunks())
        self.floats = self.exact.astype(np.float64).T
        self.top = int(np.abs(self.exact).max(initial=0))

    def _products(self, q: np.ndarray) -> np.ndarray:
        """Exact inner products; floating point only where no sum can leave the integers it represents."""
        if int(np.abs(q).max(initial=0)) * self.top * q.shape[1] < 2**53:
            return np.rint(q.astype(np.float64) @ self.floats).astype(np.int64)
        return np.clip(q.astype(object) @ self.exact.astype(object).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)

    def best(self, q: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, row of the shard, score) of each query's best k; a query's own row does not count."""
        found = []
        lowest = np.iinfo(np.int64).min
        for at in range(0, len(q), STRIP):
            strip = slice(at, at + STRIP)
            scores = self._products(q[strip])
            scores[(ids[strip, None] == self.ids) & (own[strip, None] == self.own)] = lowest
            kth = np.partition(scores, -k, axis=1)[:, -k, None] if k < scores.shape[1] else np.full((len(scores), 1), lowest)
            above, tied = scores > kth, (scores == kth) & (scores > lowest)
            room = k - above.sum(axis=1, keepdims=True)
            rows, cols = np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= room)))
            found.append((rows + at, cols, scores[rows, cols]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(shard, whether these are queries, rows) of the parts of each batch that belong together."""
    for batch in batches:
        shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(shard[a]), bool(asks[a]), batch.slice(a, b - a)


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank (int from 1), vec_id, score: each query row's k candidate rows with the largest inner products.

    queries (query_id, vector) and candidates (vec_id, vector) have vectors of longs.
    Ties go to the smaller vec_id. The query's own row does not count: of the candidates
    with the query's id and vector, one; further rows of its id do. A query with fewer
    candidates gets them all, with none no row. Rows whose id or vector is null take no
    part. Repeated candidates each take a place, and repeated query rows each get their
    list. Vectors of different lengths, of any length that fits a worker, are compared as
    if padded with zeros; scores beyond a long are cut to it. Other columns are ignored.
    """
    q = queries.where("query_id is not null and vector is not null").groupBy("query_id", "vector").agg(F.count(F.lit(1)).alias("times"))
    # Of equal rows no more than k, and the query's own one, can matter to a list; a row's hash and its copy's number decide its shard, on any attempt.
    c = candidates.where("vec_id is not null and vector is not null")
    n_c = max(1, c.count())
    share = n_c // (4 * queries.sparkSession.sparkContext.defaultParallelism)
    shards = math.ceil(n_c / max(LEAST_SHARD, min(MOST_SHARD, share)))
    c = c.groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("n"))
    c = c.select("vec_id", "vector", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int"))).alias("copy"))
    c = c.withColumn("own", F.xxhash64("vec_id", "vector", "copy"))
    q = q.withColumn("own", F.xxhash64("query_id", "vector", F.lit(1)))
    sides = [
        c.select(F.pmod("own", F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "own", "vector", F.lit(0).cast("long").alias("times")),
        q.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True), "query_id", "own", "vector", "times"),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = -1, [], None
        for number, asks, rows in _runs(batches):
            if number != at:
                at, held, shard = number, [], None
            if not asks:
                held.append(rows.select(["id", "own", "vector"]))
                continue
            if shard is None and held:
                shard, held = _Shard(held), []
            if shard is None:  # no candidate was dealt here
                continue
            ids, own, times = (rows.column(c).to_numpy() for c in ("id", "own", "times"))
            asking, place, scores = shard.best(_matrix(rows.column("vector"), shard.exact.shape[1]), ids, own, k)
            columns = [ids[asking], own[asking], times[asking], np.full(len(asking), at), shard.ids[place], scores]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "key", "times", "part", "vec_id", "score"])

    dealt = sides[0].union(sides[1]).repartition("shard").sortWithinPartitions("shard", "asks")
    lists = map_texts(dealt, run, "query_id long, key long, times long, part long, vec_id long, score long")

    def merge(df: DataFrame, *more: str) -> DataFrame:
        best = Window.partitionBy("query_id", "key", *more).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    levels = max(0, math.ceil(math.log(shards, FAN_IN)) - 1)
    lists = reduce(lambda df, _: merge(df.withColumn("part", F.floor(F.col("part") / FAN_IN)), "part"), range(levels), lists)
    each = merge(lists).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_table(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Top k of embeddings (vec_id, embedding) for the rows whose vec_id is divisible by every, after scaling to integers."""
    vectors = embeddings.select("vec_id", scaled(F.col("embedding")).alias("vector"))
    queries = vectors.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return exact_top_k(queries, vectors, k)
