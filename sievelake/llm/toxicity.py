"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Two models, one of documents labelled toxic and one of the others, give each word a
probability after the word before it. With token counts N and types T (distinct followers),
the probability of w after u in class c backs off in three steps:

    P_c(w | u) = (N_c(u,w) - D_c)+ / N_c(u) + D_c T_c(u) / N_c(u) * B_c(w | u)     (B_c where c has not seen u)
    B_c(w | u) = (N(u,w) - D)+ / N(u) + D T(u) / N(u) * Q_c(w)                      both classes' counts; Q_c where u is new
    Q_c(w) = (1 - e) ((C_c(w) - d)+ + d K(w) pi_c) / C_c + e / (V + 1)

C_c(w) counts the contexts of w in the class. What the last step takes off a word in its
K(w) classes goes into one pot per word, from which each class draws its share pi_c of all
types: a word seen once says little about either class, and one that neither knows says
nothing. Each discount is n1 / (n1 + 2 n2) of the counts that it is taken from.

A document is compared by length-normalised log-likelihoods, toxic minus ordinary, per word:
of the whole text and of its passages of a few words where the difference is largest, since
a few words can make a long text toxic; under the whole model, and under Q alone. A logistic
curve, fitted to labelled documents that the counts have not seen, turns these into a score.

Training reads a bounded sample of labelled rows (TRAIN_ROWS), whose size bounds the model:
it keeps the counts of all words and pairs of the sample. Scoring is one pass over all texts
without a shuffle; the model goes to each worker once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from sievelake.llm.shingles import mix
from sievelake.storage import Scratch, map_texts

#: Labelled rows that training reads at most: those with the smallest hashes of their doc_id.
TRAIN_ROWS = 20_000
#: One training row in so many fits the curve instead of the counts.
CURVE_EVERY = 4
#: Lengths, in words, of the passages that are compared beside the whole text: under the model of pairs, and under its last step.
PAIR_PASSAGES, WORD_PASSAGES = (8,), (1, 2, 8, 32)
#: Words that are looked up together, which bounds a worker's memory beside the model; a longer text is still one.
WORDS_AT_ONCE = 100_000
#: The model's tables come to the driver in parts by so many leading bits of their keys.
PART_BITS = 2
FEATURES = 2 + len(PAIR_PASSAGES) + len(WORD_PASSAGES)

_WORD = re.compile(r"\w+")
_START = np.uint64(1)


def _hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _before(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate(([_START], hashes[:-1])) if len(hashes) else hashes


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before + np.uint64(0x9E3779B97F4A7C15)) ^ word


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) of positive counts, kept inside (0, 1) where there are none of them."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return (once + 0.5) / (once + 2 * twice + 1)


class HashTable:
    """Rows of counts by 64-bit keys: sorted keys with a directory of their leading bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        """keys ascend; a last row of zeros, for all keys that are not there, ends rows."""
        self.keys, self.rows = keys, rows

    @cached_property
    def _directory(self) -> tuple[np.uint64, np.ndarray]:
        bits = max(1, len(self.keys).bit_length())
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.uint64(64 - bits), np.append(np.searchsorted(self.keys, edges), len(self.keys)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "rows": self.rows}

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each key."""
        shift, first = self._directory
        cell = (wanted >> shift).astype(np.int64)
        at, stop = first[cell], first[cell + 1]
        out = np.full(len(wanted), len(self.keys), np.int32)
        going = np.flatnonzero(at < stop)
        while len(going):
            here = at[going]
            hit = self.keys[here] == wanted[going]
            out[going[hit]] = here[hit]
            at[going] += 1
            going = going[~hit & (here + 1 < stop[going])]
        return self.rows[out]


def _kept(counts: np.ndarray, discounts: float | np.ndarray) -> np.ndarray:
    return np.maximum(counts - discounts, 0.0)


@dataclass(frozen=True)
class KneserNey:
    """Counts (ordinary, toxic) of pairs, contexts and words by hash, and the discounts."""

    pairs: HashTable  # N_c(u,w)
    words: HashTable  # N_c(u), T_c(u), T(u), C_c(w)
    pair_discounts: np.ndarray
    pooled_discount: float
    word_discount: float
    contexts: np.ndarray  # C_c
    types: np.ndarray  # distinct words of each class
    vocabulary: int
    unknown: float  # e

    @classmethod
    def of_counts(cls, keys: np.ndarray, pairs: np.ndarray, names: np.ndarray, words: np.ndarray) -> KneserNey:
        """From the tables of keys and counts (2 each) of distinct pairs, and of hashes and counts (7 each) of distinct words and contexts."""
        of_word = words[:-1, 5:]
        known = of_word.sum(axis=1) > 0
        both = of_word[known].sum(axis=1)
        return cls(
            HashTable(keys, pairs), HashTable(names, words),
            np.array([discount(pairs[:, c]) for c in (0, 1)]), discount(pairs.sum(axis=1)), discount(of_word.ravel()),  # the row of zeros counts for none
            of_word.sum(axis=0, dtype=np.float64), (of_word > 0).sum(axis=0).astype(np.float64), int(known.sum()), (int((both == 1).sum()) + 1) / (int(both.sum()) + 2),
        )

    def _last_step(self, of_word: np.ndarray) -> np.ndarray:
        """Q_c(w) of each word, a column per class."""
        share = self.types / self.types.sum()
        pot = self.word_discount * (of_word > 0).sum(axis=1, keepdims=True) * share
        return (1 - self.unknown) * (_kept(of_word, self.word_discount) + pot) / self.contexts + self.unknown / (self.vocabulary + 1)

    def log_ratios(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(w | u, toxic) - log P(w | u, ordinary) of word hashes after others, by the whole model and by its last step."""
        n_pair, of_context = self.pairs.find(_pair_keys(before, word)), self.words.find(before)
        n, t, t_both = of_context[:, :2], of_context[:, 2:4], of_context[:, 4:5]
        low = self._last_step(self.words.find(word)[:, 5:])
        all_n = n.sum(axis=1, keepdims=True)
        shared = (_kept(n_pair.sum(axis=1, keepdims=True), self.pooled_discount) + self.pooled_discount * t_both * low) / np.maximum(all_n, 1)
        shared = np.where(all_n > 0, shared, low)
        high = (_kept(n_pair, self.pair_discounts) + self.pair_discounts * t * shared) / np.maximum(n, 1)
        high = np.where(n > 0, high, shared)
        return tuple(np.log(p[:, 1] / p[:, 0]) for p in (high, low))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: differences of log-likelihoods per word of the whole and of passages; zeros without words."""
        out, held, words = [], [], 0
        for i, text in enumerate(texts):
            held.append(_hashes(text))
            words += len(held[-1])
            if words >= WORDS_AT_ONCE or i + 1 == len(texts):
                out.append(self._features_of(held))
                held, words = [], 0
        return np.concatenate(out) if out else np.zeros((0, FEATURES))

    def _features_of(self, hashes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(hashes), FEATURES))
        if not any(map(len, hashes)):
            return out
        by_pair, by_word = self.log_ratios(np.concatenate([_before(h) for h in hashes]), np.concatenate(hashes))
        stops = np.cumsum([len(h) for h in hashes])
        for row, stop, size in zip(out, stops.tolist(), map(len, hashes), strict=True):
            if size:
                row[:] = [*_compared(by_pair[stop - size : stop], PAIR_PASSAGES), *_compared(by_word[stop - size : stop], WORD_PASSAGES)]
        return out


@dataclass(frozen=True)
class ToxicityModel:
    """The counts, which go to each worker once, and the curve from features to a score; without counts the score is the same for all."""

    counts: Broadcast | None
    curve: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = self.counts.value.features(texts) if self.counts else np.zeros((len(texts), FEATURES))
        return 1.0 / (1.0 + np.exp(-np.clip(self.curve[0] + found @ self.curve[1:], -500, 500)))


def _compared(ratios: np.ndarray, passages: tuple[int, ...]) -> list[float]:
    """The mean ratio, and the largest mean of each passage length."""
    sums = np.concatenate(([0.0], np.cumsum(ratios)))
    widths = (min(width, len(ratios)) for width in passages)
    return [sums[-1] / len(ratios), *((sums[w:] - sums[:-w]).max() / w for w in widths)]


def is_held_out(doc_id: Column) -> Column:
    """Rows whose label must not be learnt from: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic, curve of a bounded sample of labelled documents; of contradictory labels the toxic one counts."""
    known = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    sample = known.orderBy("h", "doc_id").limit(most)
    curve = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(CURVE_EVERY)) == 0
    sample = F.broadcast(sample.select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).alias("toxic"), curve.alias("curve")))  # at most `most` rows
    return docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("__id")).select("text", "toxic", "curve")


def _pair_rows(rows: DataFrame) -> DataFrame:
    """(key, before, word, ordinary, toxic): how often each class has a pair of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hashes(t) for t in batch.column(0).to_pylist()]
            toxic = np.repeat(np.array(batch.column(1).to_pylist(), bool), [len(h) for h in hashes])
            both = np.stack((np.concatenate([_before(h) for h in hashes]), np.concatenate(hashes))).astype(np.uint64)
            found, place = np.unique(both, axis=1, return_inverse=True)
            counts = [np.bincount(place.ravel()[mask], minlength=found.shape[1]) for mask in (~toxic, toxic)]
            found = np.ascontiguousarray(found)
            columns = [*(x.view(np.int64) for x in (_pair_keys(*found), *found)), *counts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    names = ["key", "before", "word", "ordinary", "toxic"]
    counted = map_texts(rows.where(~F.col("curve")).select("text", "toxic"), run, ", ".join(f"{n} long" for n in names))
    return counted.groupBy("key", "before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _word_rows(pairs: DataFrame) -> DataFrame:
    """name and, in both roles, the counts of a word hash: N_c(u), T_c(u), T(u) as a context and C_c(w) as a word."""
    classes, count = ("ordinary", "toxic"), F.count(F.lit(1))
    seen = [F.sum((F.col(c) > 0).cast("long")) for c in classes]
    contexts = pairs.groupBy(F.col("before").alias("name")).agg(*(F.sum(c).alias(f"n{i}") for i, c in enumerate(classes)), *(x.alias(f"t{i}") for i, x in enumerate(seen)), count.alias("t"))
    words = pairs.groupBy(F.col("word").alias("name")).agg(*(x.alias(f"c{i}") for i, x in enumerate(seen)))
    return contexts.join(words, "name", "full").na.fill(0)


def _fit_curve(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method, in the features' own units."""
    order = np.lexsort((labels, *features.T))  # sums are the same whatever order the rows came in
    features, labels = features[order], labels[order]
    centre, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack((np.ones(len(features)), (features - centre) / spread))
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1.0] * features.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(hessian, x.T @ (labels - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / spread
    return np.concatenate(([beta[0] - slopes @ centre], slopes))


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys (first column) and counts (the others, and a row of zeros) of a table that the sample bounds, fetched in parts to keep the driver small."""
    key, *counts = df.columns
    narrow = df.select(key, *(F.col(c).cast("int") for c in counts))
    total, at = narrow.count(), 0
    keys, rows = np.empty(total, np.uint64), np.zeros((total + 1, len(counts)), np.int32)
    for i in range(1 << PART_BITS):  # by the leading bits, so that the parts follow each other in order
        part = narrow.where(F.shiftrightunsigned(F.col(key), 64 - PART_BITS) == i).toArrow()
        found = part.column(0).to_numpy().view(np.uint64)
        order = np.argsort(found)
        keys[at : at + len(found)] = found[order]
        for c, column in enumerate(part.columns[1:]):
            rows[at : at + len(found), c] = column.to_numpy()[order]
        at += len(found)
    return keys, rows


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> ToxicityModel:
    """Models and curve from labels (doc_id, toxic) of docs (doc_id, text). With one class only, every score is 0 or 1 accordingly."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = scratch.save(_training_rows(docs, labels, most), "training")
    seen = {bool(r.toxic): r["count"] for r in rows.where(~F.col("curve")).groupBy("toxic").count().collect()}
    if len(seen) < 2:
        scratch.drop("training")
        return ToxicityModel(None, np.array([500.0 if True in seen else -500.0] + [0.0] * FEATURES))
    pairs = scratch.save(_pair_rows(rows), "pairs")
    words = scratch.save(_word_rows(pairs), "words")
    shared = spark.sparkContext.broadcast(KneserNey.of_counts(*_collected(pairs.select("key", "ordinary", "toxic")), *_collected(words)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found.T), batch.column(1)], names=[*names, "toxic"])

    names = [f"f{i}" for i in range(FEATURES)]
    seen = map_texts(rows.where("curve").select("text", "toxic"), features, ", ".join(f"{n} double" for n in names) + ", toxic boolean").toArrow()
    curve = np.zeros(1 + FEATURES)
    if seen.num_rows:
        curve = _fit_curve(np.column_stack([seen.column(n).to_numpy() for n in names]), seen.column("toxic").to_numpy().astype(float))
    scratch.drop("training", "pairs", "words")
    return ToxicityModel(shared, curve)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (text, any others) with score and predicted beside each row.

    score is from 0 to 1, higher for likelier toxic; predicted is 1 from 0.5 on. Texts of any
    length are read whole. Texts that are null, empty or wordless have a ratio of 0 and the
    curve's score for it. Equal texts have equal scores, and a repeated row comes back as
    often as it went in. Columns named score or predicted in docs are replaced. An empty
    table stays empty.
    """
    rest = docs.drop("score", "predicted")
    at = rest.columns.index("text")
    names = [*rest.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(at).to_pylist())
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(rest, run, T.StructType([*rest.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
