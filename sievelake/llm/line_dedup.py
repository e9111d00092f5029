"""Line dedup: lines whose key occurs in many documents go, the others stay in their order.

Only hashes are counted and joined. Each document sends one row per distinct line key; the
counts are pre-aggregated before the shuffle, so a line that stands in every document costs
one row per task. The keys to drop go back to the documents that hold them: the commonest,
each a thousandth or more of all rows and so at most a thousand, by a broadcast, the others
by a shuffle on the key, in which none of them is large. A document's text is read once
more to rebuild it by line position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from sievelake.storage import Scratch, map_texts, spare_name

_BLANK = b" \t\n\x0b\x0c\r"
#: A key with one in so many of all rows is common; there are at most so many of them.
COMMON = 1000


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, with A-Z lowered."""
    return line.strip(_BLANK).lower()


def _name_of(text: str) -> Column:
    """A 128-bit name of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _exploded(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_name, key): the distinct line keys, as 128-bit names, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, keys = [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                found = {line_key(line) for line in (text or b"").split(b"\n")}
                if least_chars > 1:
                    found = {k for k in found if len(k.decode()) >= least_chars}
                elif least_chars == 1:
                    found.discard(b"")
                owner += [i] * len(found)
                keys += map(xxh3_128_digest, found)
            owners = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owners), batch.column(1).take(owners), pa.array(keys, pa.binary())], names=["doc_id", "text_name", "key"])

    return map_texts(docs.select("doc_id", _name_of("text").alias("text_name"), "text"), run, "doc_id long, text_name binary, key binary")


def drop_frequent_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """docs (doc_id, text, any others) with each text rebuilt, and n_lines and n_dropped beside it.

    A line's key is the line with ASCII white space stripped at both ends and A-Z
    lowered. Keys of at least least_chars code points that occur in at least least_docs
    documents (rows; a repeated row counts again) lose all their lines everywhere; the
    lines that stay are joined by newlines as they were. A null or empty text is one
    empty line and comes back as an empty text, as does a text that loses all lines.
    Texts of any length are read whole. n_lines counts the lines before dropping. Columns
    named n_lines or n_dropped in docs are replaced, all others keep their names and values.
    Keys are compared by 128-bit hashes. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    held = scratch.save(_exploded(docs, least_chars), "keys")
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    counts = scratch.save(counts, "counts")
    common = F.broadcast(counts.where(F.col("n") * COMMON >= held.count()).select("key").withColumn("common", F.lit(True)))  # at most COMMON rows
    marked = held.join(common, "key", "left")
    others = marked.where(F.col("common").isNull()).drop("common").join(counts.select("key"), "key")
    found = marked.where("common").drop("common").unionByName(others)
    drops = scratch.save(found.groupBy("doc_id", "text_name").agg(F.collect_set("key").alias("drop")), "drops")
    scratch.drop("keys", "counts")

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    source = docs.select(*(F.col(f"`{c}`") for c in kept))
    doc, name, gone_keys = (spare_name(kept, c) for c in ("__doc", "__name", "__drop"))
    matched = drops.withColumnsRenamed({"doc_id": doc, "text_name": name, "drop": gone_keys})
    joined = source.join(matched, F.col("doc_id").eqNullSafe(F.col(doc)) & (_name_of("text") == F.col(name)), "left").drop(doc, name)
    at = kept.index("text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, drop in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                out = set(drop or ())
                stay = [line for line in lines if xxh3_128_digest(line_key(line)) not in out] if out else lines
                texts.append(b"\n".join(stay).decode())
                totals.append(len(lines))
                gone.append(len(lines) - len(stay))
            columns = [*batch.columns[: len(kept)], pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_lines", "n_dropped"])

    schema = source.schema.add("n_lines", "long").add("n_dropped", "long")
    return map_texts(joined, rebuild, schema)


def digest_of_lines(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of each rebuilt text."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
