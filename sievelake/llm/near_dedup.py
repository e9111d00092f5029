"""MinHash near-duplicates: one-permutation sketches, banded buckets, star-shaped candidate edges.

Plan, for a corpus of any size:

1. One pass over the texts (Arrow batches) makes each document's shingle set, names the
   set by 128 bits and sketches it. Documents with equal sets are one class from here on,
   so a text that holds a third of all rows costs one sketch row.
2. A class has one row per band. Buckets of one class are dropped. In the others the
   least class is the centre of a star: each other member is compared with the centre only.
3. Pairs whose sizes, or 256-bit parity maps of their sets, rule out enough likeness are
   dropped, exactly. Links are confirmed on the full sets of the two texts. Components are found by label
   spreading in shared tables.
4. A star alone could miss a link between two members of which neither is like the centre.
   So buckets whose members are not yet all in one component go on. Small ones get stars
   around all their members. A large one holds texts that share much but not enough (a
   common passage, say), so its members are dealt anew by an exact rule: in any one order
   of shingles, commonest last, two sets that are alike enough share a shingle among the
   first n - ceil(percent * n) + 1 of each. What two sets can share from their first
   common shingle on bounds the sizes for which that is enough, so a shingle's place tells
   which partners it can still have: it is dealt only into buckets of their size classes,
   and leaves a bucket in which no member is small enough. Texts alike only in a common
   passage meet no more, without any pair being looked at. These buckets get stars with
   eight times the centres in each round, members of small components first. A centre has
   met all of its bucket and leaves it; a bucket is closed when those left are one component.

A pair at the threshold meets in no band with a probability of about 4e-6 (defaults); above
it, less. A pair that meets is always settled exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.shingles import PARITY_WORDS, band_keys, enough_in_common, mix, one_permutation_sketch, parity_map, set_name, shingle_set
from sievelake.operators.components import connected_components
from sievelake.storage import Scratch, map_texts, spare_name

#: Centres per bucket grow by this factor from one round to the next.
STAR_GROWTH = 8
#: Ratio of the sizes that make one class of partners.
SIZE_CLASS = 1.05
#: Parts in which a bucket's members are first ranked.
RANK_PARTS = 16
#: Texts from which the commonest shingles are learnt, and how many are kept; they only set an order, any order is exact.
ORDER_TEXTS, ORDER_SHINGLES = 1000, 100_000
_CELLS = [f"p{i}" for i in range(PARITY_WORDS)]


def sketch_documents(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_name (null for an empty set), parity map and bucket keys of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, maps, keys = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingle_set(text, words)
                sizes.append(len(found))
                names.append(set_name(found) if len(found) else None)
                maps.append(parity_map(found) if len(found) else None)
                keys.append(band_keys(one_permutation_sketch(found, bands * rows), bands) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (maps, keys))],
                names=["doc_id", "text_hash", "n_shingles", "set_name", "parity", "buckets"],
            )

    rows_ = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_texts(rows_, run, "doc_id long, text_hash long, n_shingles long, set_name binary, parity array<long>, buckets array<long>")


def _texts_of_classes(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """set_name and one text of each wanted class; wanted has doc_id (the class's least) and set_name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = []
            for i, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                if name not in seen and set_name(shingle_set(text, words)) == name:
                    seen.add(name)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    ids = wanted.select(F.col("doc_id").alias("class_id"), "set_name")
    joined = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("class_id")))
    return map_texts(joined.select("set_name", "text"), run, "set_name binary, text string")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for batch in batches:
            keep = []
            a, text_a, text_b = (batch.column(i) for i in (0, 2, 3))
            for i, (name, other) in enumerate(zip(a.to_pylist(), text_b.cast(pa.binary()).to_pylist(), strict=True)):
                if name != last:
                    last, centre = name, shingle_set(text_a[i].as_py().encode(), words)
                if enough_in_common(centre, shingle_set(other, words), percent):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    with_b = pairs.join(texts.select(F.col("set_name").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("set_name").alias("a"), F.col("text").alias("text_a")), "a")
    return map_texts(both.select("a", "b", "text_a", "text_b"), run, "a binary, b binary")


def _common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of shingles that recur in a bounded number of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], names=["shingle"])

    some = map_texts(texts.orderBy("set_name").limit(ORDER_TEXTS).select("text"), run, "shingle long")
    often = some.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES)
    found = sorted((np.uint64(h & (2**64 - 1)), n) for h, n in often.collect())  # at most ORDER_SHINGLES
    return np.array([h for h, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def _prefix_buckets(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(set_name, n, pos, side, bucket, parity map): the first shingles of each text, in the order in which the commonest come last.

    A bucket is a shingle with the size classes of two partners. The shingle at a position
    can be the first common one only of partners up to a size, which falls with the position.
    """
    known, counts = _common_shingles(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, sizes, places, sides, maps, keys = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found = shingle_set(text, words)
                at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                rank = np.where(known[at] == found, counts[at], 0) if len(known) else np.zeros(len(found), np.int64)
                first = len(found) + (-percent * len(found)) // 100 + 1
                cells, places_of, sides_of = partner_cells(found[np.argsort(rank, kind="stable")[:first]], len(found), percent)
                owner.append(np.full(len(cells), i))
                sizes.append(np.full(len(cells), len(found)))
                places.append(places_of)
                sides.append(sides_of)
                maps.append(np.repeat(parity_map(found)[:, None], len(cells), axis=1))
                keys.append(cells.view(np.int64))
            if owner:
                owners = pa.array(np.concatenate(owner))
                columns = [batch.column(0).take(owners), *(pa.array(np.concatenate(x)) for x in (sizes, places, sides, keys, *zip(*maps, strict=True)))]
                yield pa.RecordBatch.from_arrays(columns, names=["set_name", "n", "pos", "side", "bucket", *_CELLS])

    return map_texts(texts.select("set_name", "text"), run, "set_name binary, n long, pos long, side long, bucket long" + "".join(f", {c} long" for c in _CELLS))


def partner_cells(chosen: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys, positions and sides of a set's first shingles: one for each size class that partners of the position can have.

    In a bucket of two classes the smaller set is on side 0, the larger on side 1, and only
    sets of different sides are partners; in a bucket of one class (side -1) all are.
    """
    pos = np.arange(len(chosen))
    least = -(-percent * n // 100)
    most = np.minimum(100 * n // percent, (100 + percent) * (n - pos) // percent - n)
    own, low, high = (np.floor(np.log(np.maximum(x, 1)) / np.log(SIZE_CLASS)).astype(np.int64) for x in (n, least, most))
    count = np.where(most >= least, high - low + 1, 0)
    at = np.repeat(pos, count)
    other = low + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    classes = (np.minimum(own, other).astype(np.uint64) << np.uint64(32)) + np.maximum(own, other).astype(np.uint64)
    return mix(chosen[at] + mix(classes + np.uint64(0x9E3779B97F4A7C15))), at, np.where(other == own, -1, (other < own).astype(np.int64))


def _with_company(cells: DataFrame) -> DataFrame:
    """The cells whose bucket has more members, and their number."""
    shared = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return cells.join(shared, "bucket")


def _united(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, component) after new links (a, b): only the components they touch are joined, by their names."""
    if labels is None:
        return scratch.save(connected_components(links, scratch), "labels")
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("label_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("label_b"))
    named = links.join(of_a, "a", "left").join(of_b, "b", "left")
    named = named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct()
    joined = connected_components(named, scratch)
    renamed = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    new = joined.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return scratch.save(renamed.select("node", F.coalesce("now", "component").alias("component")).union(new), "labels")


def _apart(cells: DataFrame, labels: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The cells of buckets whose members span several components, with label and weight (classes in the component).

    Cells from whose position on a set shares too little even with the smallest member are left out.
    """
    named = cells.select("set_name", "n", *_CELLS, "pos", "side", "bucket").join(labels.withColumnRenamed("node", "set_name"), "set_name", "left")
    named = named.join(sizes, "component", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    named = named.withColumn("label", F.coalesce("component", "set_name")).drop("component")
    spread = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"), F.min("n").alias("least_n"), F.min("side").alias("left"), F.max("side").alias("right"))
    both = (F.col("left") == -1) | (F.col("left") != F.col("right"))
    open_ = named.join(spread.where((F.col("low") != F.col("high")) & both).select("bucket", "members", "least_n"), "bucket")
    return open_.where((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + F.col("least_n"))).drop("least_n")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, with_keys: bool = False, trace: list | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text; other columns are ignored).

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of
    word shingles; component_id is the smallest doc_id reachable, kept tells whether it
    is the row's own. Null, empty and wordless texts have an empty set and are linked
    with nothing. Repeated rows come back as often as they went in. A null doc_id never
    names a component unless all of its component's are null. An empty table gives an
    empty result. with_keys adds text_hash (xxhash64 of the text) and component_key, which
    names the component also where doc_ids repeat (null for an empty set). Texts of any
    length are read whole. trace gets the number of rows joined with centres in each round.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    sketch = scratch.save(sketch_documents(docs, words, bands, rows), "sketch")
    classes = scratch.save(
        sketch.where(F.col("set_name").isNotNull())
        .groupBy("set_name")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"), F.first("buckets").alias("buckets")),
        "classes",
    )
    # Only names and buckets of all classes are shuffled; what else the stars need joins those in company.
    cells = _with_company(classes.select("set_name", F.explode("buckets").alias("bucket")))
    maps = (F.col("parity")[i].alias(c) for i, c in enumerate(_CELLS))
    live = cells.join(classes.select("set_name", "n", *maps), "set_name")
    live = scratch.save(live.withColumns({"label": F.col("set_name"), "weight": F.lit(1), "pos": F.lit(0), "side": F.lit(-1)}), "live")
    wanted = live.select("set_name").distinct().join(classes.select("set_name", "doc_id"), "set_name")
    texts = scratch.save(_texts_of_classes(docs, wanted, words), "texts")

    labels, centres, first = None, 1, True
    while True:
        # Members of small components first: once they have been centres, the rest is often one component. The first
        # stars have the same centres in all buckets, so that bands share pairs; later ones differ, to reach more families.
        live = live.withColumn("turn", F.xxhash64("set_name") if first else F.xxhash64("bucket", "set_name"))
        order = ["weight", "turn", "set_name"]
        hubs = live.withColumn("part", F.pmod(F.xxhash64("set_name"), F.lit(RANK_PARTS)))
        for keys in (["bucket", "part"], ["bucket"]):  # a large bucket is ranked in parts first
            hubs = hubs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= centres)
        hubs = scratch.save(hubs.select("bucket", F.col("set_name").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("side").alias("hub_side"), F.col("label").alias("hub_label"), F.col("weight").alias("hub_weight"), F.col("turn").alias("hub_turn"), *(F.col(c).alias(f"hub_{c}") for c in _CELLS)), "hubs")
        # What two sets can share from their first common shingle on must reach what likeness asks of their sizes.
        enough = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos")) >= percent * (F.col("n") + F.col("hub_n"))
        # And the hashes in which they surely differ must not exceed what it allows.
        differ = reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub_{c}"))) for c in _CELLS))
        enough = enough & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("hub_n")))
        enough = enough & ((F.col("side") == -1) | (F.col("side") != F.col("hub_side")))
        # Of two hubs in one bucket only the first in order takes the pair.
        near = (F.col("label") != F.col("hub_label")) & (F.struct("hub_weight", "hub_turn", "hub") < F.struct("weight", "turn", "set_name")) & enough
        if trace is not None:
            trace.append(live.join(hubs, "bucket").count())
        pairs = live.join(hubs, "bucket").where(near).select(F.least("set_name", "hub").alias("a"), F.greatest("set_name", "hub").alias("b"))
        confirmed = _confirm(scratch.save(pairs.distinct(), "pairs"), texts, words, percent)
        labels = _united(labels, scratch.save(confirmed, "links"), scratch)
        sizes = scratch.save(labels.groupBy("component").agg(F.count(F.lit(1)).alias("weight")), "sizes")
        rest = live.join(hubs.select("bucket", F.col("hub").alias("set_name")), ["bucket", "set_name"], "left_anti")
        live = scratch.save(_apart(rest, labels, sizes, percent), "live")
        if live.isEmpty():
            break
        if first:
            large = live.where(F.col("members") > STAR_GROWTH)
            dealt = _prefix_buckets(texts.join(large.select("set_name").distinct(), "set_name", "left_semi"), words, percent)
            both = live.where(F.col("members") <= STAR_GROWTH).select("set_name", "n", *_CELLS, "pos", "side", "bucket").unionByName(scratch.save(dealt, "prefixes"))
            live = scratch.save(_apart(both, labels, sizes, percent), "live")
            scratch.drop("prefixes")
            if live.isEmpty():
                break
        first, centres = False, centres * STAR_GROWTH

    grouped = classes.select("set_name", "doc_id").join(labels.withColumnRenamed("node", "set_name"), "set_name", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "set_name"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch.save(grouped.join(least, "component").select("set_name", "component_id", F.col("component").alias("component_key")), "components")
    scratch.drop("classes", "live", "texts", "hubs", "sizes", "pairs", "links", "labels")
    placed = sketch.drop("buckets").join(of_class, "set_name", "left")
    component = F.when(F.col("set_name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    keys = ["text_hash", "component_key"] if with_keys else []
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *keys)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """The rows of docs, all their columns, of which one stays per component of near_duplicates; it has the component's smallest doc_id.

    Documents without words are in no component and all stay, but repeated rows of one
    doc_id and text count as copies. Columns of any name come back as they were. Texts are
    shuffled once; what decides is done on hashes.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = near_duplicates(docs, words, percent, bands, rows, with_keys=True).where("kept")
    named = F.struct("text_hash", "doc_id")
    grouped = found.where(F.col("component_key").isNotNull()).groupBy("component_key").agg(F.min(named).alias("first")).select("first.doc_id", "first.text_hash")
    every = grouped.union(found.where(F.col("component_key").isNull()).select("doc_id", "text_hash")).distinct()
    copies = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    doc, hashed, n = (spare_name(docs.columns, c) for c in ("__doc", "__hash", "__n"))
    kept = every.join(copies, every["doc_id"].eqNullSafe(copies["doc_id"]) & every["text_hash"].eqNullSafe(copies["text_hash"]))
    kept = scratch.save(kept.select(every["doc_id"].alias(doc), every["text_hash"].alias(hashed), F.col("n").alias(n)), "kept")

    def rows_of(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted.drop(n), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(hashed)))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows_of(kept.where(F.col(n) == 1)).select(*columns)
    often = kept.where(F.col(n) > 1)
    if often.isEmpty():
        return once
    return once.unionByName(rows_of(often).dropDuplicates([doc, hashed]).select(*columns))
