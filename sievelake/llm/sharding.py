"""Hierarchical weighted hash tree: documents go down by region, rack and shard; built-in functions only.

The tree has a fixed shape: racks in a region, shards in a rack, and a capacity that no
shard's weight exceeds. A key walks down it by weighted hash draws: one for the region, one
for the rack among that region's, one for the shard among that rack's. A shard accepts the
key with the chance weight / capacity; else the walk starts anew with the next draws. Each
draw is a hash of the key, the node and the number of the walk, never of other weights, so a
changed weight only changes whether walks that reach that shard end there: rows move into
or out of it and nowhere else, and a shard that is added takes rows only into itself.

Regions are drawn from a range that doubles as they grow. Each doubling has draws of its
own, and those that fall into its lower half go on in the smaller range's; so the walks of
a smaller tree are those of the larger one without the draws that none of its shards can
accept, and stay in their order. Keys that no shard accepts in WALKS draws of each range
(about one in 10^19 for half-full trees) go to the least of weighted draws of all shards,
which keeps the same law.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.storage import Scratch

#: Draws from each range of regions before a key goes to the least draw.
WALKS = 64
#: Steps that a walk takes before it is looked at whether it has ended.
FIRST_STEPS = 24
#: Rows that are numbered together.
SLOT_ROWS = 100_000


@dataclass(frozen=True)
class Tree:
    """Weights of the shards in order; shard s stands in region s // (racks * slots) and rack s // slots. No weight: no such shard."""

    weights: tuple[float, ...]
    racks: int = 4
    slots: int = 2
    capacity: float = 1.0

    def __post_init__(self):
        if not any(w > 0 for w in self.weights) or any(w < 0 or w > self.capacity for w in self.weights):
            raise ValueError("weights must lie between 0 and the capacity, one above 0")

    @property
    def ranges(self) -> int:
        """Doublings of the range of regions, the first of one region counted."""
        regions = -(-len(self.weights) // (self.racks * self.slots))
        return (regions - 1).bit_length() + 1


def even_tree(shards: int) -> Tree:
    return Tree((1.0,) * shards)


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that the parts decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def least_draw(key: Column, tree: Tree) -> Column:
    """The shard with the least exponential draw, its weight as rate."""
    draws = [F.struct((-F.log(uniform(F.lit("least"), F.lit(s), key)) / w).alias("draw"), F.lit(s).alias("shard")) for s, w in enumerate(tree.weights) if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def place(key: Column, tree: Tree) -> Column:
    """The shard where the key's walks end."""
    top, weights = tree.ranges - 1, F.array(*map(F.lit, tree.weights))
    spans = F.array(*(F.lit(1 << level) for level in range(tree.ranges)))

    def step(walk: Column, _: Column) -> Column:
        level, number = walk["level"], F.get(walk["drawn"], walk["level"])
        one = F.struct(key.alias("key"), level.alias("level"), number.alias("number"))

        def of(*more: Column) -> list[Column]:
            return [*more, one["key"], one["level"], one["number"]]

        span = F.get(spans, level)
        region = F.pmod(F.xxhash64(*of(F.lit("region"))), span).cast("int")
        rack = F.pmod(F.xxhash64(*of(F.lit("rack"), region)), F.lit(tree.racks)).cast("int")
        slot = F.pmod(F.xxhash64(*of(F.lit("shard"), region, rack)), F.lit(tree.slots)).cast("int")
        shard = (region * tree.racks + rack) * tree.slots + slot
        accepted = uniform(*of(F.lit("weight"), shard)) * tree.capacity < F.coalesce(F.get(weights, shard), F.lit(0.0))
        drawn = F.transform(walk["drawn"], lambda n, i: n + (i == level).cast("int"))
        lower = (level > 0) & (region < span / 2)

        def now(shard: Column, level: Column, drawn: Column) -> Column:
            return F.struct(shard.cast("int").alias("shard"), level.cast("int").alias("level"), drawn.alias("drawn"))

        spent = now(F.when(level == 0, -2).otherwise(-1), F.greatest(level - 1, F.lit(0)), walk["drawn"])
        ended = now(F.when(accepted, shard).otherwise(-1), F.lit(top), drawn)
        return F.when(walk["shard"] != -1, walk).when(number >= WALKS, spent).when(lower, now(F.lit(-1), level - 1, drawn)).otherwise(ended)

    start = F.struct(F.lit(-1).alias("shard"), F.lit(top).alias("level"), F.array_repeat(F.lit(0), top + 1).alias("drawn"))
    # Each step draws or leaves a range that is spent, after which the walk may start anew from the top.
    steps = WALKS * (top + 1) * (top + 1) + top + 1

    def went_on(walk: Column) -> Column:
        shard = F.when(walk["shard"] != -1, walk["shard"]).otherwise(F.aggregate(F.sequence(F.lit(FIRST_STEPS), F.lit(max(steps, FIRST_STEPS))), walk, step)["shard"])
        return F.transform(F.array(shard), lambda s: F.when(s >= 0, s).otherwise(least_draw(key, tree)))[0]

    # Nearly all walks end within a few steps; only the others pay for the bound.
    return F.transform(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(FIRST_STEPS)), start, step)), went_on)[0]


def shard_documents(docs: DataFrame, shards: int = 24, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard, region, rack of each row of docs (doc_id, text; others are ignored).

    doc_id and the tree alone decide the shard; grown_shard is the one in the tree `grown`,
    by default with one more shard. size is the text's UTF-8 bytes plus 8 and text_crc32
    its unsigned CRC, of texts of any length; a null text counts as empty. Slots number the
    rows of a shard from 0 without gaps. Rows with a null doc_id share a shard, as do
    repeated rows. An empty table gives an empty result.
    """
    tree = tree or even_tree(shards)
    grown = grown or even_tree(shards + 1)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(F.col("doc_id"), tree).alias("shard"),
        place(F.col("doc_id"), grown).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = Scratch(docs.sparkSession, "sharding").save(rows, "placed")
    # Rows are dealt by their number, so that no id, however often repeated, fills one part.
    most = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(-(-most // SLOT_ROWS) or 1)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "row")
    numbered = rows.withColumn("nth", F.row_number().over(within)).join(base, ["shard", "part"])
    rack = F.floor(F.col("shard") / tree.slots).cast("int").alias("rack")
    region = F.floor(F.col("shard") / (tree.slots * tree.racks)).cast("int").alias("region")
    slot = (F.col("base") + F.col("nth") - 1).alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard", region, rack)


def moved(before: Tree, after: Tree) -> Column:
    """Whether a row (by its doc_id column) lies elsewhere in the second tree."""
    return place(F.col("doc_id"), before) != place(F.col("doc_id"), after)
