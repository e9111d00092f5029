"""Exact duplicates by recipes of content-defined chunks, with built-in functions only.

A text is cut where its own characters say so, so that equal passages give equal chunks
wherever they stand. A chunk is known by a 64-bit identifier and proved by its SHA-256: over
all distinct chunks of the corpus, identifiers that stand for several chunks are found and
told apart by number. A document's recipe is the ordered list of its chunks' verified
identifiers, and documents are equal when their recipes are. The texts are read once and
never shuffled; chunk proofs are pre-aggregated, and after that only recipes move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.storage import Scratch

#: A chunk ends at the first such pair of characters after 192 characters, after 2048 characters, or with the text.
CHUNK = r"(?s).{192,2046}?[hpxHPX08。、][ .,;:!?]|.{1,2048}"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_duplicates(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs (doc_id, text; other columns are ignored).

    Texts are equal when they are identical after normalised(); keep_id is the smallest
    doc_id among equal texts (null only if all are null), and exactly one row of each
    group is kept: that of the smallest doc_id, one of them where rows repeat. Null and
    empty texts form one group. text_sha256 is that of the normalised text. An empty table
    gives an empty result. id_bits narrows the identifiers, for tests of their verification.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    read = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    read = read.withColumn("chunks", F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)))
    mask = F.lit(-1 if id_bits == 64 else (1 << id_bits) - 1).cast("long")
    recipes = scratch.save(
        read.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform("chunks", lambda c: F.xxhash64(c).bitwiseAND(mask)).alias("recipe"),
            F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("proofs"),
        ),
        "recipes",
    )
    cells = recipes.select("row", F.posexplode(F.arrays_zip("recipe", "proofs")).alias("pos", "chunk"))
    cells = cells.select("row", "pos", F.col("chunk.recipe").alias("id"), F.col("chunk.proofs").alias("proof"))
    proved = cells.select("id", "proof").distinct()
    shared = scratch.save(proved.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "shared-ids")
    if shared.isEmpty():
        known = recipes.withColumn("variants", F.array().cast("array<int>"))
    else:
        number = F.row_number().over(Window.partitionBy("id").orderBy("proof"))
        told = proved.join(shared, "id").withColumn("variant", number)
        of_row = cells.join(told, ["id", "proof"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "variant"))).alias("found"))
        of_row = of_row.select("row", F.col("found.variant").alias("variants"))
        known = recipes.join(of_row, "row", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<int>")))

    known = known.drop("proofs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    groups = known.groupBy("recipe", "variants").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = known.join(groups, ["recipe", "variants"], "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )
