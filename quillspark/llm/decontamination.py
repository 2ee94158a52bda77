"""Benchmark passages inside documents, in DataFrame functions only.

Test items are partitioned by size (powers of two of their shingle counts). Partition p has its own
number of MinHash coordinates: under coordinate k an item is represented by its shingle of smallest
k-th hash. A document of any length holds that shingle with probability equal to the item's
containment, so the share of an item's coordinates among a document's shingles estimates containment
without a document sketch, whatever the ratio of sizes. Documents stream past the item sketches, hashed
once; pairs whose estimate is far too low go, the rest are verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows and ids up to which a side is broadcast (24 bytes each); above, both sides are shuffled.
SKETCH_ROWS, ID_ROWS = 500_000, 1_000_000


def word_list(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_list(words: Column, k: int) -> Column:
    """Distinct k-word shingles; a list of 1 to k - 1 words is one shingle, an empty list has none."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    return F.array_distinct(F.when(F.size(words) >= k, many).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")))


def _hashes(words: Column, k: int) -> Column:
    """Distinct shingle hashes, without making the shingles' strings."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))
    return F.array_distinct(F.when(F.size(words) >= k, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>")))


def coordinates(size_class: Column) -> Column:
    """MinHash coordinates of a size partition: 16 and 4 more for each doubling."""
    return F.lit(16) + 4 * size_class


def item_sketches(items: DataFrame, k: int) -> DataFrame:
    """hash, item_id, weight (coordinates that the shingle stands for), wanted (coordinates of the item)."""
    sets = items.withColumn("words", word_list()).select("item_id", F.explode(_hashes(F.col("words"), k)).alias("hash")).distinct()
    sized = sets.join(sets.groupBy("item_id").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("size_class")), "item_id")
    drawn = sized.select("item_id", "hash", coordinates(F.col("size_class")).alias("wanted")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("wanted"))))
    least = drawn.groupBy("item_id", "wanted", "k").agg(F.min(F.struct(F.xxhash64("hash", "k").alias("rank"), "hash")).alias("least"))
    return least.groupBy("item_id", "wanted", F.col("least.hash").alias("hash")).agg(F.count("*").alias("weight"))


def candidates(docs: DataFrame, items: DataFrame, containment: float, k: int) -> DataFrame:
    """(doc_id, item_id) pairs whose estimated containment is at least 0.3 of the threshold."""
    sketches = materialise(item_sketches(items, k), "sketches")
    if sketches.count() <= SKETCH_ROWS:
        sketches = F.broadcast(sketches)
    hashes = docs.withColumn("words", word_list()).select("doc_id", F.explode(_hashes(F.col("words"), k)).alias("hash"))
    hits = hashes.join(sketches, "hash").groupBy("doc_id", "item_id", "wanted").agg(F.sum("weight").alias("held"))
    return hits.where(F.col("held") >= F.col("wanted") * (0.3 * containment)).select("doc_id", "item_id")


def contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, k: int = 5) -> DataFrame:
    """doc_id, item_id, item_shingles, found, of every pair with found >= containment * item_shingles.

    found counts the item's distinct k-word shingles that the document has. Words are lower-cased runs of
    letters and digits. An item of fewer than k words is one shingle, found only in a document of those
    words alone; items without words are found nowhere. Rows with a null id are not reported; rows that
    share an id count as one item or document each with the union of their pairs, the larger found.
    Empty tables give an empty result. Extra columns have no effect. An item at the threshold is missed
    as a candidate with a probability under 1e-6 (binomial tail over its coordinates).
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items = items.select("item_id", "text").where("item_id is not null")
    pairs = materialise(candidates(docs, items, containment, k), "candidates")
    ids = pairs.select("doc_id").distinct()
    chosen = docs.join(F.broadcast(ids) if pairs.count() <= ID_ROWS else ids, "doc_id", "left_semi")
    have = chosen.withColumn("words", word_list()).select("doc_id", shingle_list(F.col("words"), k).alias("have"))
    want = items.withColumn("words", word_list()).select("item_id", shingle_list(F.col("words"), k).alias("want"))
    both = pairs.join(want, "item_id").join(have, "doc_id")
    found = both.select("doc_id", "item_id", F.size("want").cast("long").alias("item_shingles"), F.size(F.array_intersect("have", "want")).cast("long").alias("found"))
    found = found.where(F.col("found") >= F.lit(containment) * F.col("item_shingles"))
    return found.groupBy("doc_id", "item_id").agg(F.max("item_shingles").alias("item_shingles"), F.max("found").alias("found"))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = 0.8, k: int = 5) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    dirty = contaminated(docs, items, containment, k).select(F.col("doc_id").alias("__dirty")).distinct()
    return docs.join(dirty, docs["doc_id"] == dirty["__dirty"], "left_anti")
