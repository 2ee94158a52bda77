"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Rows combine in three stages: within each map task, within salted digest groups, then over the salts.
Every stage groups by the digest and by the whole normalised text, so equal digests of different
texts never merge, and a text with millions of copies reaches any task as one row per salt at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_by_size, materialise, text_or_empty


def normalised(name: str = "text") -> Column:
    """The text without the characters of SPACES; null counts as empty."""
    return F.translate(text_or_empty(name), SPACES, "")


def _rank() -> Column:
    """The least of a class stays: most code points, then the smallest doc_id (null after all others), then a hash of the original text."""
    return F.struct((-F.char_length(text_or_empty())).alias("shorter"), F.col("doc_id").isNull().alias("anonymous"), F.col("doc_id"), F.xxhash64(text_or_empty()).alias("mark"))


def text_classes(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: digest, norm, best (the rank of the row that stays), group_size."""
    salt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts))
    rows = docs.select(F.sha2(normalised(), 256).alias("digest"), normalised().alias("norm"), _rank().alias("best"), salt.alias("salt"))
    salted = rows.groupBy("salt", "digest", "norm").agg(F.min("best").alias("best"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Exactly one row of a group is kept, also where rows share a doc_id or repeat whole: of rows that agree in all that
    decides, any one. Null and empty texts are equal to each other. Columns of docs other than doc_id and text
    have no effect, whatever their names. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    classes = text_classes(docs, salts)
    by_digest = materialise(classes.groupBy("digest").agg(F.count("*").alias("texts"), F.min("best").alias("best"), F.min("group_size").alias("group_size")), "digests")
    rows = docs.select("doc_id", F.sha2(normalised(), 256).alias("digest"), _rank().alias("own"))
    found = join_by_size(materialise(rows, "rows"), by_digest.where("texts = 1").drop("texts"), ["digest"], "group_size")
    shared = by_digest.where("texts > 1")
    if not shared.isEmpty():  # different texts of one digest: compare the texts themselves
        odd = docs.select("doc_id", F.sha2(normalised(), 256).alias("digest"), normalised().alias("norm"), _rank().alias("own"))
        odd = odd.join(shared.select("digest"), "digest", "left_semi").join(classes, ["digest", "norm"])
        found = found.unionByName(odd.drop("norm"))
    found = found.select("doc_id", "group_size", "digest", "best", F.col("own").eqNullSafe(F.col("best")).alias("kept"), F.monotonically_increasing_id().alias("row"))
    found = materialise(found, "found")
    firsts = found.where("kept").groupBy("digest", "best").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    if not firsts.isEmpty():  # whole rows repeat
        firsts = firsts.withColumnRenamed("rows", "members").drop("best")
        again = join_by_size(found.where("kept"), firsts, ["digest"]) if shared.isEmpty() else found.where("kept").join(firsts, "digest")
        found = found.join(again.where("row <> first").select("row", F.lit(True).alias("again")).distinct(), "row", "left").withColumn("kept", F.col("kept") & F.col("again").isNull())
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))
