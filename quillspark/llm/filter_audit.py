"""Filter interaction audit by a subset-zeta transform, in DataFrame functions only.

Every document gets a mask with a bit for each filter it fails. Documents are counted once, by part and mask; the
zeta transform turns a part's counts into "documents whose failures all lie in S" for every subset S of the
filters, which are the survivors of the filters outside S. A step of an order is then the difference of two
neighbouring subsets, whatever the order, and the same holds for documents of a label. So the texts are read
once, however many orders are asked for.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, text_or_empty

FILTERS = "ABCDE"
FEW_WORDS = 200  #: A: fewer words than this
LEAST_DISTINCT = 50  #: B: percent of the words that are distinct, at least
MOST_CAPITALS = 2  #: C: percent of the code points that are A to Z, at most
SYMBOLS = "#$%&*|"  #: D: any of these
COUNTED = ("docs", "good", "toxic")


def _bit(failed: Column, letter: str) -> Column:
    return F.when(failed, 1 << FILTERS.index(letter)).otherwise(0)


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which a text fails by itself. words: its words in an array."""
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (
        _bit(n < FEW_WORDS, "A")
        + _bit(100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, "B")
        + _bit(100 * capitals > MOST_CAPITALS * F.char_length(text), "C")
        + _bit(F.char_length(F.translate(text, SYMBOLS, "")) < F.char_length(text), "D")
    )


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of a part fail exactly the filters of the mask, of all and of those with a label.

    Equal texts share the bits A to D, so rows are first counted by text and part. Of a text's rows those of its smallest doc_id
    pass E; a null doc_id is smaller than none and greater than none, so its rows pass too. Texts are equal by SHA-256. Of the rows only
    ids, digests and labels are moved; a text of very many copies is one row for each task and part before it moves.
    """
    spaces = F.translate(text_or_empty(), SPACES, " " * len(SPACES))
    held = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"), F.array_remove(F.split(spaces, " "), "").alias("words"))
    held = held.select("doc_id", "part", own_failures(F.col("text"), F.col("words")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    held = held.join(known, "doc_id", "left").na.fill(0, ["good", "toxic"])
    group = ["digest", "part", "own", "good", "toxic"]
    rows = held.groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    ids = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"))
    # a row per text, part and label: no more than the parts of one text meet
    ids = materialise(ids.select(*group, "n", "without", F.col("first.doc_id").alias("least"), F.col("first.n").alias("at_least")), "texts")
    firsts = ids.groupBy("digest").agg(F.min("least").alias("smallest"))
    passing = F.col("without") + F.when(F.col("least") == F.col("smallest"), F.col("at_least")).otherwise(0)
    split = ids.join(firsts, "digest").select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), passing.alias("n")), F.struct((F.col("own") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - passing).alias("n")))).alias("c"))
    return split.select("part", "good", "toxic", "c.*").groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _dense(counted: str) -> Column:
    """The counts of all masks in an array, of the map `by` from masks to counts."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), lambda m: F.coalesce(F.try_element_at("by", m)[counted], F.lit(0).cast("long")))


def _add_subsets(counts: Column, bit: int) -> Column:
    """A step of the zeta transform: elements whose index has the bit get the element without it added."""
    return F.transform(counts, lambda x, i: F.when(i.bitwiseAND(1 << bit) != 0, x + F.get(counts, i - (1 << bit))).otherwise(x))


def survivors(counts: DataFrame) -> DataFrame:
    """One row a part: for each of docs, good and toxic an array whose element S is how many have all their failures in S. counts: as of mask_counts()."""
    wide = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTED)))).alias("by"))  # a row a mask at most
    wide = wide.select("part", *(_dense(c).alias(c) for c in COUNTED))
    for b in range(len(FILTERS)):
        wide = wide.select("part", *(_add_subsets(F.col(c), b).alias(c) for c in COUNTED))
    return wide


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null: empty), order of the five filters, and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters are given by FEW_WORDS, LEAST_DISTINCT, MOST_CAPITALS and SYMBOLS, and E removes texts that a smaller doc_id has too. Null
    and empty texts fail A alone, and E where repeated. Rows that repeat a doc_id count each and get its labels; of several labels of a doc_id one of 1 suffices; a null doc_id has
    none. Steps that remove nothing are rows too. An empty table gives an empty result; extra columns have no effect.
    """
    full = (1 << len(FILTERS)) - 1
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit_of = lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord(FILTERS[0]))
    left = lambda c, gone: F.get(c, F.lit(full) - gone)  # noqa: E731  survivors of the filters `gone`
    lost = lambda c, earlier, bit: left(c, earlier) - left(c, earlier + bit)
    n = len(FILTERS)
    ways = F.lit([factorial(k) * factorial(n - 1 - k) for k in range(n)])  # orders in which k given filters are those before one, and no others
    subsets = F.sequence(F.lit(0), F.lit(full))
    shares = F.array(*(F.aggregate(F.filter(subsets, lambda s: s.bitwiseAND(bit) == 0), F.lit(0).cast("long"), lambda a, s: a + F.get(ways, F.bit_count(s)) * lost("docs", s, F.lit(bit))) for bit in (1 << k for k in range(n))))
    parts = materialise(survivors(mask_counts(docs, labels)).withColumn("shares", shares), "parts")  # a row a part
    steps = parts.withColumn("filter_order", F.explode(F.lit(orders))).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("at")), F.lit(0), lambda a, c: a + bit_of(c))
    steps = steps.withColumns({"bit": bit_of(F.col("letter")), "earlier": before})
    earlier, bit = F.col("earlier"), F.col("bit")
    removed = lost("docs", earlier, bit)
    return steps.select(
        "part",
        "filter_order",
        (F.col("at") + 1).cast("int").alias("step"),
        left("docs", earlier + bit).alias("kept"),
        removed.alias("removed"),
        (lost("docs", F.lit(0), bit) - removed).alias("redundant"),
        (F.get("docs", bit) - F.get("docs", F.lit(0))).alias("unique_fails"),
        lost("good", earlier, bit).alias("good_lost"),
        lost("toxic", earlier, bit).alias("toxic_lost"),
        F.get("shares", F.ascii("letter") - ord(FILTERS[0])).alias("shapley"),
    )
