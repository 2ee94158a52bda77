"""Ordering the documents of a group: examples, representativeness, relevance to a label, and what is off topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType
from pyspark.sql.window import Window

from ..functions import text as X
from .graph import join_groups, written


def ranked(d: DataFrame, group: Sequence[str], order: Sequence[Column | str], most: int | None = None, payload: Sequence[str] = ()) -> DataFrame:
    """d with `rank` (long, from 1) in its group; with most only the first so many, which each task prunes before the shuffle.

    Whole groups are ranked without bringing any together: rows go to ranges of (group, order), a row's rank is its place
    in the group's rows of its range and the group's rows in the ranges before. d is written once, and the sorted rows once, so
    all steps see the same. payload: columns (texts, say) that order doesn't use; they don't travel to the ranges, ranks come back to them by a row's number. Ties keep d's order.
    """
    if most is not None:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return d.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)
    held = written(d.withColumn("__row", F.monotonically_increasing_id()), "unranked")
    by = [*(F.col(g).asc() for g in group), *(F.col(o).asc() if isinstance(o, str) else o for o in order), F.col("__row")]
    ordered = held.drop(*payload).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33).alias("__part")
    known = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"__g{i}") for i, g in enumerate(group)]
    known += [F.col(g).isNull().alias(f"__n{i}") for i, g in enumerate(group)]  # a null group is a group
    keyed = written(ordered, "ranges").select("*", part, *known)
    keys = ["__part", *(f"__{k}{i}" for i in range(len(group)) for k in "gn")]
    runs = keyed.groupBy(*keys).agg(F.min("__id").alias("__start"), F.count("*").alias("__size"))  # a row per range and group that meet
    before = F.sum("__size").over(Window.partitionBy(*keys[1:]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(*keys, "__start", F.coalesce(before, F.lit(0)).alias("__before"))
    ranks = keyed.join(starts, keys).withColumn("rank", F.col("__before") + F.col("__id") - F.col("__start") + 1)
    if payload:
        ranks = ranks.join(held.select("__row", *payload), "__row")
    return ranks.select(*d.columns, "rank")


def examples(docs: DataFrame, terms: DataFrame, group: Sequence[str], most: int = 3, length: int = 220) -> DataFrame:
    """Per group the texts that contain most terms, then nearest to the target length, then first; equal folded texts once.

    terms: group columns and `terms`, an array.
    """
    folded = terms.select(*group, F.filter(F.transform("terms", X.fold), lambda t: t != "").alias("terms"))  # one row per group
    scored = docs.join(folded, list(group)).withColumn("key", X.fold(F.col("text")))
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("key"), t)))
    order = [F.desc("hits"), "off", "row_number", "fragment_no"]
    scored = scored.withColumns({"hits": hits, "off": F.abs(F.char_length("text") - length)})
    once = scored.withColumn("copy", F.row_number().over(Window.partitionBy(*group, "key").orderBy(*order))).where("copy = 1")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return once.withColumn("rank", place).where(f"rank <= {most}").select(*group, "rank", "row_number", "fragment_no", "hits", "text")


def _pattern(term: Column) -> Column:
    """A term as a regular expression of whole words; any white space between its words."""
    literal = F.regexp_replace(F.trim(term), r"([\\^$.|?*+()\[\]{}])", r"\\\\$1")
    return F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace(literal, " ", r"\\\\s+"), F.lit(r"(?!\w)"))


def _texts(docs: DataFrame, group: Sequence[str]) -> list[str]:
    """Columns of docs whose values may be long: all but numbers and the group."""
    return [f.name for f in docs.schema if f.name not in group and not isinstance(f.dataType, (NumericType, BooleanType))]


def representativeness(
    docs: DataFrame, terms: DataFrame, group: Sequence[str], edge_scores: DataFrame | None = None, most: int | None = None, texts: bool = True
) -> DataFrame:
    """Docs with `rank` in their group; with most only the first so many.

    Ordered by any hit, distinct terms, matches, matches weighted by the terms' places, fewer words, fewer
    characters, better best term, earlier first match; then weighted degree, neighbours, input order. All
    term evidence is 0 without a hit. edge_scores: row_number, fragment_no, degree, neighbours. texts: False leaves out
    docs' columns other than numbers and the group, so that no text is kept or moved.
    """
    long = _texts(docs, group)
    d = join_groups(docs, terms.select(*group, "terms", F.transform("terms", _pattern).alias("__p")), group)
    if edge_scores is not None:
        d = d.join(edge_scores, ["row_number", "fragment_no"], "left")
    degree, near = (F.coalesce(F.col(c), F.lit(0.0)) if edge_scores is not None else F.lit(0.0) for c in ("degree", "neighbours"))
    found = F.transform("__p", lambda p, i: F.struct(i.alias("i"), F.regexp_count("text", p).alias("n"), F.regexp_instr("text", p).alias("at")))
    d = d.withColumn("__f", F.filter(found, lambda x: x["n"] > 0)).withColumn("__hit", F.size("__f") > 0)
    total = lambda f: F.aggregate("__f", F.lit(0), lambda s, x: s + f(x).cast("int"))
    if_hit = lambda c: F.when(F.col("__hit"), c).otherwise(0)
    keys = {
        "__matches": total(lambda x: x["n"]),
        "__weighted": total(lambda x: x["n"] * (F.size("terms") - x["i"])),
        "__words": if_hit(X.word_count(F.col("text"))),
        "__chars": if_hit(F.char_length("text")),
        "__best": if_hit(F.array_min(F.transform("__f", lambda x: x["i"]))),
        "__at": if_hit(F.array_min(F.transform("__f", lambda x: x["at"]))),
        "__degree": F.bround(degree, 6),
        "__near": near,
        "hits": F.size("__f"),
    }
    d = d.withColumns(keys).drop("__f", "__p", "terms", *(() if texts else long))
    order = [F.desc("__hit"), F.desc("hits"), F.desc("__matches"), F.desc("__weighted"), "__words", "__chars", "__best", "__at", F.desc("__degree"), F.desc("__near"), "row_number", "fragment_no"]
    return ranked(d, group, order, most, long if texts else ()).drop(*(k for k in keys if k != "hits"), "__hit")


def relevance_ngrams(label: Column, n: int) -> Column:
    return F.array_distinct(X.ngrams(X.relevance_tokens(label), n))


def topic_tokens(label: Column, terms: Column) -> Column:
    """The relevance tokens of the label and the terms."""
    return F.array_distinct(F.concat(X.relevance_tokens(label), F.flatten(F.transform(terms, X.relevance_tokens))))


def label_relevance(
    docs: DataFrame, topics: DataFrame, group: Sequence[str], order: Sequence[str] = ("row_number", "fragment_no"), most: int | None = None, texts: bool = True
) -> DataFrame:
    """Docs with `rank` by shared trigrams, bigrams and words with the label, words with the terms, then shorter, then as before.

    topics: group columns, label, terms. most: only the first so many of each group. texts: False leaves out docs' columns
    other than numbers and the group, so that no text is kept or moved.
    """
    long = [c for c in _texts(docs, group) if c not in order]
    known = topics.select(
        *group,
        *[relevance_ngrams(F.col("label"), n).alias(f"__l{n}") for n in (2, 3)],
        X.relevance_tokens(F.col("label")).alias("__l"),
        F.array_distinct(F.flatten(F.transform("terms", X.relevance_tokens))).alias("__t"),
    )  # one row per group, so labels and terms are cut once
    d = join_groups(docs, known, group).withColumn("__w", X.relevance_tokens(F.col("text")))
    shared = lambda a, b: F.size(F.array_intersect(a, F.col(b)))
    runs = lambda n: F.when(F.size(f"__l{n}") > 0, shared(X.ngrams(F.col("__w"), n), f"__l{n}")).otherwise(0)
    scores = {"trigrams": runs(3), "bigrams": runs(2), "words": shared(F.col("__w"), "__l"), "term_words": shared(F.col("__w"), "__t")}
    lengths = {"__n": F.regexp_count("text", F.lit("[A-Za-z0-9]+")), "__chars": F.char_length("text")}
    d = d.withColumns(scores | lengths).drop("__l", "__l2", "__l3", "__t", "__w", *(() if texts else long))
    by = [*(F.desc(c) for c in scores), *lengths, *order]
    return ranked(d, group, by, most, long if texts else ()).drop(*lengths)


def off_topic(docs: DataFrame, topics: DataFrame, group: Sequence[str]) -> DataFrame:
    """docs with `off_topic`: no token in common with the label and terms, in a group of two documents or more.

    Noise groups are not judged: leave them out of topics.
    """
    known = topics.select(*group, topic_tokens(F.col("label"), F.col("terms")).alias("__k"))  # one row per group
    sizes = docs.groupBy(*group).agg(F.count("*").alias("__n"))
    d = join_groups(docs, known.join(sizes, list(group)), group)
    meets = F.arrays_overlap(X.relevance_tokens(F.col("text")), F.col("__k"))
    return d.withColumn("off_topic", (F.col("__n") >= 2) & ~F.coalesce(meets, F.lit(False))).drop("__n", "__k")
