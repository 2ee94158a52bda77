"""Groups of documents: assembly, merges, labels and noise.

Groups are rows of a table, and merges are aggregations and joins over it, so there may be many. The order assemble, merge by terms, label, merge by label, rank,
noise is part of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.words import RELEVANCE_STOPWORDS
from . import graph as G
from . import rank as R
from . import terms as T

NOISE_LABEL = "Unassigned responses"


def summaries(docs: DataFrame, group: str = "community", top: int = 6, tie: str = "first_seen", examples: int = 3) -> DataFrame:
    """One row per group: count, share, terms, strengths, label, comment, example rows; most documents first.

    docs: group column, row_number, fragment_no, text. Group -1 is noise.
    """
    best = G.written(T.best_ngrams(docs, [group], max(top, 2), tie), "best")
    listed = F.array_sort(F.collect_list(F.when((F.col("ngram_size") == 1) & (F.col("rank") <= top), F.struct("rank", "term", "n"))))
    g = T.phrase(best, [group], listed.alias("t"), F.max(F.when(F.col("ngram_size") == 0, F.col("n"))).alias("count"))
    total = best.where("ngram_size = 0").agg(F.sum("n")).first()[0] or 0
    g = g.withColumn("total_documents", F.lit(total).cast("long"))
    g = g.select(
        group,
        "count",
        "total_documents",
        F.bround(F.col("count") / F.col("total_documents"), 4).alias("share"),
        F.transform("t", lambda x: x["term"]).alias("terms"),
        F.transform("t", lambda x: F.bround(x["n"] / F.get("t", F.lit(0))["n"], 4)).alias("strengths"),
        F.when(F.col(group).cast("string") == "-1", NOISE_LABEL).when(F.col("phrase") != "", X.topic_label(F.col("phrase"))).otherwise(F.concat(F.lit("Community "), F.col(group).cast("string"))).alias("label"),
    )
    shown = R.examples(docs, g.select(group, "terms"), [group], examples)
    shown = shown.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_number"))), lambda x: x["row_number"]).alias("example_rows"))
    g = g.join(shown, group, "left").withColumn("example_rows", F.coalesce("example_rows", F.array().cast("array<bigint>")))
    return g.withColumn("comment", X.group_comment(F.col("label"), F.col("count"), F.col("total_documents"), F.col("example_rows")))


def records(groups: DataFrame, group: str = "community") -> DataFrame:
    """What merges work on, of summaries(): id, label, count, terms, strengths (of structs term, strength), noise, ai."""
    pairs = F.zip_with("terms", "strengths", lambda t, s: F.struct(t.alias("term"), s.alias("strength")))
    return groups.select(F.col(group).alias("id"), "label", "count", "terms", pairs.alias("strengths"), (F.col(group) == -1).alias("noise"), F.lit(False).alias("ai"))


def place(noise_last: bool) -> Column:
    """The order of groups: most documents first; ids compare as texts."""
    parts = [(-F.col("count")).alias("c"), F.col("id").cast("string").alias("i")]
    return F.struct(*([F.col("noise").alias("n")] if noise_last else []), *parts)


def signature() -> Column:
    """The two strongest terms, folded and in order; null for noise and for fewer than two terms."""
    strength = lambda t: F.coalesce(F.try_element_at(F.filter("strengths", lambda x: x["term"] == t), F.lit(-1))["strength"], F.lit(0.0))
    ranked = F.array_sort(F.transform(F.filter("terms", lambda t: X.strip(t) != ""), lambda t: F.struct((-strength(t)).alias("s"), F.array_position("terms", t).alias("i"), t.alias("t"))))
    two = F.array_sort(F.transform(F.slice(ranked, 1, 2), lambda x: X.fold(x["t"])))
    return F.when((F.size(two) == 2) & ~F.col("noise"), two)


def merged(groups: DataFrame, order: Column) -> DataFrame:
    """The groups of each `to` as one: id, label and noise of the first, counts added up, terms in order of appearance, strengths weighted by counts and scaled to the strongest.

    A group alone stays as it is. All steps are aggregations by set, and by set and term.
    """
    g = groups.withColumn("__at", order)
    sets = g.groupBy("to").agg(F.min(F.struct("__at", "id", "label", "noise", "terms", "strengths")).alias("f"), F.sum("count").alias("count"), F.count("*").alias("parts"), F.bool_or("ai").alias("ai"))
    several = g.join(sets.where("parts > 1").select("to"), "to")
    seen = several.select("to", "__at", F.posexplode("terms").alias("pos", "term")).groupBy("to", X.fold(F.col("term")).alias("folded")).agg(F.min(F.struct("__at", "pos", "term")).alias("s")).select("to", "s.*")
    weights = several.select("to", "count", F.explode("strengths").alias("x")).groupBy("to", F.col("x.term").alias("term")).agg(F.sum(F.col("x.strength") * F.greatest(F.lit(1), "count")).alias("weight"))
    made = seen.join(weights, ["to", "term"], "left").groupBy("to").agg(F.array_sort(F.collect_list(F.struct("__at", "pos", "term", "weight"))).alias("t"), F.max("weight").alias("top"))
    scaled = F.transform(F.filter("t", lambda x: x["weight"] > 0), lambda x: F.struct(x["term"].alias("term"), F.bround(x["weight"] / F.col("top"), 4).alias("strength")))
    made = made.select("to", F.transform("t", lambda x: x["term"]).alias("__terms"), scaled.alias("__strengths"))
    return sets.join(made, "to", "left").select("f.id", "f.label", "count", F.coalesce("__terms", "f.terms").alias("terms"), F.coalesce("__strengths", "f.strengths").alias("strengths"), "f.noise", "ai")


def merge_by_terms(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of one signature become the largest of them; noise and groups of fewer than two terms stay. Groups, and (id, to) of those with a signature."""
    signed = groups.withColumn("signature", signature())
    firsts = signed.where("signature is not null").groupBy("signature").agg(F.min_by("id", place(False)).alias("to"))
    placed = G.written(signed.join(firsts, "signature", "left").withColumn("to", F.coalesce("to", "id")), "signed")
    return merged(placed.drop("signature"), place(False)), placed.where("signature is not null").select("id", "to")


def label_keys() -> Column:
    """What a group can share with another: its label, or the group itself where that is blank, and the label's runs of two and three words."""
    label = X.collapse(X.fold(F.coalesce(F.col("label"), F.lit(""))))
    stop = sorted(set(RELEVANCE_STOPWORDS) - {"too"})
    words = F.filter(F.regexp_extract_all(label, F.lit("[a-z0-9]+"), 0), lambda w: (F.char_length(w) > 2) & ~w.isin(stop))
    runs = F.transform(F.concat(X.ngrams(words, 2), X.ngrams(words, 3)), lambda r: F.concat(F.lit("words "), r))
    own = F.concat(F.lit("label "), F.when(label == "", F.col("id").cast("string")).otherwise(label))
    return F.array_distinct(F.concat(F.array(own), runs))


def merge_by_label(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with the same label or a common two- or three-word run, noise among itself; the first of each set names it. Groups, and (id, to) of all.

    Groups and keys are a bipartite graph; every key hangs its groups on the least of them, and sets are the components.
    """
    groups = G.written(groups, "groups")
    keyed = groups.select("id", "noise", F.explode(label_keys()).alias("key"))
    least = keyed.groupBy("noise", "key").agg(F.min("id").alias("src"))
    edges = keyed.join(least, ["noise", "key"]).where("src <> id").select("src", F.col("id").alias("dst")).distinct()
    sets = groups.join(G.components(edges, groups.select(F.col("id").alias("node"))).withColumnRenamed("node", "id"), "id")
    firsts = sets.groupBy("component").agg(F.min_by("id", place(True)).alias("to"))
    placed = G.written(sets.join(firsts, "component").drop("component"), "sets")
    return merged(placed, place(True)), placed.select("id", "to")


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, to): where each id ends after both merges."""
    half = first.select("id", F.col("to").alias("mid")).unionByName(second.join(first.select("id"), "id", "left_anti").select("id", F.col("id").alias("mid")))
    return half.join(second.select(F.col("id").alias("mid"), "to"), "mid", "left").select("id", F.coalesce("to", "mid").alias("to"))


def relabelled(docs: DataFrame, aliases: DataFrame, group: str = "community") -> DataFrame:
    """Documents with their groups' final ids."""
    return docs.join(aliases.select(F.col("id").alias(group), F.col("to").alias("__to")), group, "left").withColumn(group, F.coalesce("__to", group)).drop("__to")


def topics_frame(groups: DataFrame, group: str = "community") -> DataFrame:
    return groups.where(~F.col("noise")).select(F.col("id").alias(group), "label", "terms")


def noise_moved(docs: DataFrame, topics: DataFrame, group: str = "community") -> DataFrame:
    """F11 on data: documents with `community` -1 where they are off their group's topic; others keep theirs."""
    judged = R.off_topic(docs.where(F.col(group) != -1), topics, [group])
    moved = judged.select("row_number", "fragment_no", F.when(F.col("off_topic"), F.lit(-1).cast("long")).otherwise(F.col(group)).alias(group))
    rest = docs.select("row_number", "fragment_no", group).join(judged.select("row_number", "fragment_no"), ["row_number", "fragment_no"], "left_anti")
    placed = moved.unionByName(rest)
    return docs.drop(group).join(placed, ["row_number", "fragment_no"])


def evidence(docs: DataFrame, group: str = "community", most: int = 50, chars: int = 220) -> DataFrame:
    """Group, texts: the n-grams of each group and its first `most` responses, collapsed and cut, in order of their kind and text. A row a group, of at most `most` + 11 texts."""
    at = F.row_number().over(Window.partitionBy(group).orderBy("row_number", "fragment_no"))
    text = X.rstrip(F.substring(X.collapse(F.col("text")), 1, max(80, chars)))
    first = docs.withColumn("__p", at).where(F.col("__p") <= most).select(group, text.alias("t"), F.lit(1).alias("k"))
    for n, top in ((1, 5), (2, 3), (3, 3)):
        first = first.unionByName(T.evidence_ngrams(docs, n, [group], top).select(group, F.col("term").alias("t"), F.lit(0).alias("k")))
    return first.where("t <> ''").groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("texts"))


Labeler = Callable[[DataFrame, DataFrame], DataFrame]  #: groups and documents to (id, label)


def analyse(docs: DataFrame, group: str = "community", labeler: Labeler | None = None, top: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps 6 to 11: documents with final groups and ranks, the groups, and the aliases (id, to)."""
    groups, by_terms = merge_by_terms(records(summaries(docs, group, top), group))
    if labeler is not None:
        groups = G.written(groups, "groups")
        named = labeler(groups, relabelled(docs, by_terms, group)).select("id", F.col("label").alias("__label"))
        fresh = (F.col("__label") != "") & (F.col("__label") != F.col("label"))
        groups = groups.join(named, "id", "left").withColumns({"ai": F.col("ai") | F.coalesce(fresh, F.lit(False)), "label": F.when(fresh, F.col("__label")).otherwise(F.col("label"))}).drop("__label")
    groups, by_label = merge_by_label(groups)
    groups = G.written(groups, "groups")
    aliases = composed(by_terms, by_label)
    topics = topics_frame(groups, group)
    placed = noise_moved(relabelled(docs, aliases, group), topics, group)
    ranked = R.label_relevance(placed, topics, [group]).select("row_number", "fragment_no", group, "text", "rank")
    noise = R.ranked(placed.where(F.col(group) == -1), [group], ["row_number", "fragment_no"]).select("row_number", "fragment_no", group, "text", "rank")
    return ranked.unionByName(noise), groups, aliases
