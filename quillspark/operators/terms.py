"""Terms and n-grams, with counts, documents and stable tie-breaks.

All operators take a fragment table: row_number, fragment_no, text, and a group column where one is named.
Ties go to the first occurrence (`first_seen`) or to the term in order (`term`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.words import LEADING_TRIM, STOPWORDS, TRAILING_TRIM
from .graph import join_groups


def prepare(df: DataFrame, text: str, keep: Sequence[str] = (), order: str = "row_number", most: int | None = 3000) -> DataFrame:
    """row_number, fragment_no, text, original_text of every usable answer's fragments. most: characters kept (X10); None keeps whole answers."""
    said = X.answer(F.col(f"`{text}`"))
    usable = df.select(F.col(order).alias("row_number"), *keep, (said if most is None else X.capped(said, most)).alias("original_text"))
    usable = usable.where(F.col("original_text").isNotNull() & ~X.is_single_word(F.col("original_text")))
    split = usable.select("row_number", *keep, "original_text", F.posexplode(X.fragments(F.col("original_text"))).alias("fragment_no", "text"))
    return split.select("row_number", "fragment_no", *keep, "text", "original_text")


def usable_responses(df: DataFrame, text: str) -> DataFrame:
    """A22 and the preparation's counts: total, placeholders, single words, and answers to analyse."""
    t = X.answer(F.col(f"`{text}`"))
    single = F.coalesce(X.is_single_word(t), F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(t.isNull()).alias("empty_or_placeholder"), F.count_if(single).alias("single_word"), F.count_if(t.isNotNull() & ~single).alias("analysed"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row with the number of texts that differ once folded."""
    return docs.agg(F.count_distinct(X.fold(F.col("text"))).alias("documents"))


def occurrences(docs: DataFrame, n: int, group: Sequence[str] = (), stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """One row per occurrence: group columns, row_number, fragment_no, pos, term."""
    if "tokens" not in docs.columns:
        docs = docs.withColumn("tokens", X.tokens(F.col("text"), stopwords))
    return docs.select(*group, "row_number", "fragment_no", F.posexplode(X.ngrams(F.col("tokens"), n) if n > 1 else F.col("tokens")).alias("pos", "term"))


def ngram_counts(docs: DataFrame, n: int, group: Sequence[str] = (), stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """Group columns, term, n (occurrences), documents (fragments that have it), first (its first place).

    A fragment's terms are sorted within its row, so the first of equal ones is known there and one aggregation,
    combined before its shuffle, counts both occurrences and fragments.
    """
    if "tokens" not in docs.columns:
        docs = docs.withColumn("tokens", X.tokens(F.col("text"), stopwords))
    made = X.ngrams(F.col("tokens"), n) if n > 1 else F.col("tokens")
    placed = docs.select(*group, "row_number", "fragment_no", F.array_sort(F.transform(made, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))).alias("s"))
    lead = lambda x, i: F.struct(x["term"].alias("term"), x["pos"].alias("pos"), ((i == 0) | (F.get("s", i - 1)["term"] != x["term"])).cast("int").alias("lead"))
    each = placed.select(*group, "row_number", "fragment_no", F.explode(F.transform("s", lead)).alias("o")).select(*group, "row_number", "fragment_no", "o.*")
    return each.groupBy(*group, "term").agg(F.count("*").alias("n"), F.sum("lead").alias("documents"), F.min(F.struct("row_number", "fragment_no", "pos")).alias("first"))


def ranked(counts: DataFrame, group: Sequence[str] = (), tie: str = "first_seen", by: Sequence[Column] = ()) -> DataFrame:
    order = [*by, F.desc("n")] + (["first"] if tie == "first_seen" else []) + ["term"]
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)))


def top_ngrams(docs: DataFrame, n: int, top: int = 12, tie: str = "first_seen", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """The top terms with occurrence and document counts; a bounded sort, not a global window."""
    order = [F.desc("n")] + (["first"] if tie == "first_seen" else []) + ["term"]
    return ngram_counts(docs, n, (), stopwords).orderBy(*order).limit(top).select(F.lit(n).alias("ngram_size"), "term", "n", "documents")


def top_terms(docs: DataFrame, group: Sequence[str], top: int = 6, tie: str = "first_seen", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """Per group the top terms, their counts and strengths (count over the group's highest, 4 places)."""
    best = ranked(ngram_counts(docs, 1, group, stopwords), group, tie).where(f"rank <= {top}")
    highest = F.max("n").over(Window.partitionBy(*group))
    return best.select(*group, "rank", "term", "n", F.bround(F.col("n") / highest, 4).alias("strength"))


def ngram_documents(docs: DataFrame, n: int, terms: DataFrame) -> DataFrame:
    """The fragments of each given term, one row each: term, row_number, fragment_no, text."""
    having = join_groups(occurrences(docs, n), terms.select("term").distinct(), ["term"]).select("term", "row_number", "fragment_no").distinct()
    return having.join(docs.select("row_number", "fragment_no", "text"), ["row_number", "fragment_no"]).select("term", "row_number", "fragment_no", "text")


def best_ngrams(docs: DataFrame, group: Sequence[str], top: int, tie: str = "first_seen", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """Per group its size and its best n-grams of one, two and three words: group columns, ngram_size, rank, term, n.

    One scan cuts each text once, and one aggregation counts all sizes. The row of ngram_size 0 holds the group's documents. Single
    words go down to rank `top`; of two and three words there is the best, if it occurs twice.
    """
    if "tokens" not in docs.columns:
        docs = docs.withColumn("tokens", X.tokens(F.col("text"), stopwords))
    each = docs.select(*group, "row_number", "fragment_no", "tokens", F.posexplode_outer("tokens").alias("pos", "one"))
    after = lambda i: F.get("tokens", F.col("pos") + i)
    two = F.concat("one", F.lit(" "), after(1))
    grams = [F.when(F.coalesce("pos", F.lit(0)) == 0, ""), F.col("one"), two, F.concat(two, F.lit(" "), after(2))]  # null where a text has no more words
    each = each.select(*group, "row_number", "fragment_no", "pos", F.posexplode(F.array(*grams)).alias("ngram_size", "term")).where("term is not null")
    found = [F.count("*").alias("n")] + ([F.min(F.struct("row_number", "fragment_no", "pos")).alias("first")] if tie == "first_seen" else [])
    counts = each.groupBy(*group, "ngram_size", "term").agg(*found).where("ngram_size < 2 or n >= 2")
    return ranked(counts, [*group, "ngram_size"], tie).where(f"rank <= {top} and (rank = 1 or ngram_size = 1)").select(*group, "ngram_size", "rank", "term", "n")


def phrase(best: DataFrame, group: Sequence[str], *more: Column) -> DataFrame:
    """A10 of best_ngrams(): per group the best trigram that occurs twice, else the best such bigram, else the two top terms; more: further aggregates."""
    of = lambda n: F.max(F.when(F.col("ngram_size") == n, F.col("term")))
    two = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("ngram_size") == 1) & (F.col("rank") <= 2), F.struct("rank", "term")))), lambda x: x["term"]), " ")
    return best.groupBy(*group).agg(F.coalesce(of(3), of(2), two, F.lit("")).alias("phrase"), *more)


def top_phrase(docs: DataFrame, group: Sequence[str], tie: str = "first_seen", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """A10: per group the best trigram that occurs twice, else the best such bigram, else the two top terms; none for documents without a group."""
    known = [F.col(g).isNotNull() for g in group]
    return phrase(best_ngrams(docs, group, 2, tie, stopwords), group).withColumn("phrase", F.when(reduce(and_, known), F.col("phrase")).otherwise(""))


def evidence_ngrams(docs: DataFrame, n: int, group: Sequence[str], top: int, limit: int = 120, least: int = 4, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """From each group's first documents, n-grams in at least min(4, documents) of them, most documents first."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy("row_number", "fragment_no"))
    first = docs.withColumn("__place", place).where(f"__place <= {limit}")
    sizes = first.groupBy(*group).agg(F.count("*").alias("size"))
    counts = ngram_counts(first, n, group, stopwords)
    counts = counts.where(F.size(F.array_distinct(F.split("term", " "))) == n)  # a repeated word is no n-gram of its own
    enough = counts.join(sizes, list(group)).where(F.col("documents") >= F.least(F.lit(least), F.col("size")))
    return ranked(enough, group, "term", [F.desc("documents")]).where(f"rank <= {top}").select(*group, "rank", "term", "n", "documents")


def _trimmed(words: Column) -> Column:
    """Function words cut from both ends; one word always stays."""
    drop = lambda ws, stop: F.aggregate(ws, F.array().cast("array<string>"), lambda a, w: F.when((F.size(a) == 0) & w.isin(list(stop)), a).otherwise(F.concat(a, F.array(w))))
    lead = drop(words, LEADING_TRIM)
    lead = F.when(F.size(lead) > 0, lead).otherwise(F.slice(words, -1, 1))
    tail = F.reverse(drop(F.reverse(lead), TRAILING_TRIM))
    return F.array_join(F.when(F.size(tail) > 0, tail).otherwise(F.slice(lead, 1, 1)), " ")


def context_phrases(docs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Document frequency of trimmed two- and three-word phrases found in two documents or more."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy("row_number", "fragment_no"))
    once = F.row_number().over(Window.partitionBy(*group, X.fold(F.col("text"))).orderBy("row_number", "fragment_no"))
    texts = docs.withColumn("__once", once).where("__once = 1").withColumn("__place", place).where("__place <= 120")
    words = X.evidence_tokens(F.col("text"))
    grams = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: _trimmed(F.slice("w", i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    phrases = texts.withColumn("w", words).select(*group, "row_number", "fragment_no", F.posexplode(F.array_distinct(F.concat(grams(2), grams(3)))).alias("pos", "term")).where(F.col("term").contains(" "))
    return phrases.groupBy(*group, "term").agg(F.count("*").alias("documents"), F.min(F.struct("row_number", "fragment_no", "pos")).alias("first")).where("documents >= 2")


def chosen_phrases(phrases: DataFrame, group: Sequence[str], most: int) -> DataFrame:
    """Greedily, most frequent first, phrases that neither hold nor lie within one already chosen."""
    listed = phrases.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct((-F.col("documents")).alias("d"), "first", "term"))).alias("p"))
    free = lambda held, t: ~F.exists(held, lambda h: h.contains(t) | F.contains(t, h))
    pick = F.aggregate(F.col("p"), F.array().cast("array<string>"), lambda held, x: F.when((F.size(held) < most) & free(held, x["term"]), F.concat(held, F.array(x["term"]))).otherwise(held))
    return listed.select(*group, pick.alias("phrases"))
