"""Language of a text by a model of letter triples, fitted on texts whose language is known and scored with built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .graph import written

MOST_LANGUAGES = 200
SHORTEST = 8  #: characters of the shortest text that is judged


def triples(c: Column) -> Column:
    """All runs of three characters of the lower-cased text, with everything but letters as one space, in and around it. Null: none."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", " "), F.lit(" "))
    return F.regexp_extract_all(F.regexp_replace(plain, " +", " "), F.lit("(?s)(?=(.{3}))"), 1)


@dataclass(frozen=True)
class Model:
    """table: gram and, for each language, the weight w0, w1, ...; at most `kept` rows a language."""

    table: DataFrame
    languages: tuple[str, ...]


def fit(df: DataFrame, text: str = "text", language: str = "language", kept: int = 2000) -> Model:
    """Weights 1000 * ln((count + 1) / (count of all + number of triples)) in whole numbers, over the `kept` commonest triples of each language.

    Every labelled row and whole text counts. Rows without a language or text teach nothing; without any the model knows no language. Ties among
    the commonest go to the smaller triple.
    """
    counts = df.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(triples(F.col(text))).alias("gram")).groupBy("language", "gram").agg(F.count("*").alias("n"))
    counts = written(counts, "triples")  # far fewer than characters
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    grams = counts.withColumn("rank", rank).where(F.col("rank") <= kept).select("gram").distinct()
    names = sorted(r[0] for r in counts.select("language").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"there are more than {MOST_LANGUAGES} languages")
    inside = counts.join(grams, "gram", "left_semi")
    per = inside.groupBy("gram").agg(F.lit(1).alias("__one"), *[F.coalesce(F.sum(F.when(F.col("language") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(names)])
    totals = per.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(names))])
    weights = [F.round(1000 * F.log((F.col(f"n{i}") + 1) / (F.col(f"t{i}") + F.col("v")))).cast("long").alias(f"w{i}") for i in range(len(names))]
    table = per.crossJoin(F.broadcast(totals)).select("gram", *weights)  # one row of totals
    return Model(written(table, "languages"), tuple(names))


def detected(df: DataFrame, model: Model, keys: Sequence[str], text: str = "text", name: str = "language") -> DataFrame:
    """df with the likeliest language; null for texts under eight characters and those without a triple that the model knows; ties: the smaller code.

    keys: columns that tell rows apart; rows equal in them get the language of their texts together. Only the keys and sums are shuffled.
    """
    if not model.languages:
        return df.withColumn(name, F.lit(None).cast("string"))
    long = df.where(F.char_length(X.strip(F.col(text))) >= SHORTEST)
    grams = long.select(*[F.col(k).alias(f"__{k}") for k in keys], F.explode(triples(F.col(text))).alias("gram"))
    n = len(model.languages)
    sums = grams.join(F.broadcast(model.table), "gram").groupBy(*[f"__{k}" for k in keys]).agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(n)])
    best = F.greatest(*[F.col(f"s{i}") for i in range(n)]) if n > 1 else F.col("s0")
    guess = F.coalesce(*[F.when(F.col(f"s{i}") == best, F.lit(x)) for i, x in enumerate(model.languages)])
    found = sums.select(*[f"__{k}" for k in keys], guess.alias("__language"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    clear = F.when(F.char_length(X.strip(F.col(text))) >= SHORTEST, F.col("__language"))
    return df.join(found, on, "left").withColumn(name, clear).select(*[c for c in df.columns if c != name], name)
