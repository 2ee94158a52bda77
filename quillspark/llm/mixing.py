"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed into cells (source, lang, topic). Each sweep scales the cells so that each
margin in turn meets its target; after the sweeps a cell's factor (fitted over present weight), divided
by the largest factor, is the probability with which its documents are kept, so expected token shares
are the targets on every margin. The draw compares the probability with a hash of doc_id.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, join_by_size, materialise, text_or_empty

MARGINS = ("source", "lang", "topic")
SWEEPS, PER_JOB = 20, 5
MOST_CELLS = 100_000  #: cells whose probabilities are broadcast to sample()
TOLERANCE = 1e-3  #: residual of a margin above which rake() warns


def n_words(text: str = "text") -> Column:
    """Words of a text, each put down as one byte: regexp_count() would hold a list of all words, many times the text's size."""
    dots = F.regexp_replace(F.ltrim(text_or_empty(text), F.lit(SPACES)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", ".")
    return F.octet_length(dots).cast("long")


def n_signs(t: Column, signs: str) -> Column:
    """How often any of the ASCII signs is in t, by bytes: translate() would make a string of each character."""
    rest = t
    for s in signs:
        rest = F.replace(rest, F.lit(s), F.lit(""))
    return F.octet_length(t) - F.octet_length(rest)


def form_topic(words: Column, text: str = "text") -> Column:
    """A topic by form, for tables without a topic column: tabular, symbolic, or prose by length."""
    t = text_or_empty(text)
    return F.when(n_signs(t, "|") * 10 > words, "tabular").when(n_signs(t, "#$%&*") * 4 > words, "symbolic").when(words < 100, "note").when(words < 600, "article").otherwise("essay")


def tempered(cells: DataFrame, margin: str, temperature: float) -> DataFrame:
    """Targets of a margin: token shares to the power temperature, scaled to sum to 1."""
    shares = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t"))
    powered = shares.select(margin, F.pow("t", F.lit(temperature)).alias("target"))
    whole = powered.agg(F.sum("target")).first()[0]
    return powered.select(margin, F.try_divide("target", F.lit(whole).cast("double")).alias(f"{margin}_target"))


def given(cells: DataFrame, margin: str, weights: Mapping[str, float]) -> DataFrame:
    """Targets of a margin from weights by value, scaled to sum to 1 over the values present; values without a weight get 0."""
    table = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], f"{margin} string, target double")
    present = cells.select(margin).distinct().join(table, margin, "left").select(margin, F.coalesce("target", F.lit(0.0)).alias("target"))
    whole = present.agg(F.sum("target")).first()[0]
    if not whole and weights:
        raise ValueError(f"no value of {margin} has a weight")
    return present.select(margin, F.try_divide("target", F.lit(whole).cast("double")).alias(f"{margin}_target"))


def residual(fitted: DataFrame, margins: Sequence[str]) -> float:
    """The largest difference of a margin's fitted share from its target."""
    worst = 0.0
    for m in margins:
        share = fitted.groupBy(m, f"{m}_target").agg(F.sum("fitted").alias("s"))
        worst = max(worst, share.agg(F.max(F.abs(F.col("s") - F.col(f"{m}_target")))).first()[0] or 0.0)
    return worst


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with `fitted`: weights whose sums over each margin are the margin's targets (they total 1).

    targets: for each margin column a DataFrame (margin, <margin>_target); a value without one has the target 0. Cells without
    tokens stay at 0. Targets that no weights of the present cells can meet, or that so many sweeps don't bring within tolerance, are
    met as nearly as the last sweep does, with a warning that names the residual.
    """
    for m, t in targets.items():
        cells = cells.join(t, m, "left").withColumn(f"{m}_target", F.coalesce(f"{m}_target", F.lit(0.0)))
    cells = materialise(cells.withColumn("fitted", F.col("tokens").cast("double")), "cells")
    for s in range(sweeps):
        for m in targets:
            whole = F.sum("fitted").over(Window.partitionBy(m))
            cells = cells.withColumn("fitted", F.when(whole > 0, F.col("fitted") * F.col(f"{m}_target") / whole).otherwise(0.0))
        if (s + 1) % PER_JOB == 0 or s + 1 == sweeps:
            cells = materialise(cells, "cells")
    off = residual(cells, list(targets))
    if off > tolerance and cells.where("tokens > 0").count():
        warnings.warn(f"margins are off their targets by up to {off:.2g} after {sweeps} sweeps", stacklevel=2)
    return cells


def draw(seed: str) -> Column:
    """A number in [0, 1) that doc_id and seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cells_of(docs: DataFrame, words: Column) -> list[Column]:
    """The cell of a row of docs, a column for each margin."""
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else form_topic(words)
    return [F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic.alias("topic")]


def cell_chances(rows: DataFrame, temperature: float, sweeps: int, targets: Mapping[str, Mapping[str, float]] | None) -> DataFrame:
    """A row for each cell of rows (source, lang, topic, n_tokens): its probability, and its number of rows as `members`."""
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("members"))
    wanted = targets or {}
    fitted = rake(cells, {m: given(cells, m, wanted[m]) if m in wanted else tempered(cells, m, temperature) for m in MARGINS}, sweeps)
    factors = fitted.select(*MARGINS, "members", F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).alias("factor"))
    top = factors.agg(F.max("factor")).first()[0]
    return factors.select(*MARGINS, "members", F.coalesce(F.bround(F.try_divide("factor", F.lit(top).cast("double")), 9), F.lit(1.0)).alias("probability"))


def mix(docs: DataFrame, temperature: float = 0.8, sweeps: int = SWEEPS, seed: str = "mix", targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Every row of docs: doc_id, source, lang, topic, n_tokens, probability, kept.

    Tokens are white-space words. targets: weights by value for any of the margins source, lang and topic; values without a
    weight are left out of the mix. Targets of the other margins are the tempered token shares.
    Null sources and languages are a value of their own, written as the empty string. Rows without
    words have probability 1 where their cell has no tokens, else their cell's. Rows with the same doc_id
    and cell share their fate. An empty table gives an empty result. Of extra columns only `topic` has an
    effect: where present it is used.
    """
    rows = docs.withColumn("__n", n_words())
    rows = rows.select("doc_id", *_cells_of(docs, F.col("__n")), F.col("__n").alias("n_tokens"))
    rows = materialise(rows, "rows")  # numbers and labels only
    chances = cell_chances(rows, temperature, sweeps, targets).drop("members")
    return rows.join(chances, list(MARGINS)).withColumn("kept", draw(seed) < F.col("probability"))


def sample(docs: DataFrame, temperature: float = 0.8, sweeps: int = SWEEPS, seed: str = "mix", targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The rows of docs, all columns, that mix() keeps.

    Every row is judged by its own cell's probability, so rows of one doc_id in different cells part as mix() says. Up to
    MOST_CELLS cells are broadcast with their probabilities; of more, only the cells with many rows are, and rows of the others are
    shuffled by cell. Nulls, repeated rows and empty tables as in mix().
    """
    rows = docs.withColumn("__n", n_words())
    rows = rows.withColumns({f"__{m}": c for m, c in zip(MARGINS, _cells_of(rows, F.col("__n")))})
    keys = [f"__{m}" for m in MARGINS]
    counted = rows.select(*(F.col(f"__{m}").alias(m) for m in MARGINS), F.col("__n").alias("n_tokens"))
    counted = materialise(counted, "rows")  # numbers and labels only; the cells are summed up from them several times
    chances = cell_chances(counted, temperature, sweeps, targets).select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("members").alias("__members"), F.col("probability").alias("__probability"))
    chances = materialise(chances, "chances")
    if chances.count() <= MOST_CELLS:
        judged = rows.join(F.broadcast(chances), keys)
    else:
        judged = join_by_size(rows, chances, keys, size="__members")
    return judged.where(draw(seed) < F.col("__probability")).select(*docs.columns)
