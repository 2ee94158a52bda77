"""From an all-string table and a manifest to one row per respondent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.manifest import VERTICAL, Manifest
from ..sources.csv_source import Table
from . import headers as H
from .graph import written


MOST_QUESTIONS = 10_000  #: questions, thus columns, of a vertical table


class TransformError(ValueError):
    pass


def q(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def needed_columns(m: Manifest) -> list[int]:
    """The positions that the manifest reads."""
    a = m.assembly
    wanted = {*m.metadata, *m.verbatim} | ({*a.keys, *a.questions, a.answer} if m.layout == VERTICAL else set())
    return sorted(i for i in wanted if i >= 0)


def scoped(table: Table, m: Manifest) -> DataFrame:
    """Only the needed columns, both cleaning passes applied; every row keeps its number."""
    columns = needed_columns(m)
    if missing := [i for i in columns if i >= len(table.headers)]:
        raise TransformError(f"column positions {missing} are not in the table")
    return table.frame.select("row_number", *[X.clean_cell(F.col(f"c{i}"), m.nulls).alias(f"c{i}") for i in columns])


def drop_invalid(df: DataFrame, keys: Sequence[str], question: str, answer: str) -> DataFrame:
    """rows that have all keys, a question and an answer."""
    return df.dropna("any", subset=[*keys, question, answer])


def last_answers(df: DataFrame, keys: Sequence[str], question: str, answer: str, order: str) -> DataFrame:
    """The last answer of each key and question; one aggregation, combined before the shuffle."""
    return df.groupBy(*map(q, keys), q(question)).agg(F.max_by(q(answer), q(order)).alias(answer))


def first_values(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """The first value that isn't null of each column per key (null keys are a key), and the first row's number."""
    found = [F.min_by(q(v), F.when(q(v).isNotNull(), q(order))).alias(v) for v in values]
    return df.groupBy(*map(q, keys)).agg(*found, F.min(order).alias(order))


def pivot_answers(df: DataFrame, keys: Sequence[str], question: str, answer: str, questions: Sequence[str]) -> DataFrame:
    """One column per question; the list is given, so no job is needed to find it."""
    return df.groupBy(*map(q, keys)).pivot(question, list(questions)).agg(F.first(q(answer)))


def drop_empty(df: DataFrame, verbatim: Sequence[str]) -> DataFrame:
    """rows with at least one verbatim value; all rows where there is no verbatim column."""
    return df.where(F.coalesce(*map(q, verbatim)).isNotNull()) if verbatim else df


def merge_parts(df: DataFrame, merged: Sequence[H.Merged], order: str = "row_number") -> DataFrame:
    """P07 on data: parts joined left to right, nulls and blanks skipped."""

    def combined(m: H.Merged) -> Column:
        if len(m.sources) == 1:
            return q(m.sources[0]).alias(m.name)
        joined = F.concat_ws(m.separator, *[X.strip(X.blank_to_null(q(s))) for s in m.sources])
        return F.when(joined != "", joined).alias(m.name)

    return df.select(q(order), *[combined(m) for m in merged])


def wide(table: Table, m: Manifest) -> tuple[DataFrame, list[str]]:
    """Metadata columns, then the verbatim columns that aren't metadata."""
    verbatim = [i for i in m.verbatim if i not in m.metadata]
    columns = [*m.metadata, *verbatim]
    if not columns:
        raise TransformError("the manifest selects no columns")
    clean = scoped(table, m)
    names = [H.output_name(table.headers[i], i) for i in columns]
    return clean.select("row_number", *[F.col(f"c{i}").alias(n) for i, n in zip(columns, names)]), names[: len(m.metadata)]


def vertical(table: Table, m: Manifest) -> tuple[DataFrame, list[str]]:
    """One row per record key: consolidated metadata, left-joined with the pivoted last answers.

    The distinct questions are the one thing that must be known before the plan is complete. More than MOST_QUESTIONS
    are an error: then a column of free text was taken for the question.
    """
    a = m.assembly
    clean = scoped(table, m)
    name = {i: H.output_name(table.headers[i], i) for i in {*m.metadata, *a.keys}}
    keys = [name[i] for i in a.keys]
    values = [name[i] for i in m.metadata if i not in a.keys]
    records = clean.select("row_number", *[F.col(f"c{i}").alias(name[i]) for i in a.keys], F.coalesce(*[X.usable_title(F.col(f"c{i}")) for i in a.questions]).alias("question"), F.col(f"c{a.answer}").alias("answer"))
    answers = last_answers(drop_invalid(records, keys, "question", "answer"), keys, "question", "answer", "row_number")
    people = first_values(clean.select("row_number", *[F.col(f"c{i}").alias(n) for i, n in name.items()]), keys, values, "row_number")
    questions = sorted(r[0] for r in answers.select("question").distinct().limit(MOST_QUESTIONS + 1).collect())
    if len(questions) > MOST_QUESTIONS:
        raise TransformError(f"more than {MOST_QUESTIONS} questions: the question column holds free text")
    metadata = [name[i] for i in m.metadata]
    wide_answers = pivot_answers(answers, keys, "question", "answer", questions)
    clashing = {n: (n if n not in {"row_number", *metadata} else f"{n} (question)") for n in questions}
    wide_answers = wide_answers.select(*map(q, keys), *[q(n).alias(clashing[n]) for n in questions])
    joined = people.join(wide_answers, keys, "left")
    return joined.select("row_number", *map(q, metadata), *[q(clashing[n]) for n in questions]), metadata


def transform(table: Table, m: Manifest) -> tuple[DataFrame, list[str]]:
    """The whole ingest: assembled, parts merged, headers cleaned and ordered, empty rows dropped, rows renumbered.

    Returns the table (row_number first) and its metadata columns. A row limit is enforced only where
    the manifest sets one.
    """
    df, metadata = (vertical if m.layout == VERTICAL else wide)(table, m)
    columns = [c for c in df.columns if c != "row_number"]
    merged = H.multipart(columns, metadata)
    df = merge_parts(df, merged)
    named = H.families([x.name for x in merged], metadata)
    df = df.select("row_number", *[q(c).alias(n) for c, n in named])
    df = drop_empty(df, [n for _, n in named if n not in metadata])
    if m.row_limit is not None and df.limit(m.row_limit + 1).count() > m.row_limit:
        raise TransformError(f"the table has more than {m.row_limit} rows")
    return df, metadata


def renumber(df: DataFrame) -> DataFrame:
    """Consecutive row numbers in the old ones' order: rows are sorted in ranges and written once, so that a range's size and the places
    within it are of the same ranges; a row's number is its place and the rows in the ranges before."""
    ordered = df.repartitionByRange("row_number").sortWithinPartitions("row_number").withColumn("__id", F.monotonically_increasing_id())
    inside = written(ordered, "renumbered").withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1) + 1})
    sizes = inside.groupBy("__part").agg(F.count("*").alias("__size"))  # a row a range
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inside.join(F.broadcast(before), "__part").withColumn("row_number", (F.col("__before") + F.col("__at")).cast("long")).drop("__id", "__part", "__at", "__before")
