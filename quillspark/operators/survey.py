"""Long survey exports: titles, coverage, pivots and backfills. The long form is the canonical one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

KEYS = ("user_id", "country", "country_group", "country_tier", "career_category", "career_group")
MISSING_TITLE, MISSING_MAIN = "__MISSING_TITLE__", "__MISSING_MAIN__"


def is_blank(c: Column) -> Column:
    return c.isNull() | (X.strip(c.cast("string")) == "")


def filled(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def prepared(df: DataFrame) -> DataFrame:
    """Whole-number user ids (null where they aren't), title fallbacks, normalised title columns."""
    number = F.expr("try_cast(user_id AS double)")
    df = df.withColumn("user_id", F.when(number == F.floor(number), number.cast("long")))
    df = df.withColumn("full_title", F.coalesce(filled(F.col("full_title")), filled(F.col("main_title")), F.lit(MISSING_TITLE)))
    df = df.withColumn("main_title", F.coalesce(filled(F.col("main_title")), F.lit(MISSING_MAIN)))
    return df.withColumns({"main_title_norm": X.clean(F.col("main_title")), "full_title_norm": X.clean(F.col("full_title"))})


def answers_long(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "row_number") -> DataFrame:
    """P18 in long form: the last answer that isn't null per key, main and full title; rows with a null key have no place."""
    keys = [k for k in keys if k in df.columns]
    known = df.dropna("any", subset=keys).where("answer_value IS NOT NULL")
    return known.groupBy(*keys, "main_title_norm", "full_title_norm").agg(F.max_by("answer_value", order).alias("answer"))


def answers_wide(long: DataFrame, titles: Sequence[tuple[str, str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """P18 for export: one column `main | full` per given pair of titles."""
    keys = [k for k in keys if k in long.columns]
    label = F.concat_ws(" | ", "main_title_norm", "full_title_norm")
    return long.groupBy(*keys).pivot("__label", [" | ".join(t) for t in titles]).agg(F.first("answer")) if "__label" in long.columns else answers_wide(long.withColumn("__label", label), titles, keys)


def select_questions(long: DataFrame, titles: Sequence[str]) -> DataFrame:
    """F05."""
    wanted = long.sparkSession.createDataFrame([(t,) for t in titles], "t string").select(X.clean(F.col("t")).alias("main_title_norm")).distinct()
    return long.join(wanted, "main_title_norm", "left_semi")


def question_records(long: DataFrame, title: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys, full_title and text of one question; answers that say nothing are left out."""
    keys = [k for k in keys if k in long.columns]
    text = X.strip(F.col("answer"))
    here = long.where(F.col("main_title_norm") == X.clean(F.lit(title)))
    return here.select(*keys, F.col("full_title_norm").alias("full_title"), text.alias("text")).where(~F.lower("text").isin("", "nan", "<na>", "none"))


def question_texts(long: DataFrame, title: str) -> DataFrame:
    """P20: user_id, full_title and text; only empty texts and `nan` are left out."""
    here = long.where(F.col("main_title_norm") == X.clean(F.lit(title)))
    return here.select("user_id", F.col("full_title_norm").alias("full_title"), X.strip(F.col("answer")).alias("text")).where(~F.col("text").isin("", "nan"))


def backfill(records: DataFrame, source: DataFrame, on: Sequence[str] = ("user_id", "full_title", "text"), columns: Sequence[str] = ("career_group", "career_category")) -> DataFrame:
    """Blank columns take the source's value for the same keys; the source counts each key once."""
    on = [k for k in on if k in records.columns and k in source.columns]
    taken = [c for c in columns if c in source.columns]
    if not on or not taken:
        return records
    once = source.groupBy(*on).agg(*[F.min(c).alias(f"__{c}") for c in taken])
    have = records.select(*records.columns, *[F.lit(None).cast("string").alias(c) for c in taken if c not in records.columns])
    joined = have.join(once, list(on), "left")
    return joined.withColumns({c: F.coalesce(filled(F.col(c)), F.col(f"__{c}")) for c in taken}).drop(*[f"__{c}" for c in taken])


def coverage(df: DataFrame, user: str = "user_id", answer: str = "answer_value") -> DataFrame:
    """One row: total_rows, total_users, users_with_any_answer, users_with_no_answers."""
    per = df.groupBy(user).agg(F.count("*").alias("n"), F.max((~is_blank(F.col(answer))).cast("int")).alias("any"))
    known = F.col(user).isNotNull()
    users, answered = F.count_if(known), F.count_if(known & (F.col("any") == 1))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), users.alias("total_users"), answered.alias("users_with_any_answer"), (users - answered).alias("users_with_no_answers"))
