"""Facets: filterable metadata values, and equality filters on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import headers as H
from .assembly import q

MOST_VALUES, RATIO, RATIO_FROM = 120, 0.45, 25


def value_counts(df: DataFrame, columns: Sequence[str], order: str = "row_number") -> DataFrame:
    """Column, value, n, first_seen of all values that aren't blank; values keep their spaces."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns])).alias("cell")
    long = df.select(q(order).alias("o"), cells).select("o", "cell.*").where(X.strip(F.col("value")) != "")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("o").alias("first_seen"))


def definitions(df: DataFrame, columns: Sequence[str], order: str = "row_number") -> DataFrame:
    """the value counts of columns fit for a filter: 2 to 120 values, not nearly unique, no response or user id."""
    usable = [c for c in columns if H.filterable(c)]
    counts = value_counts(df, usable, order)
    totals = counts.groupBy("column").agg(F.count("*").alias("values"), F.sum("n").alias("rows"))
    fit = totals.where(F.col("values").between(2, MOST_VALUES) & ((F.col("values") < RATIO_FROM) | (F.col("values") / F.col("rows") <= RATIO)))
    names = F.create_map(*[F.lit(x) for c in usable for x in (c, H.display_name(c))])
    place = F.row_number().over(Window.partitionBy("column").orderBy("first_seen", "value"))
    return counts.join(fit.select("column"), "column").select("column", names[F.col("column")].alias("display_name"), "value", "n", place.alias("place"))


def apply_filters(df: DataFrame, filters: Mapping[str, Sequence[str]] | None, allowed: Sequence[str] | None = None) -> DataFrame:
    """rows whose value in every column is one of those asked for, exactly; blank requests count as none."""
    for column, values in (filters or {}).items():
        if allowed is not None and column not in allowed or column not in df.columns:
            raise ValueError(f"unknown filter column {column!r}")
        if wanted := sorted({v for v in values if v is not None and v.strip()}):
            df = df.where(q(column).cast("string").isin(wanted))
    return df


def by_country(df: DataFrame, country: str | None, column: str = "country") -> DataFrame:
    """F04."""
    if not country or not country.strip():
        return df
    if column not in df.columns:
        raise ValueError(f"there is no column {column!r} to filter by")
    return df.where(X.fold(X.strip(q(column))) == country.strip().casefold())
