"""Column profiles in two jobs whatever the number of columns, and the choice of open-text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import headers as H
from .assembly import q

#: Date and time patterns that count as a timestamp.
TIME_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d MMM yyyy", "MMM d, yyyy", "MMM d, yyyy h:mm a", "MMMM d, yyyy", "MMMM d, yyyy h:mm a", "d MMMM yyyy")
TIME_SAMPLE, DIGIT_SAMPLE = 500, 25
HEX = r"(?i)^[0-9a-f]{6,}(?:-[0-9a-f]{2,}){2,}$"


def unpivoted(df: DataFrame, columns: Sequence[str], order: str = "row_number") -> DataFrame:
    """(column, row_number, value) of all stripped values that aren't blank."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), X.strip(q(c).cast("string")).alias("value")) for c in columns])).alias("cell")
    return df.select(q(order).alias("row_number"), cells).select("cell.column", "row_number", "cell.value").where("value <> ''")


def is_identifier(c: str = "value"):
    """M13."""
    v = F.col(c)
    shape = v.rlike(HEX) | ((F.char_length(v) >= 12) & v.contains("-") & v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    return (v != "") & ~v.contains(" ") & shape


def value_profile(long: DataFrame) -> DataFrame:
    """Per column n, distinct_n, mean_length, long_ratio, numeric_ratio, text_ratio, identifier_ratio, top5, top10.

    Values are counted first, so every further step works on distinct values.
    """
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    share = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)) / F.sum("n")
    moments = counted.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("distinct_n"),
        (F.sum(F.col("n") * F.char_length("value")) / F.sum("n")).alias("mean_length"),
        share(F.char_length("value") >= 25).alias("long_ratio"),
        share(F.expr("try_cast(value AS double)").isNotNull()).alias("numeric_ratio"),
        share(F.col("value").rlike(r"\p{L}")).alias("text_ratio"),
        share(is_identifier()).alias("identifier_ratio"),
    )
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    top = counted.withColumn("place", place).where("place <= 10").groupBy("column").agg(F.sum(F.when(F.col("place") <= 5, F.col("n"))).alias("top5"), F.sum("n").alias("top10"))
    return moments.join(top, "column").withColumns({"top5": F.col("top5") / F.col("n"), "top10": F.col("top10") / F.col("n")})


def sample_profile(long: DataFrame) -> DataFrame:
    """Per column time_ratio (first 500 values) and digit_ratio (digits to digits and letters, first 25 values)."""
    place = F.row_number().over(Window.partitionBy("column").orderBy("row_number"))
    first = long.withColumn("place", place).where(f"place <= {TIME_SAMPLE}")
    parsed = F.coalesce(*[F.try_to_timestamp("value", F.lit(f)) for f in TIME_FORMATS]).isNotNull()
    few = F.col("place") <= DIGIT_SAMPLE
    digits = F.sum(F.when(few, F.regexp_count("value", F.lit(r"\p{Nd}"))).otherwise(0))
    letters = F.sum(F.when(few, F.regexp_count("value", F.lit(r"\p{L}"))).otherwise(0))
    return first.groupBy("column").agg(F.avg(parsed.cast("int")).alias("time_ratio"), F.when(digits + letters > 0, digits / (digits + letters)).otherwise(0.0).alias("digit_ratio"))


def profile(df: DataFrame, columns: Sequence[str], order: str = "row_number") -> dict[str, dict[str, float]]:
    """Profiles by column; columns without values are missing."""
    if not columns:
        return {}
    long = unpivoted(df, columns, order)
    rows = value_profile(long).join(sample_profile(long), "column").collect()  # one row per column
    return {r["column"]: r.asDict() for r in rows}


# --- P09 ----------------------------------------------------------------------------------------

#: Fixed values of the cascade.
LABEL_LENGTH, LABEL_LONG = 20.0, 0.2


def _labels(p: dict) -> bool:
    return p["mean_length"] <= LABEL_LENGTH and p["long_ratio"] <= LABEL_LONG


def _varied(p: dict) -> bool:
    return p["n"] >= 20 and p["distinct_n"] >= 10 and (p["distinct_n"] / p["n"] >= 0.35 or p["top10"] <= 0.55)


def _fixed_set(p: dict) -> bool:
    unique = p["distinct_n"] / p["n"]
    small = p["n"] >= 8 and p["top5"] >= 0.85 and (p["distinct_n"] <= 5 or unique <= 0.35)
    large = p["n"] >= 20 and (p["distinct_n"] <= 12 and p["top5"] >= 0.65 or unique <= 0.1 and p["top10"] >= 0.8)
    return small or large


def rejection(name: str, p: dict | None) -> str | None:
    """Why a column isn't open text; None where it is."""
    if p is None:
        return "no answers"
    open_cue = H.has_open_cue(name)
    first = (
        ("identifier header", H.looks_like_id(H.plain(name).split())),
        ("numbers only", p["numeric_ratio"] >= 1.0),
        ("identifier values", p["n"] >= 20 and p["numeric_ratio"] >= 0.95 and p["distinct_n"] / p["n"] >= 0.85),
        ("no letters", p["text_ratio"] <= 0.0),
        ("mostly digits", p["digit_ratio"] >= 0.5),
        ("dates or times", H.looks_like_time(name) and p["time_ratio"] >= 0.9),
    )
    if why := next((w for w, applies in first if applies), None):
        return why
    if _varied(p):
        return "short labels without an open question" if _labels(p) and not open_cue else None
    then = (
        ("matrix header", "|" in name),
        ("fixed set of answers", _fixed_set(p)),
        ("closed question with short answers", H.looks_closed(name) and _labels(p)),
        ("short answers without an open question", _labels(p) and not open_cue),
        ("too few different short answers", _labels(p) and p["distinct_n"] < 8 and p["top10"] > 0.75),
    )
    return next((w for w, applies in then if applies), None)


def roles(df: DataFrame, order: str = "row_number") -> tuple[list[str], list[str], dict[str, str]]:
    """Metadata columns, verbatim columns, and why each other column was left out."""
    columns = [c for c in df.columns if c != order]
    metadata = [c for c in columns if H.is_metadata(c)]
    others = [c for c in columns if c not in metadata]
    found = profile(df, others, order)
    why = {c: rejection(c, found.get(c)) for c in others}
    return metadata, [c for c in others if why[c] is None], {c: w for c, w in why.items() if w}


def analysis_table(df: DataFrame, metadata: Sequence[str], verbatim: Sequence[str], drop_blank: bool = False, order: str = "row_number") -> DataFrame:
    """The role columns; with drop_blank only rows that have a verbatim answer. Row numbers stay as they are."""
    if clash := set(metadata) & set(verbatim):
        raise ValueError(f"columns with two roles: {sorted(clash)}")
    chosen = df.select(q(order), *map(q, metadata), *map(q, verbatim))
    return chosen.where(F.coalesce(*[X.blank_to_null(q(v)) for v in verbatim]).isNotNull()) if drop_blank and verbatim else chosen
