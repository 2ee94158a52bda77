"""Whitening of embeddings by the covariance of exactly centred rows.

Entries become whole numbers, so the sums over all vectors are exact and every row is centred without
rounding: n*x - S is a whole number, and only its quotient by n is rounded. MLlib's RowMatrix adds up the Gramian of
the centred rows; divided by n it is the covariance, whose eigenvectors are found on the driver (a
matrix of the vectors' length squared) and sent to the tasks, which project the rows in blocks. The whitened
rows are written, and their own covariance is measured the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE = 64  #: an entry c is taken as x = floor(SCALE * c), plus a constant that no deviation has
COMPONENTS = 32
LARGEST = float(1 << 40)  #: entries beyond are an error, for sums of them would leave 64 bits
LEAST_VARIANCE = 1e-12  #: of the largest eigenvalue; components below have no direction of their own


def is_whole(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def rounded(vectors: pd.Series, length: int) -> np.ndarray:
    """The whole numbers floor(SCALE * c) of each row. A constant added to all of them would leave n*x - S as it is."""
    x = np.floor(SCALE * np.stack(vectors.to_numpy()).astype(np.float64)) if len(vectors) else np.zeros((0, length))
    if np.abs(x).max(initial=0) > SCALE * LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST:g}")
    return x.astype(np.int64)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's rows (at, n, total, largest): for every place of a vector, and lengths apart, the entries' number, sum and largest size."""
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for b in batches:
        for length, rows in b.groupby(b["v"].map(len))["v"]:
            x = rounded(rows, length)
            n, total, largest = found.get(length, (0, np.zeros(length, np.int64), np.zeros(length, np.int64)))
            found[length] = n + len(x), total + x.sum(0), np.maximum(largest, abs(x).max(0, initial=0))
    for length, (n, total, largest) in found.items():
        yield pd.DataFrame({"length": length, "at": np.arange(length), "n": n, "total": total, "largest": largest})


def totals(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """n, and for each place the exact sum of floor(SCALE * c). As many rows as a vector has places come to the driver."""
    made = vectors.mapInPandas(_sums, "length int, at int, n long, total long, largest long")
    rows = made.groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("largest").alias("largest")).orderBy("length", "at").collect()
    if len({r["length"] for r in rows}) > 1:
        raise ValueError(f"vectors have different lengths: {sorted({r['length'] for r in rows})}")
    n = rows[0]["n"] if rows else 0
    if any(2 * (r["largest"] + 1) * n >= 1 << 62 for r in rows):
        raise ValueError("entries are so large that n times one leaves 64 bits")
    return n, np.array([int(r["total"]) for r in rows], np.int64)


def gramian(rows: DataFrame, column: str, length: int) -> np.ndarray:
    """Sum of the outer products of a column of arrays of doubles, by MLlib in a tree of partial sums."""
    held = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(held, 0, length).computeGramianMatrix().toArray()


def _centred(n: int, total: np.ndarray):
    """Rows n*x - S, exactly: the whole part of the mean is taken off first, so the numbers stay small."""
    whole, rest = total // n, total % n
    return lambda vectors: n * (rounded(vectors, len(total)) - whole) - rest


def _exact_squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; None beyond 64 bits."""
    near = (d.astype(np.float64) ** 2).sum(1)
    if near.max(initial=0) < 2.0**62:
        return (d * d).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return [x if x < 1 << 63 else None for x in exact]


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry are dropped and have no part in any sum. Components are numbered from 1 by falling
    eigenvalue; an eigenvector's sign makes its largest entry positive. Components without variance (below LEAST_VARIANCE of the largest, as
    where all vectors are equal, or there is one) are left out, for their rows can't be scaled to variance 1; where
    there is none the result has no rows. deviation is null where the whole number doesn't fit 64 bits. Repeated
    rows and ids, and null ids, stay, as rows of their own. An empty table gives an empty result; extra columns have
    no effect. Vectors of different lengths, and entries beyond LARGEST, are an error that says so.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[vec_id].dataType.simpleString()
    out = f"{vec_id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    used = embeddings.where(is_whole(F.col(vector))).select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    n, total = totals(used.select("v"))
    d = len(total)
    if not n or not d:
        return spark.createDataFrame([], out)
    centre = _centred(n, total)

    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"c": list(centre(b["v"]) / n)})

    covariance = gramian(used.select("v").mapInPandas(centred, "c array<double>"), "c", d) / n
    value, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = [k for k in np.argsort(-value, kind="stable")[:components] if value[k] > LEAST_VARIANCE * value.max() and value[k] > 0]
    if not order:
        return spark.createDataFrame([], out)
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(0), order])
    explained = (value[order] / np.trace(covariance)).tolist()
    turned = spark.sparkContext.broadcast(axes / np.sqrt(value[order]))  # places of a vector x components

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = centre(b["v"])
            yield pd.DataFrame({"id": b["id"], "deviation": pd.array(_exact_squares(c), "Int64"), "w": list((c / n) @ turned.value)})

    rows = materialise(used.mapInPandas(project, f"id {kind}, deviation long, w array<double>"), "whitened")
    k = len(order)
    means = np.array(rows.select(*(F.avg(F.col("w")[i]) for i in range(k))).first())
    moved = F.zip_with("w", F.lit(means.tolist()), lambda a, m: a - m)
    error = float(np.abs(gramian(rows.select(moved.alias("w")), "w", k) / n - np.eye(k)).max())
    shares = F.lit(explained)
    long = rows.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(F.col("id").alias(vec_id), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"))
