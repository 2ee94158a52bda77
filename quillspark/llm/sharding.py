"""Byte-balanced sharding by histogram sort.

Rows have an order: 64-bit text hash, then doc_id. Shard boundaries ("splitters") are
found by counting, over all partitions, the exact bytes below candidate boundaries and narrowing each
splitter's interval around its target until the count is within the tolerance. The interval narrows on
the hash first, so equal texts stay in one shard unless their bytes alone exceed the tolerance; such a
group is split by doc_id. Only then do whole rows move, once, to their shards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_or_empty

LOW, HIGH = -(1 << 63), (1 << 63) - 1
LEVELS = ("h", "d")
PIECE_BYTES, MOST_PIECES = 128 << 20, 65_536  #: a shard larger than a piece is exchanged and sorted in several


@dataclass
class Splitter:
    """Rows before (prefix..., value at this level) belong below. low counts no more than target, high at least it."""

    target: int
    prefix: tuple[int, ...] = ()
    low: int = LOW
    high: int = HIGH
    below_low: int = 0
    below_high: int = 0
    done: tuple[int, ...] | None = None
    probes: list[int] = field(default_factory=list)


def _probes(low: int, high: int, n: int) -> list[int]:
    step = max(1, (high - low) // (n + 1))
    return sorted({min(high - 1, low + step * (i + 1)) for i in range(n)} - {low}) if high - low > 1 else []


def _histogram(plan: dict[tuple[int, ...], list[int]]):
    """For each prefix, bytes of the rows that fall between neighbouring probes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], int] = {}
        prefixes = list(plan)
        for b in batches:
            cols = [b[c].to_numpy() for c in LEVELS]
            size = b["size"].to_numpy()
            for p, prefix in enumerate(prefixes):
                mask = np.ones(len(size), bool)
                for c, v in zip(cols, prefix):
                    mask &= c == v
                if mask.any():
                    at = np.searchsorted(np.array(plan[prefix], np.int64), cols[len(prefix)][mask], side="right")
                    sums = np.zeros(len(plan[prefix]) + 1, np.int64)
                    np.add.at(sums, at, size[mask])
                    for k in np.flatnonzero(sums):
                        total[p, int(k)] = total.get((p, int(k)), 0) + int(sums[k])
        if total:
            yield pd.DataFrame([(p, k, v) for (p, k), v in total.items()], columns=["prefix", "slot", "bytes"])

    return count


def find_splitters(keys: DataFrame, shards: int, tolerance: float, probes: int = 16) -> list[tuple[int, ...]]:
    """shards - 1 boundaries in ascending order; a row belongs to the shard after the boundaries at or before its key."""
    whole = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    slack = int(tolerance * whole / shards)
    splitters = [Splitter(whole * (i + 1) // shards, below_high=whole) for i in range(shards - 1)]
    while todo := [s for s in splitters if s.done is None]:
        plan: dict[tuple[int, ...], list[int]] = {}
        for s in todo:
            s.probes = _probes(s.low, s.high, probes)
            plan[s.prefix] = sorted({*plan.get(s.prefix, []), *s.probes, s.low, s.high})
        rows = keys.mapInPandas(_histogram(plan), "prefix int, slot int, bytes long").groupBy("prefix", "slot").agg(F.sum("bytes").alias("bytes")).collect()
        prefixes = list(plan)
        sums = {p: np.zeros(len(plan[p]) + 1, object) for p in prefixes}
        for r in rows:
            sums[prefixes[r["prefix"]]][r["slot"]] += r["bytes"]
        for s in todo:
            # exact bytes of the prefix's rows below each probe, counted from this splitter's low
            upto = dict(zip(plan[s.prefix], np.cumsum(sums[s.prefix])))
            base = upto[s.low]
            points = [(v, s.below_low + int(upto[v] - base)) for v in (s.low, *s.probes, s.high)]
            points[-1] = (s.high, s.below_high)
            best = min(points[1:] if s.low == LOW and not s.prefix else points, key=lambda x: abs(x[1] - s.target))
            s.low, s.below_low = max((x for x in points if x[1] <= s.target), key=lambda x: x[0])
            s.high, s.below_high = min((x for x in points if x[1] >= s.target and x[0] >= s.low), key=lambda x: x[0])
            if abs(best[1] - s.target) <= slack or s.high == s.low:
                s.done = (*s.prefix, best[0])
            elif s.high - s.low == 1:  # one value of this level holds the target
                if len(s.prefix) + 1 == len(LEVELS):
                    s.done = (*s.prefix, best[0])
                else:
                    s.prefix, s.low, s.high = (*s.prefix, s.low), LOW, HIGH
    return sorted(s.done for s in splitters)


def piece_of(boundaries: Sequence[tuple[int, ...]]):
    """Column of the number of boundaries at or before (h, d)."""
    bounds = np.array([(*b, LOW)[:2] for b in boundaries], np.int64).reshape(-1, 2)

    @F.pandas_udf("int")
    def find(h: pd.Series, d: pd.Series) -> pd.Series:
        first, last = (np.searchsorted(bounds[:, 0], h.to_numpy(), side) for side in ("left", "right"))
        for i in np.flatnonzero(last > first):  # boundaries inside one hash value
            last[i] = first[i] + np.searchsorted(bounds[first[i] : last[i], 1], d.iloc[i], "right")
        return pd.Series(last.astype(np.int32))

    return find(F.col("h"), F.col("d"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"h": F.xxhash64(text_or_empty()), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)), "size": F.octet_length(text_or_empty()).cast("long") + 16})


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.005) -> DataFrame:
    """doc_id, text, size, shard (0 to shards - 1) and slot (place in the shard, from 0) of every row.

    size: UTF-8 bytes of the text (null: none) plus 16. Shard sizes differ from the mean by at most
    tolerance of it at either end, unless a single row is larger. Shards of more than PIECE_BYTES are exchanged
    in pieces found the same way, so the size of a task follows the piece, not the shard. Null and repeated doc_ids are allowed;
    rows that agree in both text and doc_id stay together, so those alone can exceed the tolerance.
    An empty table gives an empty result. Extra columns have no effect.
    """
    docs = docs.select("doc_id", "text")
    keys = materialise(_keyed(docs).select("h", "d", "size"), "sizes")
    whole = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pieces = max(1, min(MOST_PIECES // shards, -(-whole // (shards * PIECE_BYTES))))
    piece = piece_of(find_splitters(keys, shards * pieces, tolerance))
    counts = keys.select(piece.alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))  # at most MOST_PIECES rows
    shard = F.floor(F.col("piece") / pieces).cast("int")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("shard", shard).select("piece", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("piece").orderBy("h", "d"))
    placed = _keyed(docs).withColumn("piece", piece).withColumn("inside", inside).join(F.broadcast(starts), "piece")
    return placed.select("doc_id", "text", "size", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))


def digest(placed: DataFrame, law: str = "bytes") -> DataFrame:
    """The columns that identify where each row went."""
    return placed.select("doc_id", "size", F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
