"""Near-duplicates by circulant MinHash.

Two permutations of the 32-bit numbers make the whole signature: one shuffles the shingles, the other,
shifted round by k places, gives coordinate k. Coordinates are grouped into bands; documents that agree
in a band are candidates, and a link needs the exact Jaccard similarity of the full shingle sets, which
are compared by their words, not by hashes.

Documents with the same shingle set become one class first (by two independent 64-bit digests and the
set's size). Small buckets are compared pair by pair, each document of a pair once per hub. In a large
bucket every member is compared with the bucket's hub; members that are connected by then need no more
comparing. What a large bucket still holds outside its main component is compared, block by block, with
all its members, so no link between components is lost and near copies of one text cost a few
comparisons each. A block returns a spanning forest of its links.

Rows meet bucket and class tables through join_by_size(), which sends the few keys that hold a large part of all
rows by broadcast, so no task gets a whole hot key.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER_BYTES, distinct_sets, in_chunks, join_by_size, materialise, mix64, numbered_shingles, partitions, shingle_hashes
from .components import connected_components

ROWS = 7  #: coordinates in a band
MISS = 3e-7  #: probability that a pair at the threshold shares no band
COLD = 16  #: buckets of at most so many members are compared pair by pair
BATCH = 256  #: documents compared against one hub in one group
BLOCK_LEAST, BLOCK_MOST, BLOCKS = 60_000, 1_000_000, 8  #: shingles in a block of a cluster; blocks of a cluster while they hold less than the most
ID_ROWS = 1_000_000  #: ids up to which the choice of texts to fetch is broadcast


def _fmix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """size coordinates for each set; set i holds hashes[starts[i]:starts[i + 1]] and none is empty."""
    first = _fmix32((hashes >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15))
    out = np.empty((size, len(starts) - 1), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(_fmix32(first + np.uint32(k)), starts[:-1])
    return out.T


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _sketch(bands: int, rows: int, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            for s in in_chunks(texts):
                hashes, others, at = shingle_hashes(texts[s], words, (0, 1))
                sets, other = distinct_sets(hashes, at), distinct_sets(others, at)
                n = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(n)
                flat = np.concatenate(sets) if len(some) else np.zeros(0, np.uint64)
                starts = np.concatenate([[0], np.cumsum(n[some])]).astype(np.int64)
                keys: list = [[]] * len(sets)
                digest = np.zeros((2, len(sets)), np.uint64)
                if len(some):
                    digest[0, some] = np.add.reduceat(mix64(flat), starts[:-1])
                    digest[1] = [mix64(x).sum(dtype=np.uint64) for x in other]
                    for i, row in zip(some, band_keys(signatures(flat, starts, bands * rows), bands, rows)):
                        keys[i] = row
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[s], "n_shingles": n, "d1": digest[0].view(np.int64), "d2": digest[1].view(np.int64), "bands": keys})

    return run


class Words:
    """Exact numbers of words, equal for equal words of one group."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()  # bytes split at the six characters
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))


def shingle_sets(words: Sequence[np.ndarray], k: int) -> list[np.ndarray]:
    at = np.cumsum([0, *map(len, words)])
    return numbered_shingles(np.concatenate([*words, np.zeros(0, np.int64)]), at, k)


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def links_in_block(nodes: Sequence[int], sides: Sequence[int], parts: Sequence[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links from documents of side 0 to those of side 1 that join parts which nothing has joined before."""
    nodes, sides, n = np.array(nodes), np.array(sides), np.array([len(x) for x in sets])
    right, left = np.flatnonzero((sides == 1) & (n > 0)), np.flatnonzero((sides == 0) & (n > 0))
    if not len(right) or not len(left):
        return []
    flat = np.concatenate([sets[j] for j in right])
    order = np.argsort(flat, kind="stable")
    values, first, count = np.unique(flat[order], return_index=True, return_counts=True)
    postings = np.repeat(np.arange(len(right)), n[right])[order]
    root = {p: p for p in parts}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    out = []
    for i in left:
        at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
        c = np.where(values[at] == sets[i], count[at], 0)
        upto = np.cumsum(c)
        met = postings[np.repeat(first[at] - (upto - c), c) + np.arange(upto[-1])]
        both = np.bincount(met, minlength=len(right))
        for j in right[(both > 0) & (100 * both >= percent * (n[right] + n[i] - both))]:
            if (a := find(parts[i])) != (b := find(parts[j])):
                root[a] = b
                out.append((nodes[i], nodes[j]))
    return out


def _compare(percent: int, words: int):
    """Rows arrive by group, side 0 first. Kind 0: side 0 is the hub (in all its texts), the others meet it a chunk at a time. Kind 1: a pair of blocks, kept as word numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, kept = None, Words(), []

        def settle() -> list[tuple[int, int]]:
            if key is None or key[0] == 0 or not kept:
                return []
            nodes, sides, parts, said = zip(*kept)
            return links_in_block(nodes, sides, parts, shingle_sets(said, words), percent)

        def meet(rows: list[tuple]) -> list[tuple[int, int]]:
            """Links of the hub's texts, which are kept, with other rows of its group."""
            sets = shingle_sets([*(x[3] for x in kept), *(x[3] for x in rows)], words)
            hubs, others = sets[: len(kept)], sets[len(kept) :]
            return [(kept[0][0], r[0]) for r, x in zip(rows, others) if r[0] != kept[0][0] and any(_alike(h, x, percent) for h in hubs)] if kept else []

        for b in batches:
            texts, out, waiting = list(b["text"]), [], []
            keys = list(zip(b["kind"], b["g1"], b["g2"], b["g3"]))
            nodes, sides, parts = b["node"].tolist(), b["side"].tolist(), b["part"].tolist()
            for s in in_chunks(texts):
                for i in range(s.start, s.stop):
                    if keys[i] != key:
                        out += meet(waiting) if waiting else settle()
                        key, number, kept, waiting = keys[i], Words(), [], []
                    row = nodes[i], sides[i], parts[i], number(texts[i])
                    (kept if key[0] or sides[i] == 0 else waiting).append(row)
                out += meet(waiting) if waiting else []
                waiting = []
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(settle(), columns=["a", "b"], dtype="int64")

    return run


def hub_groups(pairs: DataFrame) -> DataFrame:
    """pairs(hub, groups, node), dealt into groups of about BATCH documents with their hub."""
    members = pairs.select("hub", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("g2"), F.lit(1).alias("side"), "node").distinct()
    hubs = members.select("hub", "g2").distinct().select("hub", "g2", F.lit(0).alias("side"), F.col("hub").alias("node"))
    return members.unionByName(hubs).select(F.lit(0).alias("kind"), F.col("hub").alias("g1"), "g2", F.lit(0).alias("g3"), "side", "node", F.col("node").alias("part"))


def candidate_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """hub, groups, node: all pairs of small buckets' members, and the members of large buckets with their bucket's hub; pairs of too different sizes can't link."""
    fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    small = entries.where(f"members <= {COLD}")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & fits("x.n", "y.n"))
    pairs = materialise(pairs.select(F.col("x.node").alias("hub"), F.col("y.node").alias("node")).distinct(), "pairs")
    groups = lambda d, size: d.groupBy("hub").agg(F.ceil(size / BATCH).cast("int").alias("groups"))
    cold = pairs.join(groups(pairs, F.count("*")), "hub")
    large = entries.where((F.col("members") > COLD) & (F.col("node") != F.col("hub")) & fits("n", "hub_n"))
    stars = large.select("hub", F.ceil(F.col("hub_members") / BATCH).cast("int").alias("groups"), "node").distinct()
    return cold.select("hub", "groups", "node").unionByName(stars)


def open_blocks(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Groups that compare what lies outside the main part of a large bucket (side 0) with all its members (side 1).

    parts: node, component so far; nodes without one are alone. Large buckets that share members are one cluster.
    """
    large = entries.where(f"members > {COLD}").select("key", "node", "n").join(parts, "node", "left")
    large = large.withColumn("part", F.coalesce("component", "node")).drop("component")
    shares = large.groupBy("key", "part").agg(F.count("*").alias("held"))
    torn = shares.groupBy("key").agg(F.sum("held").alias("members"), F.count("*").alias("parts"), F.max(F.struct("held", "part"))["part"].alias("main")).where("parts > 1")
    left = materialise(join_by_size(large, torn, ["key"]).withColumn("outside", F.col("part") != F.col("main")), "torn")
    hubs = left.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("hub"))
    clusters = connected_components(join_by_size(left.select("key", "node"), hubs, ["key"]).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    nodes = left.groupBy("node", "part", "n").agg(F.max("outside").alias("outside")).join(clusters, "node")
    sides = nodes.withColumn("side", F.explode(F.when(F.col("outside"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    sizes = sides.groupBy("component").agg(F.count("*").alias("members"), F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("n0"), F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("n1"))
    blocks = lambda c: F.ceil(F.col(c) / F.least(F.greatest(F.col(c) / BLOCKS, F.lit(BLOCK_LEAST)), F.lit(BLOCK_MOST))).cast("int")
    dealt = join_by_size(sides, sizes.select("component", "members", blocks("n0").alias("blocks0"), blocks("n1").alias("blocks1")), ["component"])
    own, other = (F.when(F.col("side") == 0, F.col(f"blocks{i}")).otherwise(F.col(f"blocks{1 - i}")) for i in (0, 1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    g2, g3 = (F.when(F.col("side") == i, F.col("own")).otherwise(F.col("other")) for i in (0, 1))
    return dealt.select(F.lit(1).alias("kind"), F.col("component").alias("g1"), g2.alias("g2"), g3.alias("g3"), "side", "node", "part")


def confirmed(groups: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) among the groups' documents, by their whole texts."""
    groups = materialise(groups, "groups")
    ids = groups.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.join(F.broadcast(ids) if groups.count() <= ID_ROWS else ids, "doc_id", "left_semi")
    rows = groups.join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    key = ["kind", "g1", "g2", "g3"]
    dealt = rows.repartition(partitions(docs.sparkSession), *key).sortWithinPartitions(*key, "side")
    return materialise(dealt.select(*key, "side", "node", "part", "text").mapInPandas(_compare(percent, words), "a long, b long"), "links")


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave a pair at the threshold without a common one with at most the probability miss."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are A-Z lower-cased and split at the six white-space characters. Documents link where
    100 * intersection >= percent * union; null and empty texts, and those without words, have no
    shingles and no links; a text of 1 to words - 1 words is one shingle. component_id is the smallest
    doc_id reachable. Rows that share a doc_id share its component; rows with a null doc_id link with
    nothing and stay. An empty table gives an empty result. Extra columns have no effect.
    """
    docs, bands = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bands_for(percent, rows)
    sketched = materialise(docs.mapInPandas(_sketch(bands, rows, words), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "sketches")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    same = ["d1", "d2", "n_shingles"]
    classes = materialise(usable.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count("*").alias("members")), "classes")
    nodes = usable.join(classes.select(F.col("node").alias("doc_id"), *same), ["doc_id", *same], "left_semi")
    entries = materialise(nodes.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n")).distinct(), "bands")
    buckets = entries.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("hub")).where("members > 1")
    buckets = buckets.select("key", "members", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    buckets = buckets.withColumn("hub_members", F.max("members").over(Window.partitionBy("hub")))  # a hub has at most as many buckets as bands
    entries = materialise(join_by_size(entries, buckets, ["key"]), "buckets")
    links = confirmed(hub_groups(candidate_pairs(entries, percent)), docs, percent, words)
    # Rows of one doc_id with several texts are one node.
    several = usable.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    ties = usable.join(several, "doc_id", "left_semi").join(classes, same).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = links.unionByName(ties.distinct())
    parts = connected_components(links)
    blocks = open_blocks(entries, parts)
    more = confirmed(blocks, docs, percent, words)
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    found = classes.join(parts, "node", "left").select(*same, "members", F.coalesce("component", "node").alias("component"))
    placed = join_by_size(usable.select("doc_id", *same), found, same).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sketched.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of docs, all columns, that are the kept one of their group; rows with a null doc_id stay."""
    gone = near_duplicates(docs, percent, words).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
