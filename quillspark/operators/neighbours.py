"""Nearest neighbours by cells: only vectors of cells that can hold a neighbour are compared, and every pair in the space of the vectors.

A coarse quantiser, k-means on the unit sphere, is fitted on a bounded sample; every vector belongs to the cell of its nearest
centre and asks a number of cells for neighbours. Two rules say which:

- by bound (`neighbours_above`): a pair at least as similar as a threshold lies within an angle of each other, and so a vector
  can leave out every cell whose centre is farther than that angle plus the cell's own radius. Nothing is lost, whatever the data.
- by recall (`neighbours_by_recall`): as many of the nearest cells as bring the recall of a set of queries, measured against all
  vectors, to a target. Cells may be cut in a space of few principal directions; similarities are those of whole vectors.

A cell's vectors and those that ask it are dealt into blocks of bounded size, and each pair of blocks is one matrix product, so
cells with very many vectors are many tasks. Where the bound lets vectors leave out few cells, shuffling a copy of each to every
cell it asks would take disk by the square of their number. Then they are written once, in blocks, and a task reads all
blocks, one after the other, for its own one and keeps the best: disk grows with the vectors, only reading and products by the square.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G

CELL = 1024  #: vectors a cell, on average
MOST_CELLS = 2048  #: beyond CELL times as many vectors, cells grow instead
SAMPLE = 32_768  #: vectors, by hash, that the centres are fitted on at most
QUERIES = 256  #: vectors, by hash, whose neighbours among all vectors are found to measure recall
RECALL = 0.95
DIRECTIONS = 30  #: principal directions that cells are cut in
SLACK = 1e-6  #: of an angle, for rounding
MOST_COPIES = 4  #: copies of a vector on average that may be shuffled to the blocks it meets; beyond, blocks are read by tasks instead
READ, READ_BYTES = 4096, 1 << 23  #: vectors of a block that is read, and their bytes, at most
LEFT, GATHERED = 1024, 1 << 16  #: rows of a product, and pairs whose exact similarity is worked out at a time


def _hashed(vectors: DataFrame, nodes: int, most: int, salt: int) -> pd.DataFrame:
    """About `most` vectors, all where there are fewer, by a hash of the node; in order of nodes."""
    part = vectors if nodes <= most else vectors.where(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * most / nodes))
    return part.select("node", "v").toPandas().sort_values("node", ignore_index=True)


def fitted_centres(sample: np.ndarray, cells: int, turns: int = 8) -> np.ndarray:
    """Unit vectors that the sample gathers around: each turn a centre moves to the mean direction of the vectors nearest to it."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.random.default_rng(0).permutation(len(distinct))[:cells]]
    for _ in range(turns):
        own = nearest_centre(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((part @ centres.T).argmax(1) for part in np.array_split(x, -(-len(x) // 8192)))]) if len(x) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  #: a unit row for each cell
    basis: np.ndarray | None  #: columns are the directions that cells are cut in; None: the vectors' own space

    def seen(self, v: np.ndarray) -> np.ndarray:
        """The vectors as the cells see them, of unit length."""
        if self.basis is None:
            return v
        x = v @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def quantiser(vectors: DataFrame, nodes: int, cell: int = CELL, directions: int | None = None) -> Quantiser:
    """Fitted on a sample of at most SAMPLE vectors. directions: cut cells in so many principal directions, where vectors have more."""
    sample = np.stack(_hashed(vectors, nodes, SAMPLE, 1)["v"].to_numpy())
    basis = G.principal_axes(vectors, directions, width=directions + 8, passes=3) if directions and sample.shape[1] > directions else None
    cells = min(MOST_CELLS, max(1, round(nodes / cell)))
    q = Quantiser(np.zeros((0, 0)), basis)
    return Quantiser(fitted_centres(q.seen(sample), cells), basis)


def _blocks(counts: dict[int, int], cells: int, block: int) -> list[int]:
    return [max(1, -(-counts.get(c, 0) // block)) for c in range(cells)]


def _met(placed: DataFrame, cells: int, k: int, least: float | None, block: int) -> DataFrame:
    """(a, b, sim) of the k best of each pair of blocks. placed: node, v, own (its cell), asks (the cells it asks)."""
    own = {r[0]: r[1] for r in placed.groupBy("own").count().collect()}  # a row a cell
    asked = {r[0]: r[1] for r in placed.select(F.explode("asks").alias("cell")).groupBy("cell").count().collect()}
    held, asking = F.lit(_blocks(own, cells, block)), F.lit(_blocks(asked, cells, block))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = placed.select("node", "v", F.explode("asks").alias("cell")).select("node", "v", "cell", dealt(F.get(asking, F.col("cell"))).alias("i"), each(F.get(held, F.col("cell"))).alias("j"))
    right = placed.select("node", "v", F.col("own").alias("cell")).select("node", "v", "cell", dealt(F.get(held, F.col("cell"))).alias("j"), each(F.get(asking, F.col("cell"))).alias("i"))
    keys = ("cell", "i", "j")
    top = G.block_top(k, least)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda x, y: top(x, y), "a long, b long, sim double")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(G.Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _placed(vectors: DataFrame, q: Quantiser, asks) -> DataFrame:
    """node, v, own, asks. asks(similarities to the centres) gives each row's cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = q.seen(np.stack(b["v"].to_numpy())) @ q.centres.T
                yield b.assign(own=near.argmax(1).astype(np.int32), asks=asks(near))

    return vectors.select("node", "v").mapInPandas(run, "node long, v array<double>, own int, asks array<int>")


def _asked(vectors: DataFrame, q: Quantiser, asks, block: int) -> float:
    """How many copies of a vector on average would be shuffled to the blocks it meets."""
    cells = len(q.centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, asked = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            if len(b):
                near = q.seen(np.stack(b["v"].to_numpy())) @ q.centres.T
                own += np.bincount(near.argmax(1), minlength=cells)
                asked += asks(near).sum(axis=0)
        yield pd.DataFrame({"cell": np.arange(cells), "own": own, "asked": asked})

    found = vectors.select("v").mapInPandas(run, "cell int, own long, asked long").groupBy("cell").agg(F.sum("own"), F.sum("asked")).collect()  # a row a cell
    held, asking = ([max(1, -(-r[i] // block)) for r in found] for i in (1, 2))
    return sum(r[2] * h + r[1] * a for r, h, a in zip(found, held, asking)) / max(1, sum(r[1] for r in found))


def _packed(vectors: DataFrame, nodes: int, q: Quantiser) -> str:
    """The folder of blocks (rows of nodes, cells and vectors, as bytes) of at most READ vectors, those of a cell together; each vector is in one."""
    spark = vectors.sparkSession
    blocks = max(1, -(-nodes // READ), min(3 * spark.sparkContext.defaultParallelism, nodes // 512))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(own=(q.seen(np.stack(b["v"].to_numpy())) @ q.centres.T).argmax(1).astype(np.int32))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = most = 0
        for b in batches:
            if not len(b):
                continue
            most = most or max(1, min(READ, READ_BYTES // (8 * len(b["v"].iloc[0]))))
            held.append(b)
            size += len(b)
            if size >= most:
                whole = pd.concat(held, ignore_index=True)
                for at in range(0, size - most + 1, most):
                    yield _bytes(whole.iloc[at : at + most])
                rest = size // most * most
                held, size = [whole.iloc[rest:]], size - rest
        if size:
            yield _bytes(pd.concat(held, ignore_index=True))

    placed = vectors.select(F.col("node").cast("long").alias("node"), "v").mapInPandas(place, "node long, v array<double>, own int")
    dealt = placed.repartitionByRange(blocks, "own", F.xxhash64("node")).coalesce(blocks)
    folder = f"{G.shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    dealt.mapInPandas(pack, "node binary, own binary, v binary").rdd.map(lambda r: tuple(map(bytes, r))).saveAsPickleFile(folder, 1)
    return folder


def _bytes(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"node": [b["node"].to_numpy(np.int64).tobytes()], "own": [b["own"].to_numpy(np.int32).tobytes()], "v": [np.stack(b["v"].to_numpy()).astype(float).tobytes()]})


class Best:
    """The k most similar vectors, at least `least` similar, of each of a block's, of all the blocks it has met; ties go to the lower node."""

    def __init__(self, packed: tuple[bytes, bytes, bytes], k: int, least: float, q: Quantiser, asks):
        self.packed, self.k, self.asks = packed, k, asks
        self.node, _, self.v = self.opened(packed)
        self.single = self.v.astype(np.float32)
        self.may = asks(q.seen(self.v) @ q.centres.T)
        self.floor = np.full(len(self.node), least)  #: what another one must reach
        self.margin = 4e-7 * (self.v.shape[1] + 8)  #: that a product in single precision may be off by, and more
        self.row, self.other, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    @staticmethod
    def opened(packed: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = np.frombuffer(packed[0], np.int64)
        return node, np.frombuffer(packed[1], np.int32), np.frombuffer(packed[2]).reshape(len(node), -1)

    def meet(self, packed: tuple[bytes, bytes, bytes]) -> None:
        node, own, v = self.opened(packed)
        cells = np.unique(own)
        asking = np.flatnonzero(self.may[:, cells].any(axis=1))
        asked = np.flatnonzero(self.may[asking].any(axis=0)[own])
        if not len(asked):
            return
        if len(asked) < len(node):
            node, v = node[asked], v[asked]
        single = v.astype(np.float32).T
        found = [self._above(asking[at : at + LEFT], node, v, single) for at in range(0, len(asking), LEFT)]
        row, other, sim = (np.concatenate(x) for x in zip(*found))
        if len(row):
            self._keep(np.concatenate([self.row, row]), np.concatenate([self.other, other]), np.concatenate([self.sim, sim]))

    def _above(self, rows: np.ndarray, node: np.ndarray, v: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, other, sim) of the rows' k best of these vectors at the floor, and perhaps some more."""
        near = self.single[rows] @ single
        flat = np.flatnonzero(near >= (self.floor[rows] - self.margin).astype(np.float32)[:, None])
        at, col = flat // len(node), flat % len(node)
        many = np.flatnonzero(np.bincount(at, minlength=len(rows)) > self.k + 1)  # the vector itself may be one
        if len(many):
            last = np.full(len(rows), -np.inf, np.float32)
            last[many] = np.partition(near[many], -self.k - 1, axis=1)[:, -self.k - 1] - 2 * self.margin
            kept = near[at, col] >= last[at]
            at, col = at[kept], col[kept]
        parts = []
        for i in range(0, len(at), GATHERED):
            a, c = rows[at[i : i + GATHERED]], col[i : i + GATHERED]
            sim = np.round(np.einsum("ij,ij->i", self.v[a], v[c]), 12)  # equal vectors must tie
            right = (sim >= self.floor[a]) & (self.node[a] != node[c])
            parts.append(self._first(a[right], node[c[right]], sim[right]))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _first(self, row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each row, in order."""
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[kept], other[kept], sim[kept]

    def _keep(self, row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        self.row, self.other, self.sim = self._first(row, other, sim)
        last = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) == self.k - 1
        self.floor[self.row[last]] = self.sim[last]

    def result(self) -> tuple[bytes, bytes, bytes, bytes]:
        rank = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1
        return self.node[self.row].tobytes(), self.other.tobytes(), self.sim.tobytes(), rank.astype(np.int32).tobytes()


def _read(vectors: DataFrame, nodes: int, q: Quantiser, k: int, least: float, asks) -> DataFrame:
    """(a, b, sim, rank) by tasks that read all blocks in turn. A task holds two blocks and k rows for each vector of its own."""
    spark = vectors.sparkSession
    folder = _packed(vectors, nodes, q)

    def run(pairs: Iterator[tuple]) -> Iterator[tuple]:
        best = None
        for mine, other in pairs:
            if best is None or best.packed[0] != mine[0]:
                if best is not None:
                    yield best.result()
                best = Best(mine, k, least, q, asks)
            best.meet(other)
        if best is not None:
            yield best.result()

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"a": np.frombuffer(r.a, np.int64), "b": np.frombuffer(r.b, np.int64), "sim": np.frombuffer(r.sim), "rank": np.frombuffer(r.rank, np.int32)})

    sc = spark.sparkContext
    found = sc.pickleFile(folder).cartesian(sc.pickleFile(folder).coalesce(1)).mapPartitions(run)
    packed = spark.createDataFrame(found, "a binary, b binary, sim binary, rank binary", verifySchema=False)
    return packed.mapInPandas(opened, "a long, b long, sim double, rank int")


def neighbours_above(vectors: DataFrame, least: float, k: int = G.NEIGHBOURS, nodes: int | None = None, cell: int = CELL, block: int = G.BLOCK, most_copies: float = MOST_COPIES) -> DataFrame:
    """(a, b, sim, rank) of nearest() where sim is at least `least`; all of them, by bound.

    vectors: node, v of unit length. Vectors of length 0 are similar to none. most_copies: of a vector, shuffled, on average; beyond, blocks are read instead.
    """
    nodes = vectors.count() if nodes is None else nodes
    if nodes < 2:
        return vectors.sparkSession.createDataFrame([], "a long, b long, sim double, rank int")
    q = quantiser(vectors, nodes, cell)
    cells, reach = len(q.centres), math.acos(max(-1.0, min(1.0, least))) + SLACK

    def radii(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        widest = np.zeros(cells)
        for b in batches:
            if len(b):
                near = np.stack(b["v"].to_numpy()) @ q.centres.T
                np.maximum.at(widest, near.argmax(1), np.arccos(np.clip(near.max(1), -1, 1)))
        yield pd.DataFrame({"cell": np.arange(cells), "r": widest})

    found = vectors.select("v").mapInPandas(radii, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r")).collect()  # a row a cell
    radius = np.zeros(cells)
    for r in found:
        radius[r["cell"]] = r["r"]

    def may(near: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(near, -1, 1)) <= reach + radius + SLACK

    if _asked(vectors, q, may, block) > most_copies:
        return _read(vectors, nodes, q, k, least, may)
    placed = G.written(_placed(vectors, q, lambda near: [np.flatnonzero(m).astype(np.int32) for m in may(near)]), "placed")
    return _ranked(_met(placed, cells, k, least, block), k)


def probes_for(vectors: DataFrame, nodes: int, q: Quantiser, k: int, recall: float, queries: int = QUERIES) -> int:
    """How many nearest cells must be asked so that the queries find the wanted share of their true k neighbours, which are found among all vectors."""
    asked = _hashed(vectors, nodes, queries, 2)
    mine, ids = np.stack(asked["v"].to_numpy()), asked["node"].to_numpy()
    order = np.argsort(np.argsort(-(q.seen(mine) @ q.centres.T), axis=1, kind="stable"), axis=1, kind="stable")  # place of each cell for each query

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v, nodes_ = np.stack(b["v"].to_numpy()), b["node"].to_numpy()
            sims = mine @ v.T
            sims[ids[:, None] == nodes_[None, :]] = -np.inf
            first = np.argpartition(-sims, min(k, len(v) - 1), axis=1)[:, :k]
            own = (q.seen(v) @ q.centres.T).argmax(1)
            row = np.repeat(np.arange(len(ids)), first.shape[1])
            col = first.ravel()
            yield pd.DataFrame({"a": ids[row], "b": nodes_[col], "sim": sims[row, col], "place": order[row, own[col]] + 1})

    found = vectors.select("node", "v").mapInPandas(best, "a long, b long, sim double, place long").where("sim > double('-Infinity')")
    places = np.sort(_ranked(found, k).select("place").toPandas()["place"].to_numpy())  # k rows a query
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) if len(places) else 1


def neighbours_by_recall(vectors: DataFrame, k: int = G.NEIGHBOURS, recall: float = RECALL, nodes: int | None = None, cell: int = CELL, block: int = G.BLOCK, directions: int | None = DIRECTIONS) -> DataFrame:
    """(a, b, sim, rank): k neighbours of each node, of which a share of about `recall` are those of nearest(). Similarities are exact.

    The number of cells that are asked follows from the data: few where vectors lie in groups, nearly all where they lie anywhere.
    """
    nodes = vectors.count() if nodes is None else nodes
    if nodes < 2:
        return vectors.sparkSession.createDataFrame([], "a long, b long, sim double, rank int")
    q = quantiser(vectors, nodes, cell, directions)
    probes = min(len(q.centres), probes_for(vectors, nodes, q, k, recall))

    def asks(near: np.ndarray) -> list[np.ndarray]:
        return list(np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32))

    placed = G.written(_placed(vectors, q, asks), "placed")
    return _ranked(_met(placed, len(q.centres), k, None, block), k)
