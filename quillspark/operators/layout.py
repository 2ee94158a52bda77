"""Layout by forces: edges pull their ends together, all nodes push each other away, by the cells of a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written

CHUNK = 1 << 21  #: distances a task holds at once


def jittered(places: DataFrame, share: float = 0.001) -> DataFrame:
    """Places moved by a share of their extent in a direction by the node's hash, so that nodes in one place can part."""
    box = _box(places)
    if box is None:
        return places
    turn = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) / 1_000_000 * 2 * np.pi
    return places.select("node", (F.col("x") + share * box[2] * F.cos(turn)).alias("x"), (F.col("y") + share * box[2] * F.sin(turn)).alias("y"))


def _box(places: DataFrame) -> tuple[float, float, float, int] | None:
    """Least x and y, the longer side (1 for a single place) and the number of nodes."""
    r = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    return None if not r[4] else (r[0], r[2], max(r[1] - r[0], r[3] - r[2]) or 1.0, r[4])


def force_round(places: DataFrame, e: DataFrame, heat: float = 0.1, grid: int = 32, scale: float | None = None) -> DataFrame:
    """One step of all nodes at once: node, x, y.

    An edge pulls by weight times distance; a cell pushes by its number of nodes times k²/distance away from their mean place, where k² is
    scale² a node, and a node's own cell counts without it. A move is at most `heat` of the scale, which is the places' longer side where none is given. So two nodes with an edge of weight w rest k/sqrt(w) apart.
    The pull is one aggregation over the edges; of the push, at most grid² sums of cells pass the driver, whatever the number of nodes. No nodes: no rows.
    """
    box = _box(places)
    if box is None:
        return places.select("node", "x", "y")
    x0, y0, side, n = box
    scale = scale or side
    k2 = scale * scale / n
    cell = [F.least(F.floor((F.col(c) - low) / side * grid), F.lit(grid - 1)).cast("int").alias(f"c{c}") for c, low in (("x", x0), ("y", y0))]
    marked = places.select("node", "x", "y", *cell)
    cells = marked.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).toPandas()
    number = np.full((grid, grid), -1)
    number[cells["cx"], cells["cy"]] = np.arange(len(cells))
    mass, sx, sy = (cells[c].to_numpy(float) for c in ("n", "sx", "sy"))
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("weight > 0")
    ends = both.join(places.select(F.col("node").alias("dst"), "x", "y"), "dst")
    near = ends.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("x")).alias("wx"), F.sum(F.col("weight") * F.col("y")).alias("wy"))
    pull = [F.coalesce(F.col(f"w{c}") - F.col("w") * F.col(c), F.lit(0.0)).alias(f"p{c}") for c in "xy"]
    pulled = marked.join(near, "node", "left").select("node", "x", "y", "cx", "cy", *pull)

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), max(1, CHUNK // len(mass))):
                b = whole.iloc[at : at + max(1, CHUNK // len(mass))]
                x, y = b["x"].to_numpy(), b["y"].to_numpy()
                own, rows = number[b["cx"], b["cy"]], np.arange(len(b))
                dx, dy = x[:, None] - sx / mass, y[:, None] - sy / mass
                push = mass / (dx * dx + dy * dy + k2 / 100)
                push[rows, own] = 0
                fx, fy = (push * dx).sum(axis=1), (push * dy).sum(axis=1)
                others = mass[own] - 1
                ox, oy = (np.where(others > 0, p - (s[own] - p) / np.maximum(others, 1), 0) for p, s in ((x, sx), (y, sy)))
                inner = others / (ox * ox + oy * oy + k2 / 100)
                mx, my = b["px"].to_numpy() + k2 * (fx + inner * ox), b["py"].to_numpy() + k2 * (fy + inner * oy)
                size = np.hypot(mx, my)
                part = np.minimum(1, heat * scale / np.maximum(size, 1e-300))
                yield pd.DataFrame({"node": b["node"], "x": x + part * mx, "y": y + part * my})

    return pulled.mapInPandas(move, f"node {places.schema['node'].dataType.simpleString()}, x double, y double")


def forced_layout(places: DataFrame, e: DataFrame, rounds: int = 12, heat: float = 0.1, grid: int = 32) -> DataFrame:
    """`rounds` steps from the given places with heat falling evenly to nothing, on the scale that the places have at first; each round is written once."""
    e, places = written(e, "pulls"), written(jittered(places), "places")
    box = _box(places)
    for i in range(rounds if box is not None else 0):
        places = written(force_round(places, e, heat * (1 - i / rounds), grid, box[2]), "places")
    return places
