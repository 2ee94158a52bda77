"""The cosine similarity graph: neighbours, edges, degrees, components, noise, and language guards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

NEIGHBOURS, THRESHOLD, RESOLUTION = 16, 0.89, 0.9
BLOCK = 2048  #: nodes of a block; two blocks are one matrix product
#: Fixed values of the language guard.
LIFT, FLOOR, SPLIT_LIFT, CEILING, GUARD_SIZE, GUARD_SHARE = 0.08, 0.78, 0.06, 0.98, 4, 0.75


def clamp(threshold: float | None, low: float = 0.6, high: float = 1.0) -> float:
    """X24."""
    return THRESHOLD if threshold is None else min(high, max(low, float(threshold)))


def unit_vectors(df: DataFrame, node: str, vector: str, *keep: str) -> DataFrame:
    return df.select(F.col(node).alias("node"), X.unit(F.col(vector)).alias("v"), *keep)


def block_top(k: int, lowest: float | None = None):
    """Top k of the right block for every node of the left, in double precision; ties go to the lower node. lowest: only pairs at least as similar."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        right = right.sort_values("node")
        ids, nodes = right["node"].to_numpy(), left["node"].to_numpy()
        sims = np.round(np.stack(left["v"].to_numpy()) @ np.stack(right["v"].to_numpy()).T, 12)  # a product's last bits depend on the block; equal vectors must tie
        sims[nodes[:, None] == ids[None, :]] = -np.inf
        least = np.partition(sims, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(nodes), -np.inf)
        if lowest is not None:
            least = np.maximum(least, lowest)
        row, col = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))  # the k best and all that tie with the last of them
        order = np.lexsort((col, -sims[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        return pd.DataFrame({"a": nodes[row], "b": ids[col], "sim": sims[row, col]})

    return run


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, nodes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, sim, rank): the k most similar other nodes of each node, ties by node.

    Nodes are dealt into blocks of about `block` by hash; every pair of blocks is one bounded matrix product that
    returns k rows a node, and a second selection keeps the k best over all blocks.
    """
    nodes = vectors.count() if nodes is None else nodes
    blocks = max(1, -(-nodes // block))
    placed = vectors.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = placed.select("node", "v", F.col("own").alias("i"), every.alias("j"))
    right = placed.select("node", "v", F.col("own").alias("j"), every.alias("i"))
    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda x, y: block_top(k)(x, y), "a long, b long, sim double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def language_threshold(base: float) -> float:
    return min(CEILING, max(base + LIFT, FLOOR))


def split_threshold(base: float) -> float:
    return min(CEILING, language_threshold(base) + SPLIT_LIFT)


def directed(near: DataFrame, threshold: float, languages: DataFrame | None = None) -> DataFrame:
    """Neighbour pairs at the threshold; pairs of one language other than English need the higher one.

    languages: node, lang (null or blank where unknown).
    """
    if languages is None:
        return near.where(F.col("sim") >= threshold).select("a", "b", "sim")
    lang = languages.select("node", F.when(~X.fold(X.strip(F.col("lang"))).isin("", "auto"), X.fold(X.strip(F.col("lang")))).alias("l"))
    d = near.join(lang.select(F.col("node").alias("a"), F.col("l").alias("la")), "a", "left").join(lang.select(F.col("node").alias("b"), F.col("l").alias("lb")), "b", "left")
    same = F.coalesce((F.col("la") == F.col("lb")) & (F.col("la") != "en"), F.lit(False))
    return d.where(F.col("sim") >= F.when(same, language_threshold(threshold)).otherwise(threshold)).select("a", "b", "sim")


def edges(pairs: DataFrame, mutual: bool = True, compat: bool = False) -> DataFrame:
    """Undirected (src, dst, weight), src < dst, weight the lower of the two similarities.

    mutual: both nodes must be neighbours of each other. Without it, compat leaves out edges that only the
    higher node has.
    """
    g = pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("sim").alias("weight"), F.count("*").alias("n"), F.max((F.col("a") < F.col("b")).cast("int")).alias("forward"))
    if mutual:
        g = g.where("n = 2")
    elif compat:
        g = g.where("forward = 1")
    return g.select("src", "dst", "weight")


def exported(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", F.bround("weight", 6).alias("weight"))


def degrees(e: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """Node, degree (sum of weights, none below 0) and neighbours; with assigned (node, community) inside communities only."""
    if assigned is not None:
        s, d = (assigned.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
        e = e.join(s, "src").join(d, "dst").where("c_src = c_dst")
    w = F.greatest(F.col("weight"), F.lit(0.0)).alias("w")
    both = e.select(F.col("src").alias("node"), w).unionByName(e.select(F.col("dst").alias("node"), w))
    return both.groupBy("node").agg(F.sum("w").alias("degree"), F.count("*").alias("neighbours"))


def shared_checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the folder that spark.checkpoint.dir names. Where none is set a local master gets a temporary folder; on a cluster that is an error."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    spark.sparkContext.setCheckpointDir(base)


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    shared_checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with a short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MOST_GROUPS = 50_000  #: rows of a table of groups up to which it is broadcast


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows joined (inner) with a table of one row per key.

    Up to MOST_GROUPS rows the table is broadcast. Beyond, keys with more than an eighth of a mean partition's rows come by
    broadcast (there are at most eight a partition, whatever the data), all others by a shuffle, so no hot key is one task.
    """
    keys = list(keys)
    groups = written(groups, "groups")
    if groups.count() <= MOST_GROUPS:
        return rows.join(F.broadcast(groups), keys)
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("__n")), "sizes")
    most = (sizes.agg(F.sum("__n")).first()[0] or 0) / (8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(sizes.where(F.col("__n") > most).select(*keys))
    return rows.join(F.broadcast(groups.join(hot, keys, "left_semi")), keys).unionByName(rows.join(hot, keys, "left_anti").join(groups, keys))


def components(e: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (the smallest node reachable), by alternating stars.

    A round hangs every node's greater neighbours on the least of its neighbours, then its lesser ones, so trees get flat in a number of
    rounds that grows with the logarithm of the size. Each round is written once; rounds end when every node hangs on a node that hangs on none. nodes adds those without an edge.
    """
    current = written(e.select(F.greatest("src", "dst").alias("x"), F.least("src", "dst").alias("y")).where("x <> y").distinct(), "stars")
    while True:
        both = current.unionByName(current.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = written(both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "large")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        current = written(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "stars")
        # stars: no node hangs on two, and what nodes hang on hangs on nothing
        open_ = current.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x").unionByName(current.select(F.col("y").alias("x")).join(current.select("x"), "x", "left_semi"))
        if open_.isEmpty():
            break
    roots = current.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    found = current.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(roots)
    if nodes is not None:
        found = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return found


def named_communities(assigned: DataFrame, nodes: int) -> DataFrame:
    """Communities renumbered from 0 by (size descending, smallest node); noise is -1.

    A community of one node is noise always, one of two where there are five nodes or more.
    """
    sizes = assigned.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    real = (F.col("size") >= 2) & (F.lit(nodes < 5) | (F.col("size") >= 3))
    order = Window.orderBy(F.desc("size"), "least")
    kept = sizes.where(real).withColumn("id", F.row_number().over(order) - 1)
    return assigned.join(kept.select("community", "id"), "community", "left").select("node", F.coalesce("id", F.lit(-1)).cast("long").alias("community"))


def dominant_language(assigned: DataFrame, languages: DataFrame) -> DataFrame:
    """Community, lang of communities of four nodes or more, three quarters of one language other than English."""
    d = assigned.join(languages, "node", "left").withColumn("l", F.lower(F.trim("lang")))
    sizes = d.groupBy("community").agg(F.count("*").alias("size"))
    by = d.where("l is not null and l not in ('', 'auto', 'en')").groupBy("community", "l").agg(F.count("*").alias("n"))
    best = by.groupBy("community").agg(F.max(F.struct("n", "l")).alias("b")).select("community", "b.*")
    return best.join(sizes, "community").where((F.col("size") >= GUARD_SIZE) & (F.col("n") >= GUARD_SHARE * F.col("size"))).select("community", F.col("l").alias("lang"))


def split_by_language(assigned: DataFrame, e: DataFrame, languages: DataFrame, threshold: float) -> DataFrame:
    """Language-dominated communities fall apart into the components of their strong edges."""
    weak = dominant_language(assigned, languages).select("community")
    inside = assigned.join(weak, "community", "left_semi")
    s, d = (assigned.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    strong = e.where(F.col("weight") >= split_threshold(threshold)).join(s, "src").join(d, "dst").where("c_src = c_dst").select("src", "dst", "weight")
    parts = components(strong, inside.select("node"))
    cut = inside.join(parts, "node").select("node", F.col("component").alias("community"))
    rest = assigned.join(weak, "community", "left_anti")
    # communities are named by their smallest node, so parts and rest can't clash
    least = rest.groupBy("community").agg(F.min("node").alias("least"))
    return rest.join(least, "community").select("node", F.col("least").alias("community")).unionByName(cut)


def plot_points(assigned: DataFrame, positions: DataFrame, rows: DataFrame) -> DataFrame:
    """Node, row_number, community, x, y of nodes that have a row and a position; places to 6 decimals."""
    return assigned.join(positions, "node").join(rows, "node").where("row_number > 0").select("node", "row_number", "community", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


def plot_edges(e: DataFrame, points: DataFrame) -> DataFrame:
    """Edges whose ends are both plotted, with their row numbers."""
    s, d = (points.select(F.col("node").alias(n), F.col("row_number").alias(f"{n}_row"), F.col("community").alias(f"{n}_community")) for n in ("src", "dst"))
    return exported(e).join(s, "src").join(d, "dst")


def assigned_counts(rows: DataFrame) -> DataFrame:
    """Respondents with any fragment in a real community, and those without. rows: row_number, community."""
    per = rows.groupBy("row_number").agg(F.max((F.col("community") >= 0).cast("int")).alias("real"))
    return per.agg(F.count_if(F.col("real") == 1).alias("assigned"), F.count_if(F.col("real") == 0).alias("unassigned"))


def circle(nodes: DataFrame) -> DataFrame:
    """G09 without edges: places on a circle, by a hash of the node."""
    turn = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) / 1_000_000 * 2 * np.pi
    return nodes.select("node", F.cos(turn).alias("x"), F.sin(turn).alias("y"))


def principal_axes(vectors: DataFrame, count: int, width: int | None = None, passes: int = 6) -> np.ndarray | None:
    """The `count` principal directions of the vectors as columns, the strongest last, found by subspace iteration; None where there is no vector.

    A pass multiplies the vectors' covariance by `width` directions within the tasks, so d rows of `width` sums come to
    the driver, whatever the number of vectors.
    """
    head = vectors.select("v").first()
    if head is None:
        return None
    d = len(head["v"])
    width = min(width or count + 6, d)
    columns = [f"m{j}" for j in range(width + 1)]

    def times(basis: np.ndarray) -> np.ndarray:
        """The covariance matrix times the basis."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, n = np.zeros((d + 1, width + 1)), 0
            for b in batches:
                x = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, d))
                sums[:d, :width] += x.T @ (x @ basis)
                sums[:d, width] += x.sum(axis=0)
                n += len(x)
            sums[d, width] = n
            if n:
                yield pd.DataFrame(sums, columns=columns).assign(i=np.arange(d + 1, dtype="int32"))

        made = vectors.select("v").mapInPandas(run, ", ".join(f"{c} double" for c in columns) + ", i int")
        m = made.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("i").toPandas()[columns].to_numpy()  # d + 1 rows
        n = m[d, width]
        mean = m[:d, width] / n
        return m[:d, :width] / n - np.outer(mean, mean @ basis)

    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((d, width)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(times(basis))[0]
    axes = basis @ np.linalg.eigh(basis.T @ times(basis))[1]
    return axes[:, -min(count, width) :]


def principal_layout(vectors: DataFrame, width: int = 8, passes: int = 6) -> DataFrame:
    """Places by the two principal directions of the vectors. No vectors: no rows."""
    axes = principal_axes(vectors, 2, width, passes)
    if axes is None:
        return vectors.select("node", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    picked = [axes[:, -min(k, axes.shape[1])] for k in (1, 2)]
    x, y = (F.array(*[F.lit(float(v)) for v in a * (1 if a[np.argmax(np.abs(a))] > 0 else -1)]) for a in picked)
    return vectors.select("node", X.dot(F.col("v"), x).alias("x"), X.dot(F.col("v"), y).alias("y"))


def pulled_layout(places: DataFrame, e: DataFrame, rounds: int = 2, pull: float = 0.5) -> DataFrame:
    """Places after each edge has pulled its ends: a node goes `pull` of the way to the weighted mean of its neighbours, every round.

    Nodes without an edge of positive weight stay. A round is one aggregation over the edges.
    """
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("weight > 0")
    for _ in range(rounds):
        near = both.join(places.toDF("dst", "__x", "__y"), "dst").groupBy("src").agg(*[(F.sum(F.col("weight") * F.col(f"__{c}")) / F.sum("weight")).alias(f"__{c}") for c in "xy"])
        moved = [F.coalesce(F.col(c) + pull * (F.col(f"__{c}") - F.col(c)), F.col(c)).alias(c) for c in "xy"]
        places = places.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", *moved)
    return places


def similarity_edges(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, mutual: bool = True, languages: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Edges of all pairs at the threshold that are among their k nearest; cells that can't hold such a pair aren't compared. They are found once and written."""
    from .neighbours import neighbours_above

    return written(edges(directed(neighbours_above(vectors, threshold, k), threshold, languages), mutual, compat), "edges")
