"""Communities of the similarity graph by modularity with a resolution: local moves, refinement and condensation in rounds over tables.

Nodes are dealt by hash into blocks of a bounded number of edges. In a round each block is one group: its nodes move, one after
the other until none gains, to the neighbouring community with the highest gain, are condensed and move again, while the rest of the graph
stands as the round found it. A round in which several blocks moved counts only if modularity rose; else fewer blocks move at once. When no
round gains, communities are refined: every node starts anew on its own and may join others of its community
only, and what it joins to is condensed to a node of the next, smaller graph, which starts from the communities found so far.
So a graph of any size and shape takes the same steps; a graph of one block is a round whose moves see everything.

Weights are whole numbers, blocks follow from nodes, and nodes move in order, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph as G

BLOCK_EDGES = 100_000  #: directed edges of a block of nodes, on average
UNIT = 1 << 26  #: weights are whole numbers of 1 / UNIT, so that sums don't depend on their order
LEAST_RISE = 1e-6  #: modularity that a round must add
LATE = 0.01  #: of what a graph's rounds have added; a round of all blocks that adds less is the last, as the smaller graph goes on from there
STALLS = 4  #: rounds in a row that add nothing, each with half the blocks of the one before, after which moves end
GROWTH = 0.125  #: of its strength that a pair which joins may take up besides in a round
LEVELS = 30  #: graphs that are condensed in turn at most; each has fewer nodes than the one before


class Block:
    """A block's nodes, or what they are condensed to, as items 0, 1, ...: their links to each other and to communities of the rest of the graph, which stands still."""

    def __init__(self, strength: list[float], community: list[int], links: list[dict[int, float]], outer: list[dict[int, float]], weight: dict[int, float], scale: float):
        self.strength, self.community, self.links, self.outer, self.weight = strength, community, links, outer, weight
        self.scale = scale  #: resolution / (2 * total)

    def move(self) -> bool:
        """Items go to the neighbouring community with the highest gain, until none gains."""
        weight, community, any_moved = self.weight, self.community, False
        queue, queued = deque(range(len(community))), [True] * len(community)
        while queue:
            n = queue.popleft()
            queued[n] = False
            own, k = community[n], self.strength[n]
            near: dict[int, float] = defaultdict(float, self.outer[n])
            near[own] += 0
            for m, w in self.links[n].items():
                near[community[m]] += w
            weight[own] -= k
            best = max(near, key=lambda c: (round((near[c] - k * weight[c] * self.scale) / UNIT, 12), c == own, -c))
            weight[best] += k
            if best != own:
                community[n], any_moved = best, True
                for m in self.links[n]:
                    if community[m] != best and not queued[m]:
                        queue.append(m)
                        queued[m] = True
        return any_moved

    def move_alone(self) -> None:
        """Refinement across blocks: every item that is alone in its community joins the one it gains most by."""
        size: dict[int, int] = defaultdict(int)
        for c in self.community:
            size[c] += 1
        for n, k in enumerate(self.strength):
            own = self.community[n]
            if size[own] > 1:
                continue
            near: dict[int, float] = defaultdict(float, self.outer[n])
            for m, w in self.links[n].items():
                near[self.community[m]] += w
            gain = {c: round((w - k * self.weight[c] * self.scale) / UNIT, 12) for c, w in near.items() if c != own}
            best = max(gain, key=lambda c: (gain[c], -c), default=own)
            if best != own and gain[best] > 0:
                self.community[n] = best
                self.weight[own] -= k
                self.weight[best] += k
                size[own] -= 1
                size[best] += 1

    def parts(self) -> list[int]:
        """Refinement: items start on their own, and each that still is may join the part of its community it gains most by. A part is called after an item."""
        part, size = list(range(len(self.strength))), list(self.strength)
        alone = [True] * len(part)
        for n, k in enumerate(self.strength):
            if not alone[n]:
                continue
            near: dict[int, float] = defaultdict(float)
            for m, w in self.links[n].items():
                if self.community[m] == self.community[n]:
                    near[part[m]] += w
            gain = {c: round((w - k * size[c] * self.scale) / UNIT, 12) for c, w in near.items() if c != n}
            best = max(gain, key=lambda c: (gain[c], -c), default=n)
            if best != n and gain[best] > 0:
                part[n], alone[best] = best, False
                size[best] += k
        return part

    def condensed(self, part: list[int]) -> tuple[Block, list[int]]:
        """The block of the parts, and the item that each item is now in."""
        number = {c: i for i, c in enumerate(sorted(set(part)))}
        to = [number[c] for c in part]
        strength, community = [0.0] * len(number), [0] * len(number)
        links: list[dict[int, float]] = [defaultdict(float) for _ in number]
        outer: list[dict[int, float]] = [defaultdict(float) for _ in number]
        for n, t in enumerate(to):
            strength[t] += self.strength[n]
            community[t] = self.community[n]
            for m, w in self.links[n].items():
                if to[m] != t:
                    links[t][to[m]] += w
            for c, w in self.outer[n].items():
                outer[t][c] += w
        return Block(strength, community, links, outer, self.weight, self.scale), to


def moved(nodes: pd.DataFrame, edges: pd.DataFrame, total: float, resolution: float, refine: bool) -> list[int]:
    """The communities of a block's nodes after moves, or with refine their parts, in the order of nodes.

    nodes: node, k (strength), community, kc (strength of that community), home (the community that a refined node may not leave), in the order of node.
    edges: x (of the block), y, w, and the community, its strength and the home of y. Without refine the block is moved, refined and condensed
    until its items don't get fewer.
    """
    names = nodes["node"].tolist()
    at = {n: i for i, n in enumerate(names)}
    own = nodes["community"].tolist()
    home = nodes["home"].tolist()
    weight = dict(zip(own, nodes["kc"].tolist()))
    weight.update(zip(edges["cy"].tolist(), edges["kcy"].tolist()))
    links: list[dict[int, float]] = [{} for _ in names]
    outer: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for x, y, w, cy, hy in zip(edges["x"].tolist(), edges["y"].tolist(), edges["w"].tolist(), edges["cy"].tolist(), edges["hy"].tolist()):
        n = at[x]
        if refine and hy != home[n]:
            continue
        if y in at:
            links[n][at[y]] = w
        else:
            outer[n][cy] += w
    block = Block(nodes["k"].astype(float).tolist(), own, links, outer, weight, resolution / (2 * total))
    if refine:
        block.move_alone()
        return block.community
    item = list(range(len(names)))
    while True:
        block.move()
        smaller, to = block.condensed(block.parts())
        item = [to[i] for i in item]
        if len(smaller.strength) == len(block.strength):
            return [block.community[i] for i in item]
        block = smaller


def modularity(edges: list[tuple[int, int, float]], community: dict[int, int], resolution: float) -> float:
    """Of a small graph; the tables' is modularity_of()."""
    total = sum(w for *_, w in edges)
    inside, strength = 0.0, defaultdict(float)
    for a, b, w in edges:
        inside += w if community[a] == community[b] else 0.0
        strength[community[a]] += w
        strength[community[b]] += w
    return inside / total - resolution * sum((s / (2 * total)) ** 2 for s in strength.values())


def modularity_of(edges: DataFrame, assigned: DataFrame, resolution: float = G.RESOLUTION) -> DataFrame:
    """One row, `modularity`, of edges (src, dst, weight) and assigned (node, community); null without edges."""
    s, d = (assigned.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    placed = edges.join(s, "src").join(d, "dst")
    ends = placed.select("weight", F.explode(F.array("c_src", "c_dst")).alias("c"))
    squares = ends.groupBy("c").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    whole = placed.agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0)).alias("inside"))
    return whole.join(squares).select((F.col("inside") / F.col("total") - resolution * F.col("squares") / (4 * F.col("total") * F.col("total"))).alias("modularity"))  # one row each


def _value(both: DataFrame, nodes: DataFrame, total: float, resolution: float) -> float:
    """Modularity of nodes (node, k, loop, community) and both (x, y, w: each edge in both directions)."""
    to = nodes.select("node", "community")
    inside = both.join(to.toDF("x", "cx"), "x").join(to.toDF("y", "cy"), "y").where("cx = cy").agg((F.sum("w") / (2 * total)).alias("q"))
    own = nodes.groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).select((F.col("loop") / total - resolution * (F.col("k") / (2 * total)) ** 2).alias("q"))
    return inside.unionByName(own).agg(F.sum("q")).first()[0] or 0.0


def _round(both: DataFrame, nodes: DataFrame, blocks: int, turn: int, share: int, total: float, resolution: float, refine: bool) -> DataFrame:
    """nodes with `moved`, after one round in which every share-th block moves. nodes: node, k, loop, community, home."""
    block = F.pmod(F.xxhash64("node"), F.lit(blocks))
    may = F.pmod(F.xxhash64(block, F.lit(turn)), F.lit(share)) == 0
    weights = nodes.groupBy("community").agg(F.sum("k").alias("kc"))
    known = nodes.join(weights, "community")
    others = known.select(F.col("node").alias("y"), F.col("community").alias("cy"), F.col("kc").alias("kcy"), F.col("home").alias("hy"))
    left = known.where(may).select(block.alias("block"), "node", "k", "loop", "community", "kc", "home")
    right = both.withColumn("node", F.col("x")).where(may).join(others, "y").select(block.alias("block"), "x", "y", "w", "cy", "kcy", "hy")

    def run(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node", ignore_index=True)
        found = moved(own, edges.sort_values(["x", "y"]), total, resolution, refine)
        return own[["node", "k", "loop"]].assign(community=found, home=own["home"], moved=own["community"] != found)

    changed = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(lambda a, b: run(a, b), "node long, k long, loop long, community long, home long, moved boolean")
    still = nodes.where(~may).select("node", "k", "loop", "community", "home", F.lit(False).alias("moved"))
    return G.written(changed.unionByName(still), "nodes")


def _settled(both: DataFrame, nodes: DataFrame, blocks: int, total: float, resolution: float, refine: bool = False) -> tuple[DataFrame, bool]:
    """nodes after rounds for as long as modularity rises by more than little, and whether any moved. Of one block a round leaves nothing to gain."""
    if blocks == 1:
        found = _round(both, nodes, 1, 0, 1, total, resolution, refine)
        return found.drop("moved"), not found.where("moved").isEmpty()
    began = value = _value(both, nodes, total, resolution)
    share, turn, stalls, any_moved = 1, 0, 0, False
    while stalls < STALLS:
        following = _round(both, nodes, blocks, turn, share, total, resolution, refine)
        turn += 1
        if following.where("moved").isEmpty():
            if share == 1:
                break
            share, stalls = max(1, share // 2), stalls + 1
            continue
        now = _value(both, following, total, resolution)
        if now - value >= LEAST_RISE:
            late = share == 1 and now - value < LATE * (now - began)
            nodes, value, share, stalls, any_moved = following.drop("moved"), now, max(1, share // 2), 0, True
            if late:
                break
        else:
            share, stalls = share * 2, stalls + 1
    return nodes, any_moved


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = G.RESOLUTION, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """Node, community (named by its smallest node) of every node; those without an edge stand alone. Every community is connected.

    edges: src < dst, weight; edges of no positive weight count for nothing. A graph in which nodes moved is condensed by its refined
    communities; one in which none did by the communities themselves, and where that changes nothing either they are final.
    """
    resolution = max(0.05, resolution)
    e = edges.select("src", "dst", F.bround(F.col("weight") * UNIT).cast("long").alias("w")).where("w > 0")
    start = both = G.written(e.toDF("x", "y", "w").unionByName(e.toDF("y", "x", "w")).groupBy("x", "y").agg(F.sum("w").alias("w")), "links")
    first = G.written(both.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k")), "first")
    total = float((first.agg(F.sum("k")).first()[0] or 0) / 2)
    if not total:
        return nodes.select("node", F.col("node").alias("community"))
    at = first.select("node", "k", F.lit(0).cast("long").alias("loop"), F.col("node").alias("community"), F.col("node").alias("home"))
    member = first.select("node", F.col("node").alias("at"))
    for _ in range(LEVELS):
        blocks = max(1, -(-both.count() // block_edges))
        coarse, any_moved = _settled(both, at, blocks, total, resolution)
        fine = coarse
        if any_moved:
            fine, joined = _settled(both, coarse.withColumns({"home": F.col("community"), "community": F.col("node")}), blocks, total, resolution, refine=True)
            any_moved = joined
        fine = fine if any_moved else coarse.withColumn("home", F.col("community"))
        to = fine.select("node", "community")
        member = G.written(member.join(to.toDF("at", "community"), "at").select("node", F.col("community").alias("at")), "member")
        if not any_moved and to.where("node <> community").isEmpty():
            break
        between = G.written(both.join(to.toDF("x", "cx"), "x").join(to.toDF("y", "cy"), "y").groupBy("cx", "cy").agg(F.sum("w").alias("w")), "between")
        both = between.where("cx <> cy").toDF("x", "y", "w")
        inner = between.where("cx = cy").select(F.col("cx").alias("community"), (F.col("w") / 2).cast("long").alias("inner"))
        merged = fine.groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"), F.min("home").alias("home")).join(inner, "community", "left")
        # a community is called after the least of the parts it is made of
        named = merged.groupBy("home").agg(F.min("community").alias("name"))
        at = merged.join(named, "home").select(F.col("community").alias("node"), "k", (F.col("loop") + F.coalesce("inner", F.lit(0))).alias("loop"), F.col("name").alias("community"), F.col("name").alias("home"))
        at = G.written(at, "nodes")
    assigned = member.select("node", F.col("at").alias("community"))
    s, d = (assigned.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    inside = start.where("x < y").select(F.col("x").alias("src"), F.col("y").alias("dst")).join(s, "src").join(d, "dst").where("c_src = c_dst").select("src", "dst")
    return G.components(inside, nodes).withColumnRenamed("component", "community")  # what no inner path holds together falls apart, which never lowers modularity


def greedy(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Node, community (named by its smallest node), by joining communities pairwise until no join gains.

    In a round every community picks the neighbour that a join with gains most (ties: the smallest names); pairs that pick
    each other join. The pair that gains most of all is always such a pair, so every round joins one at least. Other
    communities that pick one of a pair join it too, those that gain most first, for as long as a join with all that came before gains and
    these add at most GROWTH of the pair's strength; so a community that many pick doesn't take a round for each of them.
    """
    at = edges.select("src", "dst", F.bround(F.col("weight") * UNIT).cast("long").alias("w")).where("w > 0 and src <> dst")
    between = G.written(at.toDF("x", "y", "w").unionByName(at.toDF("y", "x", "w")).groupBy("x", "y").agg(F.sum("w").alias("w")), "between")
    strength = G.written(between.groupBy(F.col("x").alias("c")).agg(F.sum("w").alias("k")), "strength")
    total = float((strength.agg(F.sum("k")).first()[0] or 0) / 2)
    member = strength.select(F.col("c").alias("node"), F.col("c").alias("community"))
    while total:
        gain = F.round(F.col("w") / total - resolution * F.col("kx").cast("double") * F.col("ky") / (2 * total * total), 12)
        rated = between.join(strength.toDF("x", "kx"), "x").join(strength.toDF("y", "ky"), "y").select("x", "y", "kx", "ky", gain.alias("gain")).where("gain > 0")
        key = F.struct("gain", (-F.least("x", "y")).alias("a"), (-F.greatest("x", "y")).alias("b"), "y", "kx", "ky")
        best = G.written(rated.groupBy("x").agg(F.max(key).alias("b")).select("x", "b.y", "b.gain", "b.kx", "b.ky"), "best")
        picked = best.join(best.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"])  # both members of each pair
        ends = picked.select(F.col("x").alias("y"), F.least("x", "y").alias("to"), (F.col("kx") + F.col("ky")).alias("base"))
        fans = best.join(picked.select("x"), "x", "left_anti").join(ends, "y")
        before = F.coalesce(F.sum("kx").over(Window.partitionBy("to").orderBy(F.desc("gain"), "x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        fans = fans.withColumn("before", before).where(F.col("before") + F.col("kx") <= F.col("base") * GROWTH)
        still = F.round(F.col("gain") - resolution * F.col("kx").cast("double") * (F.col("base") + F.col("before") - F.col("ky")) / (2 * total * total), 12)
        # pairs hold themselves too, as what joins them may have a smaller name
        joined = ends.select(F.col("y").alias("c"), "to").unionByName(fans.where(still > 0).select(F.col("x").alias("c"), "to"))
        named = joined.select("c", F.min("c").over(Window.partitionBy("to")).alias("to"))
        pairs = G.written(named.where("c <> to"), "pairs")
        if pairs.isEmpty():
            break
        renamed = lambda df, c: df.join(pairs.withColumnRenamed("c", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        member = G.written(renamed(member, "community"), "member")
        between = G.written(renamed(renamed(between, "x"), "y").where("x <> y").groupBy("x", "y").agg(F.sum("w").alias("w")), "between")
        strength = G.written(renamed(strength, "c").groupBy("c").agg(F.sum("k").alias("k")), "strength")
    return nodes.select("node").join(member, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


Solver = Callable[[DataFrame, DataFrame, float], DataFrame]


def run(vectors: DataFrame, threshold: float | None = None, k: int = G.NEIGHBOURS, resolution: float = G.RESOLUTION, mutual: bool = True, languages: DataFrame | None = None, solver: Solver = communities) -> tuple[DataFrame, DataFrame]:
    """(assigned, edges). assigned: node, community, with -1 for noise, which is all nodes where there is no edge.

    vectors: node, v (unit length); languages: node, lang. solver: communities() or greedy().
    """
    limit = G.clamp(threshold, low=0.0)
    nodes = vectors.select("node")
    count = vectors.count()
    edges = G.similarity_edges(vectors, limit, k, mutual, languages) if count > 1 else None
    if edges is None or edges.isEmpty():
        empty = vectors.sparkSession.createDataFrame([], "src long, dst long, weight double")
        return nodes.select("node", F.lit(-1).cast("long").alias("community")), edges if edges is not None else empty
    found = solver(edges, nodes, resolution)
    if languages is not None:
        found = G.split_by_language(found, edges, languages, limit)
    return G.named_communities(found, count), edges
