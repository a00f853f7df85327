"""Path finders: bounded enumeration, shortest and cheapest paths, single-source and all-pairs distances.

Paths are rows (start, end, length, nodes, rels), cheapest ones with weight.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import chord_km
from ..graph import Expander, PropertyGraph
from ..plans.steps import keyed, settled, superseded
from .traversal import NODE_PATH, RELATIONSHIP_PATH, Traversal, reach

PATH = ["start", "end", "length", "nodes", "rels"]


def _start(graph: PropertyGraph, node_id: int) -> DataFrame:
    return graph.node(node_id).select("id")


def _as_paths(positions: DataFrame) -> DataFrame:
    return positions.select(F.col("root").alias("start"), F.col("node").alias("end"), F.col("depth").alias("length"), "nodes", "rels")


def single(paths: DataFrame) -> DataFrame:
    """One path: the lightest or shortest, then the one with the smallest relationships."""
    by = ["weight"] if "weight" in paths.columns else ["length"]
    return paths.orderBy(*by, "length", "rels").limit(1)


def _meeting(graph: PropertyGraph, start: int, end: int, expander: Expander, kind: str, lengths: range) -> DataFrame:
    """Paths of these lengths from two half searches: the longer half comes from the start."""
    top = max(lengths, default=-1)
    if top < 0:
        return _as_paths(Traversal(expander, max_depth=0).traverse(graph, _start(graph, start).limit(0)))
    ahead = Traversal(expander, kind, max_depth=top - top // 2).traverse(graph, _start(graph, start))
    back = Traversal(expander.reversed(), kind, max_depth=top // 2).traverse(graph, _start(graph, end))
    a = ahead.select("root", "node", F.col("depth").alias("d1"), F.col("nodes").alias("n1"), F.col("rels").alias("r1"))
    b = back.select(F.col("root").alias("end"), "node", F.col("depth").alias("d2"), F.reverse("nodes").alias("n2"), F.reverse("rels").alias("r2"))
    # Each path is met once, in its middle.
    met = a.join(b, "node").where((F.col("d1") - F.col("d2")).isin(0, 1) & (F.col("d1") + F.col("d2")).isin(*lengths))
    met = met.where(F.size(F.array_intersect("n1", "n2")) == 1 if kind == NODE_PATH else ~F.arrays_overlap("r1", "r2"))
    nodes = F.concat("n1", F.slice("n2", 2, F.greatest(F.size("n2") - 1, F.lit(0))))
    return met.select(F.col("root").alias("start"), "end", (F.col("d1") + F.col("d2")).alias("length"), nodes.alias("nodes"), F.concat("r1", "r2").alias("rels"))


def all_paths(graph: PropertyGraph, start: int, end: int, expander: Expander, max_depth: int) -> DataFrame:
    """Every trail: no relationship twice."""
    return _meeting(graph, start, end, expander, RELATIONSHIP_PATH, range(max_depth + 1))


def simple_paths(graph: PropertyGraph, start: int, end: int, expander: Expander, max_depth: int) -> DataFrame:
    """Every path without a node twice."""
    return _meeting(graph, start, end, expander, NODE_PATH, range(max_depth + 1))


def exact_depth(graph: PropertyGraph, start: int, end: int, expander: Expander, depth: int) -> DataFrame:
    """All trails of just this length."""
    return _meeting(graph, start, end, expander, RELATIONSHIP_PATH, range(depth, depth + 1))


def hop_distances(graph: PropertyGraph, sources: DataFrame, expander: Expander, max_depth: int | None = None, target: DataFrame | None = None) -> DataFrame:
    """(source, node, dist) of every node that each source (column id) reaches, level by level; with `target` (column node) not beyond its level."""
    got = reach(graph.adjacency(expander), sources, max_depth, target)
    out = got.select(F.col("root").alias("source"), "node", F.col("depth").alias("dist"))
    out._step = got._step
    return out


def _back(graph: PropertyGraph, dist: DataFrame, ends: DataFrame, expander: Expander, cost: Column | None) -> DataFrame:
    """Paths along relationships whose cost is just the difference of the distances, built from their ends backwards."""
    steps = graph.adjacency(expander, keep=["w"] if cost is not None else [])
    w = F.col("w") if cost is not None else F.lit(1)
    d1, d2 = (dist.select("source", F.col("node").alias(n), F.col("dist").alias(d)) for n, d in (("frm", "d1"), ("to", "d2")))
    close = F.abs(F.col("d1") + w - F.col("d2")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("d2"))
    dag = settled(steps.join(d1, "frm").join(d2, ["source", "to"]).where(close).select("source", "frm", "to", "eid"), "dag")
    tip = dist.join(ends, "node", "left_semi").select("source", F.col("node").alias("end"), "node", F.array("node").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("rels"))
    done = []
    while True:
        done.append(tip.where("node = source"))
        more = tip.where("node <> source").join(dag, (tip["source"] == dag["source"]) & (tip["node"] == dag["to"])).where(~F.array_contains("nodes", F.col("frm")))
        tip = settled(more.select(tip["source"], "end", F.col("frm").alias("node"), F.concat(F.array("frm"), "nodes").alias("nodes"), F.concat(F.array("eid"), "rels").alias("rels")), "tip")
        if tip.isEmpty():
            break
    return reduce(DataFrame.union, done).select(F.col("source").alias("start"), "end", F.size("rels").alias("length"), "nodes", "rels")


def shortest_paths(graph: PropertyGraph, start: int, end: int, expander: Expander, max_depth: int | None = None) -> DataFrame:
    """All paths with the fewest relationships; parallel ones count each. The search ends on the level of the end."""
    goal = _start(graph, end).toDF("node")
    return _back(graph, hop_distances(graph, _start(graph, start), expander, max_depth, goal), goal, expander, None)


def distances(graph: PropertyGraph, sources: DataFrame, cost: Column, expander: Expander, max_cost: float | None = None, target: int | None = None, estimate: Column | None = None, max_depth: int | None = None, accumulate: Callable[[Column, Column], Column] = lambda a, b: a + b) -> DataFrame:
    """(source, node, dist): least sums of `cost`, a column of the relationships that must not be negative.

    Each round relaxes the relationships of the nodes that got cheaper in the
    last one. With a `target` only nodes are followed whose cost, with the
    `estimate` of what is left (a column of nodes, never too high), is less than
    the least cost of the target that is known by then; distances of nodes that
    cannot lie on a cheapest path to it may then be missing or too high.
    `max_depth` bounds the relationships of a path. `accumulate` joins the cost
    so far and that of a relationship, by default their sum; it must never give
    less than the cost so far (F.greatest: the dearest relationship of a path).
    """
    g = PropertyGraph(graph.nodes, graph.edges.withColumn("w", cost.cast("double")))
    if not g.edges.where("w < 0 or w is null").isEmpty():
        raise ValueError("costs have to be given and not negative")
    adj = keyed(g.adjacency(expander, keep=["w"]).groupBy("frm", "to").agg(F.min("w").alias("w")), "frm", "adjacency")
    left = graph.nodes.select(F.col("id").alias("node"), F.greatest(F.lit(0.0), estimate.cast("double")).alias("left")) if estimate is not None else None
    dist = settled(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist")).distinct(), "dist")
    # Where few relationships leave any node, a round relaxes several in a row.
    stride = 4 if max_depth is None and (adj.groupBy("frm").count().agg(F.max("count")).first()[0] or 0) <= 2 else 1
    tip, rounds = dist, 0
    while max_depth is None or rounds < max_depth:
        rounds += 1
        step, found = tip, []
        for _ in range(stride):
            step = step.join(adj, F.col("node") == F.col("frm")).select("source", F.col("to").alias("node"), accumulate(F.col("dist"), F.col("w")).alias("dist"))
            step = step if max_cost is None else step.where(F.col("dist") <= max_cost)
            found.append(step)
        new = reduce(DataFrame.union, found).groupBy("source", "node").agg(F.min("dist").alias("new"))
        both = settled(dist.join(new, ["source", "node"], "full_outer").select("source", "node", F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("better")), "dist")
        superseded(dist)
        dist = both.select("source", "node", "dist")
        dist._step = both._step
        tip = both.where("better").select("source", "node", "dist")
        if target is not None:
            best = dist.where(F.col("node") == target).select("source", F.col("dist").alias("best"))
            tip = tip.join(best, "source", "left")
            tip = tip.join(left, "node", "left") if left is not None else tip.withColumn("left", F.lit(0.0))
            tip = tip.where(F.col("best").isNull() | (F.col("dist") + F.coalesce("left", F.lit(0.0)) <= F.col("best"))).where(F.col("node") != target).select("source", "node", "dist")
        if tip.isEmpty():
            break
    superseded(adj)
    return dist


def cheapest_paths(graph: PropertyGraph, start: int, end: int, cost: Column, expander: Expander, max_cost: float | None = None, estimate: Column | None = None) -> DataFrame:
    """All paths with the least cost, with their weight; no node twice where costs are zero. The search follows nothing dearer than the end."""
    dist = distances(graph, _start(graph, start), cost, expander, max_cost, end, estimate)
    g = PropertyGraph(graph.nodes, graph.edges.withColumn("w", cost.cast("double")))
    paths = _back(g, dist, _start(graph, end).toDF("node"), expander, cost)
    return paths.join(dist.select(F.col("node").alias("end"), F.col("dist").alias("weight")), "end").select(*PATH, "weight")


def a_star(graph: PropertyGraph, start: int, end: int, cost: Column, expander: Expander, estimate: Column | None = None, bound: float | None = None) -> DataFrame:
    """One cheapest path. `estimate`, a column of nodes, never exceeds the cost that is left to the end: nodes are followed while cost and estimate together can beat the best way known."""
    return single(cheapest_paths(graph, start, end, cost, expander, bound, estimate))


def geo_estimate(graph: PropertyGraph, end: int, lat: str = "lat", lon: str = "lon") -> Column:
    """The straight distance in km of a node to the end, as an estimate for costs in km."""
    goal = graph.node(end).select(lat, lon).first()
    return chord_km(F.col(lat), F.col(lon), F.lit(goal[0]), F.lit(goal[1]))


def cheapest_between(graph: PropertyGraph, start: int, end: int, cost: Column, expander: Expander, max_cost: float | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, weight): the least cost between two nodes, and the nodes where cheapest paths from both sides meet.

    Two searches, each bounded by the other's best known sum; nothing is
    returned if the ends don't meet within the bounds.
    """
    one = distances(graph, _start(graph, start), cost, expander, max_cost, end, max_depth=max_depth)
    best = one.where(F.col("node") == end).agg(F.min("dist")).first()[0]
    if best is None:
        return one.select("node", F.col("dist").alias("weight")).limit(0)
    two = distances(graph, _start(graph, end), cost, expander.reversed(), best, start, max_depth=max_depth)
    both = one.select("node", F.col("dist").alias("a")).join(two.select("node", F.col("dist").alias("b")), "node")
    return both.where(F.abs(F.col("a") + F.col("b") - best) <= 1e-9 * max(1.0, best)).select("node", (F.col("a") + F.col("b")).alias("weight"))


def predecessors(graph: PropertyGraph, dist: DataFrame, expander: Expander, cost: Column | None = None) -> DataFrame:
    """(source, node, pred, eid): the last relationships of all shortest or cheapest paths."""
    g = graph if cost is None else PropertyGraph(graph.nodes, graph.edges.withColumn("w", cost.cast("double")))
    adj = g.adjacency(expander, keep=[] if cost is None else ["w"])
    w = F.lit(1) if cost is None else F.col("w")
    d1, d2 = (dist.select("source", F.col("node").alias(n), F.col("dist").alias(d)) for n, d in (("frm", "d1"), ("to", "d2")))
    close = F.abs(F.col("d1") + w - F.col("d2")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("d2"))
    return adj.join(d1, "frm").join(d2, ["source", "to"]).where(close & (F.col("to") != F.col("source"))).select("source", F.col("to").alias("node"), F.col("frm").alias("pred"), "eid")


def path_counts(graph: PropertyGraph, dist: DataFrame, expander: Expander, dag: DataFrame | None = None) -> DataFrame:
    """(source, node, dist, paths): how many shortest paths lead to each node. `dist` comes from hop_distances, `dag` from predecessors."""
    dist = dist if "_step" in vars(dist) else settled(dist, "dist")
    dag = settled(predecessors(graph, dist, expander).select("source", "node", "pred"), "dag") if dag is None else dag
    top = dist.agg(F.max("dist")).first()[0] or 0
    levels = [dist.where("dist = 0").select("source", "node", "dist", F.lit(1).cast("long").alias("paths"))]
    for k in range(1, top + 1):
        before = levels[-1].select("source", F.col("node").alias("pred"), "paths")
        here = dag.join(before, ["source", "pred"]).groupBy("source", "node").agg(F.sum("paths").alias("paths"))
        levels.append(settled(here.select("source", "node", F.lit(k).alias("dist"), "paths"), "paths"))
    return reduce(DataFrame.union, levels)


def all_pairs(graph: PropertyGraph, cost: Column, expander: Expander) -> DataFrame:
    """(i, j, dist, pred) between all nodes that reach each other, by min-plus doubling until nothing gets less.

    A node is at distance 0 from itself. `pred` is the node before j on a
    cheapest path, the smallest of them; null for i itself. The result has a row
    for each pair, so that this is for graphs of some thousand nodes: larger
    ones ask for distances() of the sources that matter.
    """
    g = PropertyGraph(graph.nodes, graph.edges.withColumn("w", cost.cast("double")))
    if not g.edges.where("w < 0 or w is null").isEmpty():
        raise ValueError("costs have to be given and not negative")
    none = F.lit(None).cast("bigint")
    own = graph.nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("dist"), none.alias("pred"))
    one = g.adjacency(expander, keep=["w"]).where("frm <> to").select(F.col("frm").alias("i"), F.col("to").alias("j"), F.col("w").alias("dist"), F.col("frm").alias("pred"))
    least = F.min(F.struct("dist", "pred"))
    d = settled(own.union(one.groupBy("i", "j").agg(F.min("dist").alias("dist"), F.min_by("pred", F.struct("dist", "pred")).alias("pred"))), "pairs")
    state = None
    while True:
        left = d.select("i", F.col("j").alias("k"), F.col("dist").alias("a"), F.col("pred").alias("p"))
        right = d.select(F.col("i").alias("k"), "j", F.col("dist").alias("b"), F.col("pred").alias("q"))
        # Where the second half is empty, the first one's predecessor stands.
        met = left.join(right, "k").select("i", "j", (F.col("a") + F.col("b")).alias("dist"), F.coalesce("q", "p").alias("pred"))
        new = settled(met.where("i <> j").groupBy("i", "j").agg(least.alias("x")).select("i", "j", "x.dist", "x.pred").union(own), "pairs")
        now = tuple(new.agg(F.count("*"), F.sum("dist"), F.sum("pred")).first())
        superseded(d)
        d = new
        if now == state:
            return d
        state = now


def path_of(pairs: DataFrame, i: int, j: int) -> list[int]:
    """The nodes of a cheapest path between two nodes from a table of all pairs; empty if there is none. As many look-ups as the path is long."""
    out, at = [], j
    while True:
        row = pairs.where((F.col("i") == i) & (F.col("j") == at)).first()
        if row is None:
            return []
        if at in out:
            raise ValueError("costs of zero lead around")
        out.append(at)
        if at == i:
            return out[::-1]
        at = row["pred"]
