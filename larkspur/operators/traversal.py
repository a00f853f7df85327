"""Traversals as bounded loops of joins.

Positions are rows (root, node, depth, last_eid, last_type, nodes, rels,
path_key), with `weight` where relationships have a cost. The adjacency is
written once, bucketed by the node that relationships leave, and the levels of
a traversal are files of one table, against which new positions are held.

NODE_GLOBAL and RELATIONSHIP_GLOBAL are evaluated level by level: of the ways
to reach a node (or relationship) on its first level the one with the smallest
relationships stays; in BEST_FIRST order, the way with the least cost stays.
Orders are sort keys over the result, so the search itself never depends on
them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import BOTH, Direction, Expander, PropertyGraph
from ..plans.steps import keyed, new_path, settled, superseded

NODE_GLOBAL, NODE_PATH, NODE_RECENT = "node_global", "node_path", "node_recent"
RELATIONSHIP_GLOBAL, RELATIONSHIP_PATH, RELATIONSHIP_RECENT = "relationship_global", "relationship_path", "relationship_recent"
NONE = "none"
PRE_DEPTH, POST_DEPTH, PRE_BREADTH, POST_BREADTH = "pre_depth", "post_depth", "pre_breadth", "post_breadth"
BEST_FIRST, LITE_DEPTH = "best_first", "lite_depth"

COLUMNS = ["root", "node", "depth", "last_eid", "last_type", "nodes", "rels", "path_key"]
_STEP = "struct<held:int,type_rank:int,eid:bigint>"


class Levels:
    """The levels of a search as files of one table in the shared folder."""

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.path, self.n = first.sparkSession, new_path(first.sparkSession, "levels"), 0
        self.schema = first.schema
        self.last = self.put(first)

    def put(self, level: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.n}"
        level.write.parquet(path)
        self.n += 1
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


#: Steps that are looked ahead where every node has one way at most; a power of two.
AHEAD = 16


def _chains(adj: DataFrame) -> DataFrame:
    """(frm, path): the next AHEAD nodes of every node, by doubling; `adj` has one row a node at most."""
    ahead, size = adj.select("frm", F.array("to").alias("path")), 1
    while size < AHEAD:
        rest = ahead.select(F.col("frm").alias("__at"), F.col("path").alias("__rest"))
        both = ahead.join(rest, (F.size("path") == size) & (F.element_at("path", -1) == F.col("__at")), "left")
        before, ahead = ahead, settled(both.select("frm", F.concat("path", F.coalesce("__rest", F.expr("cast(array() as array<bigint>)"))).alias("path")), "ahead")
        superseded(before)
        size *= 2
    return ahead


def reach(adjacency: DataFrame, starts: DataFrame, max_depth: int | None = None, target: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): the least number of steps from each start (column id) to every node, or until `target` (column node) is reached by all starts.

    `adjacency` has frm and to. Where few relationships leave any node, several
    steps are one pass.
    """
    adj = keyed(adjacency.select("frm", "to").distinct(), "frm", "adjacency")
    widest = adj.groupBy("frm").count().agg(F.max("count")).first()[0] or 0
    stride = AHEAD if widest <= 1 else 4 if widest == 2 else 1
    ahead = _chains(adj) if widest <= 1 else None
    levels = Levels(starts.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct())
    roots, depth = (levels.last.count(), 0) if target is not None else (0, 0)
    while max_depth is None or depth < max_depth:
        if target is not None and levels.all().join(target, "node", "left_semi").select("root").distinct().count() == roots:
            break
        tip, found = levels.last.where(F.col("depth") == depth).select("root", "node"), []
        steps = min(stride, stride if max_depth is None else max_depth - depth)
        if ahead is not None:
            way = tip.join(ahead, F.col("node") == F.col("frm")).select("root", F.posexplode(F.slice("path", 1, steps)).alias("at", "node"))
            found = [way.select("root", "node", (F.col("at") + depth + 1).alias("depth"))]
        else:
            for k in range(1, steps + 1):
                tip = tip.join(adj, F.col("node") == F.col("frm")).select("root", F.col("to").alias("node"))
                found.append(tip.withColumn("depth", F.lit(depth + k)))
        new = reduce(DataFrame.union, found).groupBy("root", "node").agg(F.min("depth").alias("depth"))
        depth += steps
        new = levels.put(new.join(levels.all().select("root", "node"), ["root", "node"], "left_anti"))
        if new.where(F.col("depth") == depth).isEmpty():
            break
    superseded(ahead)
    superseded(adj)
    out = levels.all()
    out._step = levels.path
    return out


@dataclass(frozen=True)
class Traversal:
    """What to follow, when to stop, what to return.

    `prunes` and `filters` are conditions on position columns (and on columns
    of the node where `with_nodes` names them). A pruned position is still
    returned, not expanded; several prunes stop if any holds, several filters
    return if all hold. The start is never pruned. `recent`: how many nodes or
    relationships the *_RECENT kinds remember, the last ones in breadth-first
    order. `key`: uniqueness of one's own, the value of a column of positions
    that is never visited twice. `cost`: a column of relationships, whose sum
    along the way is a position's weight. `hold`: in LITE_DEPTH order nodes with
    more relationships than this come after their siblings. `order` may also be
    a tuple of columns.
    """

    expander: Expander = Expander()
    uniqueness: str = NODE_GLOBAL
    prunes: tuple[Column, ...] = ()
    filters: tuple[Column, ...] = ()
    order: str | tuple[Column, ...] = PRE_DEPTH
    max_depth: int | None = None
    with_nodes: tuple[str, ...] = ()
    recent: int = 10_000
    key: Column | None = None
    cost: Column | None = None
    hold: int | None = None

    def relationships(self, kind: str, direction: Direction = BOTH) -> Traversal:
        return replace(self, expander=self.expander.add(kind, direction))

    def expand(self, expander: Expander) -> Traversal:
        return replace(self, expander=expander)

    def unique(self, kind: str, recent: int = 10_000) -> Traversal:
        return replace(self, uniqueness=kind, recent=recent)

    def unique_by(self, key: Column) -> Traversal:
        return replace(self, key=key)

    def prune(self, condition: Column) -> Traversal:
        return replace(self, prunes=(*self.prunes, condition))

    def prune_after(self, depth: int) -> Traversal:
        return replace(self, max_depth=depth if self.max_depth is None else min(depth, self.max_depth))

    def filter(self, condition: Column) -> Traversal:
        return replace(self, filters=(*self.filters, condition))

    def filter_any(self, *conditions: Column) -> Traversal:
        return self.filter(reduce(lambda a, b: a | b, conditions))

    def ordered(self, order: str | tuple[Column, ...]) -> Traversal:
        return replace(self, order=order)

    def depth_first(self) -> Traversal:
        return self.ordered(PRE_DEPTH)

    def breadth_first(self) -> Traversal:
        return self.ordered(PRE_BREADTH)

    def best_first(self, cost: Column) -> Traversal:
        return replace(self, order=BEST_FIRST, cost=cost)

    def lite_depth_first(self, threshold: int) -> Traversal:
        return replace(self, order=LITE_DEPTH, hold=threshold)

    @property
    def _columns(self) -> list[str]:
        return COLUMNS + (["weight"] if self.cost is not None else [])

    def reached(self, graph: PropertyGraph, starts: DataFrame) -> DataFrame:
        """(root, node, depth) of NODE_GLOBAL positions without their paths: filters and prunes may use these columns only."""
        if self.uniqueness != NODE_GLOBAL or self.key is not None or self.prunes or self.with_nodes:
            return self.traverse(graph, starts).select("root", "node", "depth")
        out = reach(graph.adjacency(self.expander), starts, self.max_depth)
        for f in self.filters:
            out = out.where(f)
        return out

    def _adjacency(self, graph: PropertyGraph) -> DataFrame:
        g = graph if self.cost is None else PropertyGraph(graph.nodes, graph.edges.withColumn("w", self.cost.cast("double")))
        adj = g.adjacency(self.expander, keep=[] if self.cost is None else ["w"])
        held = F.lit(0)
        if self.hold is not None:
            big = graph.adjacency(self.expander).groupBy("frm").agg(F.count("*").alias("n")).where(F.col("n") > self.hold).select(F.col("frm").alias("to"), F.lit(1).alias("h"))
            adj, held = adj.join(big, "to", "left"), F.coalesce("h", F.lit(0))
        adj = adj.withColumn("held", held)
        return adj if self.max_depth is not None and self.max_depth <= 2 else keyed(adj, "frm", "adjacency")

    def _first(self, starts: DataFrame) -> DataFrame:
        level = starts.select(
            F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("last_eid"), F.lit(None).cast("string").alias("last_type"),
            F.array("id").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("rels"), F.expr(f"cast(array() as array<{_STEP}>)").alias("path_key"),
        ).distinct()
        return level if self.cost is None else level.withColumn("weight", F.lit(0.0))

    def _step(self, tip: DataFrame, adj: DataFrame, first: bool) -> DataFrame:
        """What the positions lead to, before uniqueness over several ways."""
        if self.prunes and not first:
            tip = tip.where(~F.coalesce(reduce(lambda a, b: a | b, self.prunes), F.lit(False)))
        step = tip.select(*self._columns).join(adj, (F.col("node") == F.col("frm")) & ~F.col("eid").eqNullSafe(F.col("last_eid")))
        if self.uniqueness == NODE_PATH:
            step = step.where(~F.array_contains("nodes", F.col("to")))
        elif self.uniqueness == RELATIONSHIP_PATH:
            step = step.where(~F.array_contains("rels", F.col("eid")))
        more = [(F.col("weight") + F.col("w")).alias("weight")] if self.cost is not None else []
        return step.select(
            "root", F.col("to").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("eid").alias("last_eid"), F.col("type").alias("last_type"),
            F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("rels", F.col("eid")).alias("rels"),
            F.array_append("path_key", F.struct("held", "type_rank", "eid")).alias("path_key"), *more,
        )

    def _one_way(self, new: DataFrame, key: Column) -> DataFrame:
        """One position for each root and key: the lightest, then the smallest way."""
        rank = (["weight"] if self.cost is not None and self.order == BEST_FIRST else []) + ["path_key"]
        rest = [c for c in self._columns if c not in ("root", *rank)]
        best = new.groupBy("root", key.alias("__key")).agg(F.min(F.struct(*rank, *rest)).alias("p"))
        return best.select("root", "__key", *[F.col(f"p.{c}").alias(c) for c in [*rank, *rest]])

    def traverse(self, graph: PropertyGraph, starts: DataFrame) -> DataFrame:
        """Positions reached from the nodes in `starts` (column id), each start with a search of its own."""
        if self.uniqueness in (NONE, NODE_RECENT, RELATIONSHIP_RECENT) and self.key is None and self.max_depth is None:
            raise ValueError("this uniqueness needs a largest depth")
        adj = self._adjacency(graph)
        if self.order == BEST_FIRST and self.uniqueness == NODE_GLOBAL and self.key is None:
            out = self._best(graph, starts, adj)
        else:
            out = self._by_level(graph, starts, adj)
        superseded(adj)
        for f in self.filters:
            out = out.where(f)
        return out

    def _by_level(self, graph: PropertyGraph, starts: DataFrame, adj: DataFrame) -> DataFrame:
        node = self.uniqueness in (NODE_GLOBAL, NODE_RECENT)
        key = self.key if self.key is not None else F.col("node") if node else F.col("last_eid") if self.uniqueness in (RELATIONSHIP_GLOBAL, RELATIONSHIP_RECENT) else None
        levels, depth = Levels(self._known(graph, self._first(starts))), 0
        while self.max_depth is None or depth < self.max_depth:
            new = self._step(levels.last, adj, depth == 0)
            if key is not None:
                seen = levels.all()
                if self.key is None and "recent" in self.uniqueness:
                    last = W.partitionBy("root").orderBy(F.col("depth").desc(), F.col("path_key").desc())
                    seen = seen.withColumn("__at", F.row_number().over(last)).where(F.col("__at") <= self.recent)
                seen = seen.select("root", key.alias("__key")).where(F.col("__key").isNotNull())
                new = self._one_way(new, key).join(seen, ["root", "__key"], "left_anti")
            new = levels.put(self._known(graph, new.select(*self._columns)))
            depth += 1
            if new.isEmpty():
                break
        return levels.all()

    def _best(self, graph: PropertyGraph, starts: DataFrame, adj: DataFrame) -> DataFrame:
        """Least weights, relaxed until none gets less; costs must not be negative."""
        best = settled(self._known(graph, self._first(starts)), "best")
        tip, first = best, True
        while True:
            new = self._one_way(self._step(tip, adj, first), F.col("node")).select(*self._columns)
            if self.max_depth is not None:
                new = new.where(F.col("depth") <= self.max_depth)
            old = best.select("root", "node", F.col("weight").alias("__old"))
            new = settled(self._known(graph, new.join(old, ["root", "node"], "left").where("__old is null or weight < __old").select(*self._columns)), "lighter")
            if new.isEmpty():
                return best
            both = settled(best.join(new.select("root", "node"), ["root", "node"], "left_anti").unionByName(new), "best")
            superseded(best, None if first else tip)
            best, tip, first = both, new, False

    def _known(self, graph: PropertyGraph, level: DataFrame) -> DataFrame:
        """The level with the node columns that conditions ask for."""
        if not self.with_nodes:
            return level
        return level.join(graph.nodes.select(F.col("id").alias("node"), *self.with_nodes), "node", "left").select(*self._columns, *self.with_nodes)

    def sort_key(self) -> list[Column]:
        """Columns that put positions of one root into the order of the traversal."""
        if not isinstance(self.order, str):
            return list(self.order)
        last = F.struct(F.lit(2**31 - 1).alias("held"), F.lit(2**31 - 1).alias("type_rank"), F.lit(2**63 - 1).alias("eid"))
        return {
            PRE_DEPTH: lambda: [F.col("path_key")],
            LITE_DEPTH: lambda: [F.col("path_key")],
            PRE_BREADTH: lambda: [F.col("depth"), F.col("path_key")],
            POST_DEPTH: lambda: [F.array_append("path_key", last)],
            POST_BREADTH: lambda: [F.col("depth").desc(), F.col("path_key")],
            BEST_FIRST: lambda: [F.col("weight"), F.col("depth"), F.col("path_key")],
        }[self.order]()

    def ranked(self, graph: PropertyGraph, starts: DataFrame) -> DataFrame:
        """traverse() with `pos`, the place of each position in its root's order, from 1."""
        return self.traverse(graph, starts).withColumn("pos", F.row_number().over(W.partitionBy("root").orderBy(*self.sort_key())))


def nodes(positions: DataFrame) -> DataFrame:
    return positions.select("root", F.col("node").alias("id"), "depth")


def relationships(positions: DataFrame) -> DataFrame:
    """The relationships that led to the positions; the start has none."""
    return positions.where(F.col("last_eid").isNotNull()).select("root", F.col("last_eid").alias("eid"), "depth")


#: Conditions to stop by, and to return by, as SQL over positions.
END_OF_GRAPH, DEPTH_ONE = "false", "depth >= 1"
ALL, ALL_BUT_START_NODE = "true", "depth > 0"


def legacy(graph: PropertyGraph, starts: DataFrame, order: str, stop: Column | str | None, returnable: Column | str | None, *types: tuple[str, Direction], max_depth: int | None = None) -> DataFrame:
    """(root, id, depth, previous, eid, returned): a traverser by stop and returnable conditions; each node comes once.

    `previous` and `eid` tell how a node was reached, null at the start;
    `returned` counts the nodes that were returned up to this one, itself included.
    """
    t = Traversal(Expander(tuple(types)), order=order, max_depth=max_depth)
    column = lambda c: F.expr(c) if isinstance(c, str) else c
    t = t if stop is None else t.prune(column(stop))
    t = t if returnable is None else t.filter(column(returnable))
    previous = F.when(F.col("depth") > 0, F.try_element_at("nodes", F.lit(-2)))
    return t.ranked(graph, starts).select("root", F.col("node").alias("id"), "depth", previous.alias("previous"), F.col("last_eid").alias("eid"), F.col("pos").alias("returned"))


class TraverserClass:
    """A traversal written as a class: sub-classes set `types`, `order`, `stop` and `returnable`, and may override is_stop_node and is_returnable.

    types: (type, direction) pairs; order: one of the orders above.
    """

    types: tuple[tuple[str, Direction], ...] = ()
    order: str = PRE_BREADTH
    stop: Column | str | None = END_OF_GRAPH
    returnable: Column | str | None = ALL_BUT_START_NODE
    max_depth: int | None = None

    def is_stop_node(self) -> Column | str | None:
        return self.stop

    def is_returnable(self) -> Column | str | None:
        return self.returnable

    def __call__(self, graph: PropertyGraph, starts: DataFrame) -> DataFrame:
        return legacy(graph, starts, self.order, self.is_stop_node(), self.is_returnable(), *self.types, max_depth=self.max_depth)


def trav(graph: PropertyGraph, starts: DataFrame, order: str = PRE_BREADTH, types: dict[str, Direction] | None = None, keep: Callable[[DataFrame], Column] | None = None, max_depth: int | None = None, command: str | None = None) -> DataFrame:
    """The shell's traversal: type patterns with directions, a property filter, and no start node.

    `command`: a text in which $i stands for a node's id; it comes back filled in
    as column `command` for every node.
    """
    expander = Expander()
    if types:
        known = [r["type"] for r in graph.relationship_types().collect()]  # a handful of names
        for kind in sorted(known):
            for pattern, direction in types.items():
                if re.fullmatch(pattern, kind):
                    expander = expander.add(kind, direction)
                    break
        if not expander.types:
            return Traversal(max_depth=0).traverse(graph, starts.limit(0))
    got = Traversal(expander, order=order, max_depth=max_depth).ranked(graph, starts).where("depth > 0")
    if keep is not None:
        got = got.join(graph.nodes.where(keep(graph.nodes)).select(F.col("id").alias("node")), "node", "left_semi")
    return got if command is None else got.withColumn("command", F.replace(F.lit(command), F.lit("$i"), F.col("node").cast("string")))
