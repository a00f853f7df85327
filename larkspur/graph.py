"""The property graph: two DataFrames, and the adjacency views that every operator joins with."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Direction(Enum):
    OUTGOING = "out"
    INCOMING = "in"
    BOTH = "both"

    def reverse(self) -> Direction:
        return {Direction.OUTGOING: Direction.INCOMING, Direction.INCOMING: Direction.OUTGOING}.get(self, self)


OUT, IN, BOTH = Direction.OUTGOING, Direction.INCOMING, Direction.BOTH


@dataclass(frozen=True)
class Expander:
    """Which relationships lead on from a node.

    `types`: (type, direction) pairs in their declared order; none means all
    types in `direction`. Types in `without` are never followed. `nodes` and
    `rels` are conditions: on the columns of a node and of a relationship.
    """

    types: tuple[tuple[str, Direction], ...] = ()
    direction: Direction = BOTH
    without: frozenset[str] = frozenset()
    nodes: tuple[Column, ...] = ()
    rels: tuple[Column, ...] = ()

    def add(self, kind: str, direction: Direction = BOTH) -> Expander:
        return replace(self, types=(*(t for t in self.types if t[0] != kind), (kind, direction)), without=self.without - {kind})

    def remove(self, kind: str) -> Expander:
        return replace(self, types=tuple(t for t in self.types if t[0] != kind), without=self.without | {kind})

    def reversed(self) -> Expander:
        return replace(self, types=tuple((k, d.reverse()) for k, d in self.types), direction=self.direction.reverse())

    def where_node(self, condition: Column) -> Expander:
        return replace(self, nodes=(*self.nodes, condition))

    def where_rel(self, condition: Column) -> Expander:
        return replace(self, rels=(*self.rels, condition))


@dataclass(frozen=True)
class PropertyGraph:
    """nodes(id, label, properties...), edges(eid, src, dst, type, properties...); ref_id names the reference node.

    `parts`: where nodes and edges come from several tables with keys of their
    own, a function that gives only those rows that can have a given id in a
    given column; look-ups of one id then filter the tables by key.
    """

    nodes: DataFrame
    edges: DataFrame
    ref_id: int | None = None
    parts: Callable[[str, int], DataFrame] | None = None

    def _at(self, column: str, value: int) -> DataFrame:
        rows = self.nodes if column == "id" else self.edges
        return (rows if self.parts is None else self.parts(column, value)).where(F.col(column) == value)

    def node(self, node_id: int) -> DataFrame:
        return self._at("id", node_id)

    def relationship(self, eid: int) -> DataFrame:
        return self._at("eid", eid)

    def reference_node(self) -> DataFrame:
        return self.nodes.where(F.col("id") == F.lit(self.ref_id))

    def relationship_types(self) -> DataFrame:
        return self.edges.select("type").distinct()

    def adjacency(self, expander: Expander = Expander(), keep: Sequence[str] = ()) -> DataFrame:
        """(frm, to, eid, type, type_rank, *keep): a row for each way to follow a relationship.

        A loop is followed once. Conditions on nodes hold for `to`.
        """
        e = self.edges
        for c in expander.rels:
            e = e.where(c)
        if expander.without:
            e = e.where(~F.col("type").isin(*expander.without))
        if expander.types:
            rank = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(expander.types) for x in (k, i)])
            e = e.where(F.col("type").isin(*[k for k, _ in expander.types]))
            ways = {d: [k for k, w in expander.types if w in (d, BOTH)] for d in (OUT, IN)}
            ahead, back = e.where(F.col("type").isin(*ways[OUT])), e.where(F.col("type").isin(*ways[IN]))
            use_out, use_in = bool(ways[OUT]), bool(ways[IN])
            both = F.col("type").isin(*[k for k, w in expander.types if w is BOTH]) if any(w is BOTH for _, w in expander.types) else F.lit(False)
        else:
            rank = None
            ahead = back = e
            use_out, use_in = expander.direction is not IN, expander.direction is not OUT
            both = F.lit(expander.direction is BOTH)
        order = rank[F.col("type")] if rank is not None else F.lit(0)
        cols = ["eid", "type", order.alias("type_rank"), *keep]
        parts = []
        if use_out:
            parts.append(ahead.select(F.col("src").alias("frm"), F.col("dst").alias("to"), *cols))
        if use_in:
            parts.append(back.where(~(both & (F.col("src") == F.col("dst")))).select(F.col("dst").alias("frm"), F.col("src").alias("to"), *cols))
        adj = reduce(DataFrame.union, parts)
        if expander.nodes:
            good = self.nodes.where(reduce(lambda a, b: a & b, expander.nodes)).select(F.col("id").alias("to"))
            adj = adj.join(good, "to", "left_semi").select("frm", "to", "eid", "type", "type_rank", *keep)
        return adj

    def relationships(self, node_id: int, expander: Expander = Expander()) -> DataFrame:
        """Relationships of one node: each end is looked up by itself."""
        ends = self._at("src", node_id).union(self._at("dst", node_id).where(F.col("src") != node_id))
        adj = replace(self, edges=ends, parts=None).adjacency(expander).where(F.col("frm") == node_id)
        return adj.select("eid", "type", F.col("frm").alias("node"), F.col("to").alias("other"))

    def expand(self, nodes: DataFrame, expander: Expander = Expander()) -> DataFrame:
        """(id, eid, type, other) for all given nodes (column id)."""
        adj = self.adjacency(expander)
        return nodes.select("id").join(adj, F.col("id") == F.col("frm")).select("id", "eid", "type", F.col("to").alias("other"))

    def expansion(self, nodes: DataFrame, expander: Expander = Expander(), including: DataFrame | None = None, excluding: DataFrame | None = None) -> DataFrame:
        """expand(), only to nodes in `including` and to none in `excluding` (column id)."""
        got = self.expand(nodes, expander)
        for some, how in ((including, "left_semi"), (excluding, "left_anti")):
            if some is not None:
                got = got.join(some.select(F.col("id").alias("other")), "other", how)
        return got.select("id", "eid", "type", "other")

    def pairs(self, nodes: DataFrame, expander: Expander = Expander()) -> DataFrame:
        """(id, other): the distinct pairs of an expansion."""
        return self.expand(nodes, expander).select("id", "other").distinct()

    def degree(self, expander: Expander = Expander(), by_type: bool = False) -> DataFrame:
        """Relationships of every node that has any."""
        keys = ["frm", "type"] if by_type else ["frm"]
        return self.adjacency(expander).groupBy(*keys).agg(F.count("*").alias("degree")).withColumnRenamed("frm", "id")

    def with_relationship(self, expander: Expander = Expander(), has: bool = True) -> DataFrame:
        """Nodes that have, or lack, a relationship of the kind."""
        ends = self.adjacency(expander).select(F.col("frm").alias("id"))
        return self.nodes.join(ends, "id", "left_semi" if has else "left_anti")

    def single_relationship(self, expander: Expander) -> DataFrame:
        """(id, eid, other): the one relationship of the kind of each node, nulls where none; fails if a node has several."""
        one = self.adjacency(expander).groupBy("frm").agg(F.count("*").alias("n"), F.min("eid").alias("eid"), F.min("to").alias("other"))
        checked = one.where(F.coalesce(F.assert_true(F.col("n") <= 1, "more than one relationship").isNull(), F.lit(True)))
        return self.nodes.select("id").join(checked, F.col("id") == F.col("frm"), "left").select("id", "eid", "other")

    # Changes give a new graph.
    def create_nodes(self, rows: DataFrame) -> PropertyGraph:
        return replace(self, nodes=self.nodes.unionByName(rows, allowMissingColumns=True), parts=None)

    def create_relationships(self, rows: DataFrame) -> PropertyGraph:
        return replace(self, edges=self.edges.unionByName(rows, allowMissingColumns=True), parts=None)

    def delete_nodes(self, ids: DataFrame, detach: bool = True) -> PropertyGraph:
        """Without the nodes in `ids` (column id), and with `detach` without their relationships."""
        edges = self.edges
        if detach:
            gone = ids.select("id")
            edges = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select(*self.edges.columns)
        return replace(self, nodes=self.nodes.join(ids, "id", "left_anti"), edges=edges, parts=None)

    def delete_relationships(self, eids: DataFrame) -> PropertyGraph:
        return replace(self, edges=self.edges.join(eids, "eid", "left_anti"), parts=None)

    def set_property(self, key: str, value: Column, where: Column | None = None, on: str = "nodes") -> PropertyGraph:
        df = getattr(self, on)
        old = F.col(key) if key in df.columns else F.lit(None)
        return replace(self, parts=None, **{on: df.withColumn(key, value if where is None else F.when(where, value).otherwise(old))})

    def remove_property(self, key: str, where: Column | None = None, on: str = "nodes") -> PropertyGraph:
        df = getattr(self, on)
        return replace(self, parts=None, **{on: df.drop(key) if where is None else df.withColumn(key, F.when(~where, F.col(key)))})
