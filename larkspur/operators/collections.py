"""Sets, lists, queues and pages of rows, and differences between two states of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import Expander, PropertyGraph
from .traversal import Traversal


def bag_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page(df: DataFrame, by: list[str], size: int, number: int) -> DataFrame:
    """Page `number` from 0 in the order of `by`, which should tell all rows apart."""
    return df.orderBy(*by).offset(size * number).limit(size)


def retain_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def remove_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def add_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def latest(df: DataFrame, owner: str, seq: list[Column], n: int) -> DataFrame:
    """The last n entries of every owner's list."""
    w = W.partitionBy(owner).orderBy(*[c.desc() for c in seq])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def queue_head(df: DataFrame, seq: list[str], n: int, lifo: bool = False) -> DataFrame:
    """The next n entries: the oldest of a queue, the newest of a stack."""
    return df.orderBy(*[F.col(c).desc() if lifo else F.col(c) for c in seq]).limit(n)


def queue_rest(df: DataFrame, seq: list[str], n: int, lifo: bool = False) -> DataFrame:
    """What is left after taking the next n entries."""
    return df.join(queue_head(df, seq, n, lifo).select(*seq), seq, "left_anti")


def delete_reachable(graph: PropertyGraph, starts: DataFrame, expander: Expander = Expander()) -> PropertyGraph:
    """Without everything that can be reached from the starts, these included."""
    gone = Traversal(expander).reached(graph, starts).select(F.col("node").alias("id")).distinct()
    return graph.delete_nodes(gone)


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, kind, property, old, new): created, deleted, assigned and removed, between two states of nodes or relationships.

    Values are strings; a created or deleted row gives one entry for itself
    and one for each property that it has.
    """
    props = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    both_sides = []
    for df, side in ((old, "o"), (new, "n")):
        pairs = [F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("v")) for c in props if c in df.columns]
        rows = F.concat(F.array(F.struct(F.lit("").alias("p"), F.lit("").alias("v"))), F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))
        both_sides.append(df.select(key, F.explode(rows).alias("x")).select(key, F.col("x.p").alias("property"), F.col("x.v").alias(side)))
    d = both_sides[0].join(both_sides[1], [key, "property"], "full_outer").where("not o <=> n")
    kind = F.when(F.col("property") == "", F.when(F.col("o").isNull(), "created").otherwise("deleted")).otherwise(F.when(F.col("n").isNull(), "removed").otherwise("assigned"))
    return d.select(key, kind.alias("kind"), "property", F.col("o").alias("old"), F.col("n").alias("new"))


class Typed:
    """Links from each node of a kind to at most one other (`single`) or to a set, by one relationship type; changes give a new graph."""

    def __init__(self, kind: str, single: bool = False) -> None:
        self.kind, self.single = kind, single

    def get(self, graph: PropertyGraph) -> DataFrame:
        """(id, other)."""
        return graph.edges.where(F.col("type") == self.kind).select(F.col("src").alias("id"), F.col("dst").alias("other"))

    def set(self, graph: PropertyGraph, links: DataFrame) -> PropertyGraph:
        """With links (id, other); a single link replaces the one before. Ids of new relationships come from both ends and the type."""
        new = links.select(F.xxhash64("id", "other", F.lit(self.kind)).alias("eid"), F.col("id").alias("src"), F.col("other").alias("dst"), F.lit(self.kind).alias("type")).distinct()
        if self.single:
            new = new.groupBy("src", "type").agg(F.max(F.struct("dst", "eid")).alias("x")).select("x.eid", "src", "x.dst", "type")
        return self.remove(graph, links if self.single else links.limit(0)).create_relationships(new.join(self.get(graph).toDF("src", "dst"), ["src", "dst"], "left_anti").select("eid", "src", "dst", "type") if not self.single else new)

    def remove(self, graph: PropertyGraph, nodes: DataFrame) -> PropertyGraph:
        """Without the links of these nodes (column id)."""
        gone = graph.edges.where(F.col("type") == self.kind).join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("eid")
        return graph.delete_relationships(gone)


class Migration:
    """Numbered changes of a graph, applied in order from its version on; the version is kept by the caller."""

    def __init__(self, *steps: Callable[[PropertyGraph], PropertyGraph]) -> None:
        self.steps = steps

    def apply(self, graph: PropertyGraph, version: int = 0) -> tuple[PropertyGraph, int]:
        if version > len(self.steps):
            raise ValueError(f"version {version} is newer than the last step, {len(self.steps)}")
        for step in self.steps[version:]:
            graph = step(graph)
        return graph, len(self.steps)


def handled(old: PropertyGraph, new: PropertyGraph, *handlers: Callable[[DataFrame], None]) -> PropertyGraph:
    """Calls every handler with the changes (element, id, kind, property, old, new) of a state; a handler that raises refuses it."""
    a = changes(old.nodes, new.nodes, "id").withColumn("element", F.lit("node"))
    b = changes(old.edges, new.edges, "eid").withColumnRenamed("eid", "id").withColumn("element", F.lit("relationship"))
    both = a.unionByName(b)
    for h in handlers:
        h(both)
    return new


def map_skipping(df: DataFrame, value: Column, name: str) -> DataFrame:
    """With a column; rows whose value cannot be computed (null, as by the try_ functions) are left out."""
    return df.withColumn(name, value).where(F.col(name).isNotNull())
