"""Graphs for measurements, the same for the same seed whatever the partitioning."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.steps import settled


def _pick(n: int, seed: int, *parts: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(n))


def _graph(spark: SparkSession, n: int, edges: DataFrame) -> PropertyGraph:
    nodes = spark.range(n).select("id", F.lit("node").alias("label"))
    return PropertyGraph(nodes, edges.select("eid", "src", "dst", F.lit("LINK").alias("type")), 0)


def random_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 0) -> PropertyGraph:
    """Ends are drawn evenly; loops and parallel relationships may occur."""
    return _graph(spark, nodes, spark.range(edges).select(F.col("id").alias("eid"), _pick(nodes, seed, "id", F.lit("a")).alias("src"), _pick(nodes, seed, "id", F.lit("b")).alias("dst")))


def preferential_attachment(spark: SparkSession, nodes: int, degree: int, seed: int = 0, rounds: int = 40) -> PropertyGraph:
    """Each new node links `degree` times to an end of an earlier relationship, drawn evenly, and so to nodes in proportion to their degrees.

    The draw copies either the source of an earlier relationship, or what its
    own draw copied; following those references needs a bounded number of joins.
    """
    draws = spark.range(degree, nodes * degree).select(F.col("id").alias("eid"), F.floor(F.col("id") / degree).alias("src"))
    draws = draws.withColumn("r", F.pmod(F.xxhash64(F.lit(seed), "eid"), F.col("src") * degree * 2))
    # Even r: the source of relationship r / 2; odd: where that relationship leads to.
    state = draws.select("eid", "src", F.floor(F.col("r") / 2).alias("ref"), F.when(F.col("r") % 2 == 0, F.floor(F.col("r") / 2 / degree)).alias("dst"))
    state = state.withColumn("dst", F.when(F.col("dst").isNull() & (F.col("ref") < degree), F.lit(0)).otherwise(F.col("dst")))
    for _ in range(rounds):
        state = settled(state, "draws")
        if state.where("dst is null").isEmpty():
            break
        known = state.select(F.col("eid").alias("ref"), F.col("dst").alias("d"), F.col("ref").alias("next"))
        state = state.join(known, "ref", "left").select("eid", "src", F.when(F.col("dst").isNull() & F.col("d").isNull(), F.col("next")).otherwise(F.col("ref")).alias("ref"), F.coalesce("dst", "d").alias("dst"))
        state = state.withColumn("dst", F.when(F.col("dst").isNull() & (F.col("ref") < degree), F.lit(0)).otherwise(F.col("dst")))
    return _graph(spark, nodes, state)


def small_world(spark: SparkSession, nodes: int, neighbours: int, rewire: float, seed: int = 0) -> PropertyGraph:
    """A ring where each node links to the next ones, some ends drawn anew."""
    e = spark.range(nodes * neighbours).select(F.col("id").alias("eid"), F.floor(F.col("id") / neighbours).alias("src"), (F.col("id") % neighbours + 1).alias("k"))
    new = _pick(1_000_000, seed, "eid", F.lit("r")) < int(rewire * 1_000_000)
    return _graph(spark, nodes, e.select("eid", "src", F.when(new, _pick(nodes, seed, "eid", F.lit("d"))).otherwise((F.col("src") + F.col("k")) % nodes).alias("dst")))


def tree(spark: SparkSession, nodes: int, fan: int = 2) -> PropertyGraph:
    e = spark.range(1, nodes).select((F.col("id") - 1).alias("eid"), F.floor((F.col("id") - 1) / fan).alias("src"), F.col("id").alias("dst"))
    return _graph(spark, nodes, e)


def layered(spark: SparkSession, layers: int, width: int, edges: int, seed: int = 0) -> PropertyGraph:
    """Each node links `edges` times into the next layer."""
    e = spark.range((layers - 1) * width * edges).select(F.col("id").alias("eid"), F.floor(F.col("id") / edges).alias("src"))
    dst = (F.floor(F.col("src") / width) + 1) * width + _pick(width, seed, "eid")
    return _graph(spark, layers * width, e.select("eid", "src", dst.alias("dst")))


def chain(spark: SparkSession, *chains: str, kind: str = "TO") -> PropertyGraph:
    """A small graph of named nodes from chains like "a,b,c"."""
    names = list(dict.fromkeys(n for c in chains for n in c.split(",")))
    pairs = [(a, b) for c in chains for a, b in zip(c.split(","), c.split(",")[1:], strict=False)]
    nodes = spark.createDataFrame([(i, "node", n) for i, n in enumerate(names)], "id long, label string, name string")
    edges = spark.createDataFrame([(k, names.index(a), names.index(b), kind) for k, (a, b) in enumerate(pairs)], "eid long, src long, dst long, type string")
    return PropertyGraph(nodes, edges, 0)


