"""Shared helpers of the corpus operators: written intermediates, free column names, connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans.steps import new_path, settled, shared_dir, superseded

__all__ = ["components", "free_names", "new_path", "shared_dir", "superseded", "written"]

written = settled


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the frame has, in any case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, root).

    `edges` has long columns a and b, in any order, repeats allowed. Alternates
    the large-star and small-star steps of Kiveris et al. (2014) until the edge
    set no longer changes. The smallest neighbours of each step are written
    before they are joined with the edges, so that the join has exchanges of its
    own and the rows of a hub are split among tasks; steps are deleted once the
    next one is there.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        kept = both.where("v > u") if large else both
        out = kept.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = written(out.where("a <> b").distinct(), "edges")
        superseded(low)
        return out

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, "edges")
    seen = state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        half = star(e, True)
        superseded(e)
        e = star(half, False)
        superseded(half)
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected groups did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
