"""Centrality of nodes, from one shared table of shortest paths, and dominant eigenvectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import BOTH, Expander, PropertyGraph
from ..plans.steps import settled, superseded
from . import paths


class ShortestPaths:
    """Hop distances and path counts between all nodes, computed once for several measures."""

    def __init__(self, graph: PropertyGraph, expander: Expander = Expander(), sources: DataFrame | None = None) -> None:
        self.graph, self.expander = graph, expander
        start = graph.nodes.select("id") if sources is None else sources
        dist = paths.hop_distances(graph, start, expander)
        self.dag = settled(paths.predecessors(graph, dist, expander).select("source", "node", "pred"), "dag")
        self.counts = settled(paths.path_counts(graph, dist, expander, self.dag), "counts")
        both = expander.direction is BOTH and not expander.types or bool(expander.types) and all(d is BOTH for _, d in expander.types)
        self.half = 0.5 if both else 1.0
        self.top = self.counts.agg(F.max("dist")).first()[0] or 0

    def _backward(self, share: Column) -> DataFrame:
        """Per source, level by level from the far end: the sum over followers of `share` of (value, paths, pred_paths)."""
        value = self.counts.where(F.col("dist") == self.top).select("source", "node", F.lit(0.0).alias("value"))
        done = value
        at = self.counts.select("source", "node", "dist", "paths")
        for k in range(self.top, 0, -1):
            w = value.join(at, ["source", "node"]).select("source", "node", "value", "paths")
            v = at.where(F.col("dist") == k - 1).select("source", F.col("node").alias("pred"), F.col("paths").alias("pred_paths"))
            got = self.dag.join(w, ["source", "node"]).join(v, ["source", "pred"]).groupBy("source", "pred").agg(F.sum(share).alias("value"))
            level = v.select("source", "pred").join(got, ["source", "pred"], "left").select("source", F.col("pred").alias("node"), F.coalesce("value", F.lit(0.0)).alias("value"))
            value = settled(level, "value")
            done = done.union(value)
        return done.where("source <> node").groupBy("node").agg((F.sum("value") * self.half).alias("value"))

    def _all(self, got: DataFrame, name: str) -> DataFrame:
        return self.graph.nodes.select("id").join(got, F.col("id") == F.col("node"), "left").select("id", F.coalesce("value", F.lit(0.0)).alias(name))

    def betweenness(self) -> DataFrame:
        return self._all(self._backward((F.col("value") + 1) * F.col("pred_paths") / F.col("paths")), "betweenness")

    def stress(self, compat: bool = False) -> DataFrame:
        """Shortest paths through each node; `compat` keeps the recurrence that counts some of them more than once."""
        if compat:
            return self._all(self._backward((F.col("value") + 1) * F.col("pred_paths")), "stress")
        return self._all(self._backward((F.col("value") / F.col("paths") + 1) * F.col("pred_paths")), "stress")

    def closeness(self) -> DataFrame:
        """1 / sum of the distances to the nodes that can be reached; 0 where there are none."""
        return closeness(self.graph, self.counts)

    def eccentricity(self) -> DataFrame:
        return eccentricity(self.graph, self.counts)

    def diameter(self) -> DataFrame:
        return self.eccentricity().agg(F.max("eccentricity").alias("diameter"))

    def radius(self) -> DataFrame:
        return self.eccentricity().agg(F.min("eccentricity").alias("radius"))


def closeness(graph: PropertyGraph, dist: DataFrame) -> DataFrame:
    """From any table (source, node, dist), also of costs."""
    total = dist.groupBy("source").agg(F.sum("dist").cast("double").alias("total"))
    return graph.nodes.select("id").join(total, F.col("id") == F.col("source"), "left").select("id", F.when(F.col("total") > 0, 1 / F.col("total")).otherwise(0.0).alias("closeness"))


def eccentricity(graph: PropertyGraph, dist: DataFrame) -> DataFrame:
    far = dist.groupBy("source").agg(F.max("dist").alias("eccentricity"))
    return graph.nodes.select("id").join(far, F.col("id") == F.col("source"), "left").select("id", "eccentricity")


def _matrix(graph: PropertyGraph, cost: Column | None, expander: Expander) -> DataFrame:
    g = PropertyGraph(graph.nodes, graph.edges.withColumn("w", F.lit(1.0) if cost is None else cost.cast("double")))
    return settled(g.adjacency(expander, keep=["w"]).groupBy("frm", "to").agg(F.sum("w").alias("w")), "matrix")


def eigenvector(graph: PropertyGraph, cost: Column | None = None, expander: Expander = Expander(), precision: float = 1e-3, max_iterations: int = 100, fixed: int | None = None) -> DataFrame:
    """(id, eigenvector): dominant eigenvector of the weighted adjacency, unit length and not negative in sum, by power iteration from equal values.

    A node gets the values of the nodes that its relationships lead to. Stops
    when no value changes by more than `precision` relatively, or after
    `fixed` rounds.
    """
    adj = _matrix(graph, cost, expander)
    x = settled(graph.nodes.select("id", F.lit(1.0).alias("x")), "vector")
    for k in range(fixed or max_iterations):
        y = adj.join(x, F.col("to") == F.col("id")).groupBy("frm").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        y = settled(x.select("id", F.col("x").alias("old")).join(y, F.col("id") == F.col("frm"), "left").select("id", "old", F.coalesce("y", F.lit(0.0)).alias("y")), "vector")
        total = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))), F.sum("y")).first()
        size = (total[0] or 1.0) * (-1 if (total[1] or 0) < 0 else 1)
        both = y.select("id", "old", (F.col("y") / size).alias("x"))
        moved = both.agg(F.max(F.abs(F.col("x") - F.col("old")) - precision * F.abs("x"))).first()[0]
        superseded(x)
        x = both.select("id", "x")
        x._step = y._step
        if fixed is None and k and moved is not None and moved <= 0:
            break
    return x.select("id", F.col("x").alias("eigenvector"))


def eigenvector_arnoldi(graph: PropertyGraph, cost: Column | None = None, expander: Expander = Expander(), precision: float = 1e-3, steps: int = 30, restarts: int = 20) -> DataFrame:
    """(id, eigenvector): dominant eigenvector by Arnoldi iteration, unit length and not negative in sum.

    The vectors are tables; only the small projected matrix, `steps` x `steps`,
    is on the driver. Starts anew from the best vector so far until the residual
    falls below `precision`.
    """
    import numpy as np

    adj = _matrix(graph, cost, expander)
    n = graph.nodes.count()
    steps = max(1, min(steps, n))
    start = graph.nodes.select("id", F.lit(n**-0.5).alias("v0"))
    for _ in range(restarts):
        basis, h = settled(start, "basis"), np.zeros((steps + 1, steps))
        used = steps
        for k in range(steps):
            w = adj.join(basis.select(F.col("id").alias("to"), F.col(f"v{k}").alias("x")), "to").groupBy("frm").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
            basis = settled(basis.join(w, F.col("id") == F.col("frm"), "left").select(*basis.columns, F.coalesce("y", F.lit(0.0)).alias("y")), "basis")
            for _again in range(2):  # once more, for rounding
                dots = basis.agg(*[F.sum(F.col(f"v{i}") * F.col("y")).alias(f"d{i}") for i in range(k + 1)]).first()
                h[: k + 1, k] += np.array(dots)
                basis = basis.withColumn("y", F.col("y") - sum((F.col(f"v{i}") * float(d) for i, d in enumerate(dots)), F.lit(0.0)))
            h[k + 1, k] = basis.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 0.0
            if h[k + 1, k] < 1e-12:
                used = k + 1
                break
            basis = settled(basis.withColumn(f"v{k + 1}", F.col("y") / float(h[k + 1, k])).drop("y"), "basis")
        values, vectors = np.linalg.eig(h[:used, :used])
        top = int(np.argmax(values.real))
        y = np.real(vectors[:, top])
        left = abs(h[used, used - 1] * y[-1]) if used < len(h) else 0.0
        mixed = settled(basis.select("id", sum((F.col(f"v{i}") * float(c) for i, c in enumerate(y)), F.lit(0.0)).alias("x")), "vector")
        total = mixed.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.sum("x")).first()
        size = (total[0] or 1.0) * (-1 if (total[1] or 0) < 0 else 1)
        start = mixed.select("id", (F.col("x") / size).alias("v0"))
        if left <= precision * abs(values[top]):
            break
    return start.select("id", F.col("v0").alias("eigenvector"))


def mat_vec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """Sparse matrix (row, col, value) times vector (col, value)."""
    v = vector.select("col", F.col("value").alias("v"))
    return matrix.join(v, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def solve(matrix: DataFrame, right: DataFrame, limit: int = 2000) -> list[float]:
    """Solution of a small dense system given as sparse tables; more than `limit` unknowns are for solve_large()."""
    import numpy as np

    n = max((r or -1) for r in matrix.agg(F.max("row"), F.max("col")).first()) + 1
    if n > limit:
        raise ValueError("too many unknowns for one task")
    a, b = np.zeros((n, n)), np.zeros(n)
    for r in matrix.collect():
        a[r["row"], r["col"]] = r["value"]
    for r in right.collect():
        b[r["row"]] = r["value"]
    return np.linalg.solve(a, b).tolist()


def solve_large(matrix: DataFrame, right: DataFrame, precision: float = 1e-10, max_iterations: int = 1000) -> DataFrame:
    """(row, value): solution of a sparse system of any size by conjugate gradients on the normal equations; vectors stay tables."""
    a = settled(matrix.select("row", "col", F.col("value").cast("double").alias("value")), "matrix")
    turned = a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    names = a.select(F.col("col").alias("row")).distinct()

    def times(m: DataFrame, v: DataFrame, c: str) -> DataFrame:
        return mat_vec(m, v.select(F.col("row").alias("col"), F.col(c).alias("value")))

    b = times(turned, right.select("row", F.col("value").cast("double").alias("r")), "r").withColumnRenamed("value", "r")
    state = settled(names.join(b, "row", "left").select("row", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r")).withColumn("p", F.col("r")), "state")
    norm = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    first = norm
    for _ in range(max_iterations):
        if norm <= precision**2 * max(first, 1e-300):
            break
        ap = times(turned, settled(times(a, state, "p").withColumnRenamed("value", "q"), "product"), "q").withColumnRenamed("value", "ap")
        both = settled(state.join(ap, "row", "left").select("row", "x", "r", "p", F.coalesce("ap", F.lit(0.0)).alias("ap")), "both")
        step = norm / both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        both2 = both.select("row", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "p")
        now = both2.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        new = settled(both2.select("row", "x", "r", (F.col("r") + (now / norm) * F.col("p")).alias("p")), "state")
        superseded(state, both)
        state, norm = new, now
    return state.select("row", F.col("x").alias("value"))
