"""Graph operators on random graphs, against plain Python that follows the definitions."""

import datetime
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.functions import predicates as P
from larkspur.graph import BOTH, IN, OUT, Direction, Expander, PropertyGraph
from larkspur.operators import centrality, collections, generators, index, metamodel, paths, pattern, rdf, traversal
from larkspur.operators.pattern import Pattern, PatternNode, PatternRel
from larkspur.operators.traversal import Traversal
from larkspur.sources import tables

EDGE = "eid long, src long, dst long, type string, cost int"


class Toy:
    """A random multigraph with loops, as tables and as a list."""

    def __init__(self, spark, seed, n=7, m=12, kinds=("RAIL", "ROAD"), least=0):
        r = random.Random(seed)
        self.n, self.kinds = n, kinds
        self.edges = [(k, r.randrange(n), r.randrange(n), r.choice(kinds), r.randint(least, 5)) for k in range(m)]
        nodes = spark.createDataFrame([(i, "stop", f"stop {i}") for i in range(n)], "id long, label string, name string")
        self.graph = PropertyGraph(nodes, spark.createDataFrame(self.edges, EDGE), 0)
        self.spark = spark

    def start(self, *ids):
        return self.spark.createDataFrame([(i,) for i in ids], "id long")

    def ways(self, node, direction=BOTH, order=None):
        """(rank, eid, to, cost) of the relationships that lead on, smallest first; a loop once."""
        out = []
        for eid, a, b, kind, cost in self.edges:
            rank = order.index(kind) if order else 0
            if direction is not IN and a == node:
                out.append((rank, eid, b, cost))
            if direction is not OUT and b == node and not (direction is BOTH and a == b):
                out.append((rank, eid, a, cost))
        return sorted(out)

    def trails(self, start, depth, rule, direction=BOTH, order=None):
        """Every way that the rule allows: (nodes, rels, key, cost), in depth-first order."""

        def walk(nodes, rels, key, cost):
            yield nodes, rels, key, cost
            if len(rels) < depth:
                for rank, eid, to, c in self.ways(nodes[-1], direction, order):
                    if not (rels and rels[-1] == eid) and rule(nodes, rels, eid, to):
                        yield from walk((*nodes, to), (*rels, eid), (*key, (rank, eid)), cost + c)

        return list(walk((start,), (), (), 0))


RULES = {
    traversal.NONE: lambda nodes, rels, eid, to: True,
    traversal.NODE_PATH: lambda nodes, rels, eid, to: to not in nodes,
    traversal.RELATIONSHIP_PATH: lambda nodes, rels, eid, to: eid not in rels,
}


def rows(positions):
    return sorted((tuple(r.nodes), tuple(r.rels)) for r in positions.collect())


@pytest.mark.parametrize("kind", RULES)
@pytest.mark.parametrize("direction", [OUT, IN, BOTH])
def test_every_way(spark, kind, direction):
    toy = Toy(spark, 3, m=9)
    got = Traversal(Expander(direction=direction), kind, max_depth=3).traverse(toy.graph, toy.start(0, 2))
    want = [(n, r) for s in (0, 2) for n, r, *_ in toy.trails(s, 3, RULES[kind], direction)]
    assert rows(got) == sorted(want)


def by_level(toy, start, key_of, direction, depth, recent=None):
    """Level by level: of new positions with one key the first way stays; `recent` keys are remembered, or all."""
    level, seen, out = [((start,), (), ())], [key_of((start,), ())], [((start,), ())]
    for _ in range(depth):
        new = {}
        for nodes, rels, key in level:
            for rank, eid, to, _c in toy.ways(nodes[-1], direction):
                if rels and rels[-1] == eid:
                    continue
                one = ((*nodes, to), (*rels, eid), (*key, (rank, eid)))
                k = key_of(one[0], one[1])
                if k not in (seen if recent is None else seen[-recent:]) and (k not in new or one[2] < new[k][2]):
                    new[k] = one
        level = sorted(new.values(), key=lambda x: x[2])
        seen += [key_of(n, r) for n, r, _ in level]
        out += [(n, r) for n, r, _ in level]
    return sorted(out)


@pytest.mark.parametrize(
    ("kind", "key_of", "recent"),
    [(traversal.NODE_GLOBAL, lambda n, r: n[-1], None), (traversal.RELATIONSHIP_GLOBAL, lambda n, r: r[-1] if r else None, None), (traversal.NODE_RECENT, lambda n, r: n[-1], 2), (traversal.NODE_RECENT, lambda n, r: n[-1], 4), (traversal.RELATIONSHIP_RECENT, lambda n, r: r[-1] if r else None, 3)],
)
def test_uniqueness_over_levels(spark, kind, key_of, recent):
    toy = Toy(spark, 11, n=8, m=13)
    for direction in (OUT, BOTH):
        t = Traversal(Expander(direction=direction)).unique(kind, recent or 10_000).prune_after(4)
        memory = recent
        if recent and "relationship" in kind:  # the start has no relationship and takes no place in the memory
            memory = recent
        assert rows(t.traverse(toy.graph, toy.start(1))) == by_level(toy, 1, key_of, direction, 4, memory)


def test_uniqueness_of_ones_own(spark):
    toy = Toy(spark, 5, n=9, m=16)
    t = Traversal(Expander(direction=OUT), max_depth=4).unique_by(F.col("node") % 3)
    assert rows(t.traverse(toy.graph, toy.start(0))) == by_level(toy, 0, lambda n, r: n[-1] % 3, OUT, 4)


@pytest.mark.parametrize("seed", [1, 2])
def test_orders(spark, seed):
    toy = Toy(spark, seed, m=10)
    order = ("ROAD", "RAIL")
    ways = toy.trails(0, 3, RULES[traversal.RELATIONSHIP_PATH], OUT, order)

    def after(prefix):
        """Children before their parent."""
        kids = [w for w in ways if len(w[1]) == len(prefix) + 1 and w[1][: len(prefix)] == prefix]
        return [x for k in kids for x in after(k[1])] + [prefix]

    pre = [w[1] for w in ways]
    want = {
        traversal.PRE_DEPTH: pre, traversal.PRE_BREADTH: [w[1] for w in sorted(ways, key=lambda w: (len(w[1]), w[2]))],
        traversal.POST_DEPTH: after(()), traversal.POST_BREADTH: [w[1] for w in sorted(ways, key=lambda w: (-len(w[1]), w[2]))],
    }
    t = Traversal(Expander(tuple((k, OUT) for k in order)), traversal.RELATIONSHIP_PATH, max_depth=3)
    for o, rels in want.items():
        assert [tuple(r.rels) for r in t.ordered(o).ranked(toy.graph, toy.start(0)).orderBy("pos").collect()] == rels
    got = t.best_first(F.col("cost")).ranked(toy.graph, toy.start(0)).orderBy("pos").collect()
    assert [(tuple(r.rels), r.weight) for r in got] == [(w[1], w[3]) for w in sorted(ways, key=lambda w: (w[3], len(w[1]), w[2]))]
    busy = {v: len(toy.ways(v, OUT, order)) > 1 for v in range(toy.n)}
    held = lambda w: [(busy[v], *k) for v, k in zip(w[0][1:], w[2], strict=True)]
    lite = t.lite_depth_first(1).ranked(toy.graph, toy.start(0)).orderBy("pos").collect()
    assert [tuple(r.rels) for r in lite] == [w[1] for w in sorted(ways, key=held)]
    own = t.ordered((F.col("node").desc(), F.col("path_key"))).ranked(toy.graph, toy.start(0)).orderBy("pos").collect()
    assert [tuple(r.rels) for r in own] == [w[1] for w in sorted(ways, key=lambda w: (-w[0][-1], w[2]))]


def test_prunes_filters_and_legacy(spark):
    toy = Toy(spark, 8, n=9, m=18)
    ways = [w for w in toy.trails(2, 4, RULES[traversal.NODE_PATH], OUT) if not any(v % 4 == 3 for v in w[0][1:-1])]
    t = Traversal(Expander(direction=OUT), traversal.NODE_PATH, max_depth=4).prune(F.col("node") % 4 == 3)
    assert rows(t.traverse(toy.graph, toy.start(2))) == sorted((n, r) for n, r, *_ in ways)
    some = t.filter(F.col("depth") > 0).filter_any(F.col("node") == 1, F.col("node") > 5)
    assert rows(some.traverse(toy.graph, toy.start(2))) == sorted((n, r) for n, r, *_ in ways if len(r) and (n[-1] == 1 or n[-1] > 5))
    level = by_level(toy, 2, lambda n, r: n[-1], OUT, 9)
    got = traversal.legacy(toy.graph, toy.start(2), traversal.PRE_BREADTH, traversal.END_OF_GRAPH, traversal.ALL_BUT_START_NODE, *((k, OUT) for k in toy.kinds)).orderBy("returned").collect()
    assert {(r.id, r.depth) for r in got} == {(n[-1], len(r)) for n, r in level if r}
    assert [r.returned for r in got] == list(range(1, len(got) + 1)) and all((r.previous, r.eid) != (None, None) for r in got)
    ends = [(e[0], e[1], e[2]) for e in toy.edges]
    assert all((r.eid, r.previous, r.id) in ends for r in got)
    with pytest.raises(ValueError):
        Traversal(uniqueness=traversal.NONE).traverse(toy.graph, toy.start(0))
    assert Traversal().traverse(toy.graph, toy.start(0).limit(0)).count() == 0 == Traversal().reached(toy.graph, toy.start(0).limit(0)).count()


@pytest.mark.parametrize("seed", [4, 6])
def test_paths(spark, seed):
    toy = Toy(spark, seed, n=6, m=10)
    out = Expander(direction=OUT)
    for a, b in ((0, 3), (2, 2), (5, 1)):
        trails = [w for w in toy.trails(a, 5, RULES[traversal.RELATIONSHIP_PATH], OUT) if w[0][-1] == b]
        simple = [w for w in toy.trails(a, 5, RULES[traversal.NODE_PATH], OUT) if w[0][-1] == b]
        pick = lambda ws: sorted((w[0], w[1]) for w in ws)
        assert rows(paths.all_paths(toy.graph, a, b, out, 5)) == pick(trails)
        assert rows(paths.simple_paths(toy.graph, a, b, out, 5)) == pick(simple)
        for depth in (0, 1, 3, 4):
            assert rows(paths.exact_depth(toy.graph, a, b, out, depth)) == pick(w for w in trails if len(w[1]) == depth)
        near = min((len(w[1]) for w in simple), default=None)
        assert rows(paths.shortest_paths(toy.graph, a, b, out)) == pick(w for w in simple if len(w[1]) == near)
        cheap = min((w[3] for w in simple), default=None)
        want = [w for w in simple if w[3] == cheap]
        got = paths.cheapest_paths(toy.graph, a, b, F.col("cost"), out)
        assert rows(got) == pick(want) and {r.weight for r in got.collect()} <= {cheap}
        one = rows(paths.a_star(toy.graph, a, b, F.col("cost"), out, F.lit(0.0)))
        assert one == [(w[0], w[1]) for w in sorted(want, key=lambda w: (len(w[1]), w[1]))[:1]]
    with pytest.raises(ValueError):
        paths.distances(toy.graph, toy.start(0), F.col("cost") - 9, out)


def floyd(n, edges):
    d = [[0 if i == j else np.inf for j in range(n)] for i in range(n)]
    for _, a, b, _k, c in edges:
        d[a][b] = min(d[a][b], c)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return {(i, j): d[i][j] for i in range(n) for j in range(n) if d[i][j] < np.inf}


def test_distances(spark):
    toy = Toy(spark, 21, n=9, m=20, least=1)
    want, out = floyd(9, toy.edges), Expander(direction=OUT)
    everyone = toy.graph.nodes.select("id")
    pairs = paths.all_pairs(toy.graph, F.col("cost"), out)
    got = {(x.i, x.j): (x.dist, x.pred) for x in pairs.collect()}
    assert {k: d for k, (d, _) in got.items()} == want
    for (i, j), (d, p) in got.items():
        good = [a for _, a, b, _k, c in toy.edges if b == j and (i, a) in want and want[i, a] + c == d] if i != j else [None]
        assert p == min(good)
    far = max(want, key=want.get)
    chain = paths.path_of(pairs, *far)
    assert chain[0] == far[0] and chain[-1] == far[1] and sum(want[x] for x in itertools.pairwise(chain)) == want[far]
    assert {(x.source, x.node): x.dist for x in paths.distances(toy.graph, everyone, F.col("cost"), out).collect()} == want
    hops = floyd(9, [(*e[:4], 1) for e in toy.edges])
    assert {(x.source, x.node): x.dist for x in paths.hop_distances(toy.graph, everyone, out).collect()} == hops
    assert {(x.root, x.node): x.depth for x in Traversal(out, max_depth=2).reached(toy.graph, everyone).collect()} == {k: v for k, v in hops.items() if v <= 2}
    a, b = far
    met = {r.node: r.weight for r in paths.cheapest_between(toy.graph, a, b, F.col("cost"), out).collect()}
    assert met == {v: want[far] for v in range(9) if (a, v) in want and (v, b) in want and want[a, v] + want[v, b] == want[far]}
    assert paths.cheapest_between(toy.graph, a, b, F.col("cost"), out, max_cost=want[far] - 1).count() == 0
    best = Traversal(out).best_first(F.col("cost")).traverse(toy.graph, toy.start(a)).collect()
    assert {r.node: r.weight for r in best} == {v: d for (i, v), d in want.items() if i == a}


def test_searches_stop_at_their_target(spark):
    """A long chain whose end is near: levels beyond the target are never looked at."""
    g = generators.chain(spark, ",".join(f"n{i}" for i in range(40)), "n0,goal")
    goal = g.nodes.where("name = 'goal'").first()["id"]
    assert paths.hop_distances(g, spark.createDataFrame([(0,)], "id long"), Expander(direction=OUT), target=spark.createDataFrame([(goal,)], "node long")).count() < 15
    g = PropertyGraph(g.nodes, g.edges.withColumn("cost", F.lit(1)))
    assert paths.distances(g, spark.createDataFrame([(0,)], "id long"), F.col("cost"), Expander(direction=OUT), target=goal).count() <= 8


@pytest.mark.parametrize("seed", [31, 32])
def test_centrality(spark, seed):
    toy = Toy(spark, seed, n=7, m=9)
    hops = floyd(7, [(k, a, b, t, 1) for k, a, b, t, _ in toy.edges] + [(k, b, a, t, 1) for k, a, b, t, _ in toy.edges])
    short = {}
    for a, b in itertools.permutations(range(7), 2):
        if (a, b) in hops:
            short[a, b] = [w[0] for w in toy.trails(a, int(hops[a, b]), RULES[traversal.NODE_PATH]) if w[0][-1] == b and len(w[1]) == hops[a, b]]
    between, stress = np.zeros(7), np.zeros(7)
    for ways in short.values():
        for w in ways:
            for v in w[1:-1]:
                between[v] += 0.5 / len(ways)
                stress[v] += 0.5
    sp = centrality.ShortestPaths(toy.graph)
    column = lambda df, c: [r[c] for r in df.orderBy("id").collect()]
    assert column(sp.betweenness(), "betweenness") == pytest.approx(between)
    assert column(sp.stress(), "stress") == pytest.approx(stress)
    total = [sum(d for (a, _), d in hops.items() if a == v) for v in range(7)]
    assert column(sp.closeness(), "closeness") == pytest.approx([1 / t if t else 0 for t in total])
    far = [max(d for (a, _), d in hops.items() if a == v) for v in range(7)]
    assert column(sp.eccentricity(), "eccentricity") == far
    assert (sp.diameter().first()[0], sp.radius().first()[0]) == (max(far), min(far))
    # The other recurrence of stress: what lies behind a node counts as often as paths lead to it.
    count = {(a, b): len(w) for (a, b), w in short.items()} | {(v, v): 1 for v in range(7)}
    compat = np.zeros(7)
    for s in range(7):
        value = defaultdict(float)
        for w in sorted((v for v in range(7) if (s, v) in hops and v != s), key=lambda v: -hops[s, v]):
            for _, _, v, _ in toy.ways(w):
                if (s, v) in hops and hops[s, v] + 1 == hops[s, w]:
                    value[v] += (value[w] + 1) * count[s, v] * 1.0
        for v, x in value.items():
            compat[v] += x / 2 if v != s else 0
    multi = len({(min(a, b), max(a, b)) for _, a, b, *_ in toy.edges}) < len(toy.edges)
    if not multi:
        assert column(sp.stress(compat=True), "stress") == pytest.approx(compat)


def test_eigenvectors(spark):
    r = random.Random(2)
    n = 8
    edges = [(k, a, b, "T", r.randint(1, 4)) for k, (a, b) in enumerate((a, b) for a in range(n) for b in range(n) if a != b and (b == (a + 1) % n or r.random() < 0.3))]
    g = PropertyGraph(spark.range(n).select("id", F.lit("x").alias("label")), spark.createDataFrame(edges, EDGE))
    m = np.zeros((n, n))
    for _, a, b, _t, c in edges:
        m[a, b] += c
    values, vectors = np.linalg.eig(m)
    want = np.real(vectors[:, np.argmax(values.real)])
    want = want / np.linalg.norm(want) * np.sign(want.sum())
    out = Expander(direction=OUT)
    column = lambda df: [x.eigenvector for x in df.orderBy("id").collect()]
    assert column(centrality.eigenvector(g, F.col("cost"), out, precision=1e-5)) == pytest.approx(want.tolist(), abs=1e-3)
    assert column(centrality.eigenvector_arnoldi(g, F.col("cost"), out, precision=1e-8)) == pytest.approx(want.tolist(), abs=1e-6)
    b = np.arange(1.0, n + 1)
    sparse = spark.createDataFrame([(a, c, float(m[a, c]) + 9 * (a == c)) for a in range(n) for c in range(n) if m[a, c] or a == c], "row int, col int, value double")
    got = {x.row: x.value for x in centrality.solve_large(sparse, spark.createDataFrame(list(enumerate(b.tolist())), "row int, value double")).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(np.linalg.solve(m + 9 * np.eye(n), b).tolist(), abs=1e-6)
    assert centrality.solve(spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0)], "row int, col int, value double"), spark.createDataFrame([(0, 2.0), (1, 2.0)], "row int, value double")) == [1.0, 0.5]


def test_patterns(spark):
    toy = Toy(spark, 14, n=6, m=14)
    e = toy.edges
    p = Pattern((PatternNode("x"), PatternNode("y"), PatternNode("z")), (PatternRel("x", "y", "RAIL"), PatternRel("y", "z", "ROAD", BOTH), PatternRel("x", "z")))
    want = set()
    for i, j, k in itertools.permutations(e, 3):
        if i[3] == "RAIL" and j[3] == "ROAD":
            want |= {(i[1], i[2], z, i[0], j[0], k[0]) for y, z in ((j[1], j[2]), (j[2], j[1])) if y == i[2] and k[1] == i[1] and k[2] == z}
    got = [(r.x, r.y, r.z, r.r0, r.r1, r.r2) for r in pattern.match(toy.graph, p).collect()]
    assert sorted(got) == sorted(want)
    own = pattern.match(toy.graph, Pattern(p.nodes, p.rels, distinct_nodes=True)).collect()
    assert sorted((r.x, r.y, r.z) for r in own) == sorted(w[:3] for w in want if len(set(w[:3])) == 3)
    loops = pattern.match(toy.graph, Pattern((PatternNode("x"),), (PatternRel("x", "x"),))).collect()
    assert sorted((r.x, r.r0) for r in loops) == sorted((a, k) for k, a, b, *_ in e if a == b)
    rail = Pattern((PatternNode("y"), PatternNode("u")), (PatternRel("y", "u", "RAIL"),))
    road = Pattern((PatternNode("x"), PatternNode("v")), (PatternRel("v", "x", "ROAD"),))
    both = Pattern((PatternNode("x", 0), PatternNode("y")), (PatternRel("x", "y", "RAIL"),), (rail, road))
    want = []
    for i in (i for i in e if i[1] == 0 and i[3] == "RAIL"):
        us, vs = [k for k in e if k[1] == i[2] and k[3] == "RAIL"] or [None], [k for k in e if k[2] == 0 and k[3] == "ROAD"] or [None]
        want += [(i[2], u and u[2], v and v[1]) for u in us for v in vs]
    got = [(r.y, r.u, r.v) for r in pattern.match(toy.graph, both).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    grouped = Pattern((PatternNode("x"), PatternNode("y")), (PatternRel("x", "y", name="way"),), keep={"way": ("cost",)}, any_group=True)
    grouped = grouped.group("cheap", F.col("way_cost") < 2, F.col("x") < 4).group("home", F.col("y") == 0)
    assert sorted(r.way for r in pattern.match(toy.graph, grouped).collect()) == sorted(k for k, a, b, _t, c in e if (c < 2 and a < 4) or b == 0)
    with pytest.raises(ValueError):
        pattern.match(toy.graph, Pattern((PatternNode("a"), PatternNode("b"), PatternNode("c"), PatternNode("d")), (PatternRel("a", "b"), PatternRel("c", "d"))))


def test_expanders(spark):
    toy = Toy(spark, 17)
    assert Direction.BOTH.reverse() is BOTH and OUT.reverse() is IN
    e = Expander().add("RAIL", OUT)
    for v in range(toy.n):
        assert toy.graph.relationships(v, e).count() == sum(a == v and t == "RAIL" for _, a, b, t, _ in toy.edges)
        assert toy.graph.relationships(v, e.reversed()).count() == sum(b == v and t == "RAIL" for _, a, b, t, _ in toy.edges)
        assert toy.graph.relationships(v).count() == len(toy.ways(v))
        assert toy.graph.relationships(v, Expander().remove("RAIL")).count() == sum(toy.edges[w[1]][3] != "RAIL" for w in toy.ways(v))
    loop = generators.chain(spark, "q,q")
    assert loop.degree().first()["degree"] == 1
    with pytest.raises(PySparkException):
        generators.chain(spark, "p,q", "p,r").single_relationship(Expander(direction=OUT)).collect()


def test_look_ups_by_id_reach_the_scan(spark):
    g = tables.geography(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,7)" in plan(g.node(tables.CUSTOMER * tables.STEP + 7))
    assert "supplier" not in plan(g.node(tables.CUSTOMER * tables.STEP + 7)).split("== Physical Plan ==")[1]
    assert "EqualTo(s_nationkey,3)" in plan(g.relationships(tables.NATION * tables.STEP + 3))


def test_adjacency_is_not_shuffled_again(spark):
    """A level's join with the bucketed adjacency only moves the level."""
    from larkspur.plans.steps import keyed, superseded

    toy = Toy(spark, 1)
    adj, before = keyed(toy.graph.adjacency(), "frm"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = toy.start(*range(toy.n)).join(adj, F.col("id") == F.col("frm"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert got.count() == sum(len(toy.ways(v)) for v in range(toy.n))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    superseded(adj)
    assert not spark.catalog.tableExists(adj._table)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "oak", ["x", "y"], 5), (2, None, None, None), (3, "oak\n", ["z"], 50)], "id int, s string, tags array<string>, n int")
    hits = lambda c: [r["id"] for r in df.where(c).collect()]
    assert hits(P.exact_any(df, "tags", "x")) == hits(P.exact_any_of(df, "tags", ["q", "y"])) == hits(P.exact_any(df, "n", 5)) == [1]
    assert hits(P.regex_full(F.col("s"), "oa")) == [] and hits(P.regex_full(F.col("s"), "oa.")) == [1] and hits(P.regex_partial(F.col("s"), "A", True)) == [1, 3]
    assert hits(P.compare(df, "tags", ">", "x")) == [1, 3] and hits(P.compare(df, "n", "<", "6")) == [1, 3] and hits(P.compare(df, "n", "<", 6)) == [1]
    assert [r[0] for r in df.select(P.property_keys(df)).collect()] == [["s", "tags", "n"], [], ["s", "tags", "n"]]
    assert hits(P.property_filter(P.properties(df.drop("tags")), {"S": "O.K"}, ignore_case=True)) == [1]
    assert df.select(P.as_set(F.col("n"), False)).first()[0] == [5]
    value = lambda x, kind: df.select(P.xsd_value(F.lit(x), kind)).first()[0]
    assert value("2021-03-04", "date") == value("2021-03-04Z", "date") == value("2021-03-04-05:00", "date") == datetime.date(2021, 3, 4)
    assert value("1999+02:00", "gYear") == 1999 and value("x", "gYear") is None and value("0", "boolean") is False and value("yes", "boolean") is None
    assert value("2021-03-04T05:06:07+01:00", "dateTime") == value("2021-03-04T04:06:07Z", "dateTime") == datetime.datetime(2021, 3, 4, 4, 6, 7) and value("2021-03-04", "dateTime") is None
    with pytest.raises(ValueError):
        P.xsd_value(F.col("s"), "nothing")


TEXTS = ["green boat on a quiet lake", "old boat", "green hill", "Quiet quiet night", "lake side hill walk", "bright lamp"]


@pytest.mark.parametrize(
    ("query", "fits"),
    [
        ("boat", lambda w: "boat" in w), ("boat hill", lambda w: "boat" in w or "hill" in w), ("+green +boat", lambda w: {"green", "boat"} <= {*w}), ("boat -old", lambda w: "boat" in w and "old" not in w),
        ("green AND hill", lambda w: {"green", "hill"} <= {*w}), ("qui*", lambda w: any(x.startswith("qui") for x in w)), ("l?ke", lambda w: "lake" in w), ('"quiet lake"', lambda w: "quiet lake" in " ".join(w)),
        ("boot~", lambda w: "boat" in w), ("[lake TO night]", lambda w: any("lake" <= x <= "night" for x in w)), ("{lake TO night}", lambda w: any("lake" < x < "night" for x in w)), ("NOT hill", lambda w: "hill" not in w),
        ("(boat OR hill) AND green", lambda w: "green" in w and ("boat" in w or "hill" in w)), ("+absent +boat", lambda w: False),
    ],
)
def test_fulltext_queries(spark, query, fits):
    i = spark.createDataFrame([("t", t, n) for n, t in enumerate(TEXTS)], "key string, value string, node int")
    assert sorted(r.node for r in index.query(i, "t", query).collect()) == [n for n, t in enumerate(TEXTS) if fits(t.lower().split())]


def test_index_changes_and_timeline(spark):
    i = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 3)], "key string, value string, node long")
    with pytest.raises(PySparkException):
        index.get_single(i, "k", "a").collect()
    assert index.get_single(i, "k", "z").count() == 0 and index.get_single(i, "k", "b").first()["node"] == 3
    one = index.add(i, spark.createDataFrame([("k", "a", 9), ("k", "a", 8)], "key string, value string, node long"), single=True)
    assert index.get(one, "k", "a").collect()[0]["node"] == 9 and one.count() == 2
    assert index.remove(i, spark.createDataFrame([(1, "k")], "node long, key string")).count() == 2
    held = index.Indexes()
    held.put("i", i)
    assert held.names() == ["i"] and held.command("index -c i k a").first()["size"] == 2 and [r.node for r in held.command("index -q i k b").collect()] == [3]
    held.clear("i")
    assert held.get("i").count() == 0
    held.drop("i")
    with pytest.raises(KeyError):
        held.get("i")
    t = spark.createDataFrame([(n, n * 10) for n in range(5)], "node long, ts int")
    assert [r["node"] for r in index.between(t, 10, 40).orderBy("ts").collect()] == [2, 3]
    assert index.ends(t).first() == (0, 4) and index.between(t).count() == 5 and index.at(t, 20).first()["node"] == 2
    assert [r.node for r in index.sorted_from(t, "ts", 15, 2).collect()] == [2, 3]


def test_statements(spark):
    q = spark.createDataFrame([("ann", "likes", "tea", "uri", c) for c in ("home", "work", "default")] + [("ann", "name", "Ann Bird", "literal", "default")], "s string, p string, o string, o_kind string, ctx string")
    assert rdf.find(q, "ann", "likes", rdf.ANY).count() == 3 and rdf.find(q, rdf.ANY, rdf.ANY, "tea", None).count() == 1
    assert rdf.remove(q, "ann", "likes", "tea").count() == 1 and rdf.add(q, q).count() == 4
    assert rdf.rename_context(q, "home", "work").where("p = 'likes'").count() == 2
    with pytest.raises(ValueError):
        rdf.find(q, rdf.ANY, rdf.ANY, rdf.ANY, "home", "work")
    assert rdf.search(q, "bird").first()["s"] == "ann" and "Bird" in rdf.search(q, "bird", 1).first()["snippet"]
    assert rdf.verify(q, rdf.literals(q)).count() == 0 and rdf.as_graph(q).edges.count() == 3
    m = rdf.with_metadata(q.withColumn("meta", F.create_map().cast("map<string,string>")), "by", F.lit("x"), F.col("p") == "name")
    assert m.where("meta['by'] = 'x'").count() == 1 and rdf.without_metadata(m, "by", F.lit(True)).where("meta['by'] is not null").count() == 0
    for text in ("ASK { ?s ?p ?o }", "SELECT ?s { { ?s <p> ?o } UNION { ?s <q> ?o } }", "SELECT ?s { ?s <p> ?o } ORDER BY ?s"):
        with pytest.raises(NotImplementedError):
            rdf.evaluate(q, text)
    got = rdf.evaluate(q, 'PREFIX x: <lik> SELECT DISTINCT * WHERE { ?a x:es ?b ; <name> ?n FILTER ( regex(?n, "^ann", "i") && ?a != "z" ) }')
    assert [r.asDict() for r in got.collect()] == [{"a": "ann", "b": "tea", "n": "Ann Bird"}]
    two = q.union(spark.createDataFrame([("ben", "likes", "tea", "uri", "home"), ("ben", "name", "Ben", "literal", "home")], q.schema))
    got = rdf.evaluate(two, 'SELECT ?a ?n { ?a <likes> <tea> OPTIONAL { ?a <name> ?n FILTER ( ?n < "B" ) } }')
    assert {(r.a, r.n) for r in got.collect()} == {("ann", "Ann Bird"), ("ben", "")}


def test_model(spark):
    up = spark.createDataFrame([("Oak", "Tree"), ("Elm", "Tree"), ("Tree", "Plant"), ("Plant", "Plant")], "sub string, super string")
    assert metamodel.is_sub_of(up, "Oak", "Plant") and not metamodel.is_sub_of(up, "Tree", "Oak")
    inst = spark.createDataFrame([("Oak", "x"), ("Tree", "y")], "class string, instance string")
    got = {(r["class"], r["instance"]) for r in metamodel.all_instances(up, inst).collect()}
    assert {("Plant", "x"), ("Tree", "x"), ("Plant", "y")} <= got and ("Oak", "y") not in got
    rest = spark.createDataFrame([("Tree", "age", "int"), ("Oak", "age", "short")], "class string, property string, range string")
    props = spark.createDataFrame([("measure", "double")], "property string, range string")
    sub = spark.createDataFrame([("age", "measure")], "sub string, super string")
    values = {(r["class"], r["property"]): r["value"] for r in metamodel.lookup(up, rest, props, sub, "range").collect()}
    assert values["Oak", "age"] == "short" and values["Elm", "age"] == "int" and values["Plant", "age"] == "double"
    v = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None)], "instance string, value string")
    assert [r["instance"] for r in metamodel.cardinality_violations(v, 1, 2).collect()] == ["b"]
    df = spark.createDataFrame([("5",), ("x",)], "v string")
    assert df.where(metamodel.in_range(F.col("v"), "datatype", "int")).count() == 1 == df.where(metamodel.in_range(F.col("v"), "data", ["x"])).count()


def test_collections(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert sorted(r.x for r in collections.bag_union(a, b).collect()) == [1, 1, 2, 2, 3]
    assert [r.x for r in collections.retain_all(a, b).collect()] == [2] and collections.add_all(a, b).count() == 3 and collections.remove_all(a, b).count() == 2
    assert [r.x for r in collections.queue_rest(b, ["x"], 1, lifo=True).collect()] == [2]
    toy = Toy(spark, 9, n=10, m=11)
    gone = {j for (i, j) in floyd(10, toy.edges) if i == 4}
    left = collections.delete_reachable(toy.graph, toy.start(4), Expander(direction=OUT))
    assert {r.id for r in left.nodes.collect()} == set(range(10)) - gone and {r.eid for r in left.edges.collect()} == {k for k, x, y, *_ in toy.edges if not {x, y} & gone}

    def refuse(found):
        raise ValueError(found.count())

    with pytest.raises(ValueError, match="11"):
        collections.handled(toy.graph, toy.graph.set_property("name", F.lit("x")).create_nodes(spark.createDataFrame([(77,)], "id long")), refuse)
    many = collections.Typed("RAIL")
    g = many.set(toy.graph, spark.createDataFrame([(0, 1), (0, 1), (0, 2)], "id long, other long"))
    assert {(r.id, r.other) for r in many.get(g).collect()} == {(x, y) for _, x, y, t, _ in toy.edges if t == "RAIL"} | {(0, 1), (0, 2)}
    with pytest.raises(ValueError):
        collections.Migration().apply(toy.graph, 3)


def test_sources(spark, tmp_path):
    toy = Toy(spark, 10)
    tables.write_graph(toy.graph, f"file://{tmp_path}/g")
    again = tables.read_graph(spark, f"file://{tmp_path}/g")
    assert again.nodes.count() == toy.n and again.edges.where("type = 'RAIL'").count() == sum(e[3] == "RAIL" for e in toy.edges)
    tables.write_dot(toy.graph, f"file://{tmp_path}/dot")
    text = "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("part-*")))
    assert text.startswith("digraph graph_ {\n") and text.endswith("}\n") and text.count("->") == len(toy.edges)
    (tmp_path / "e.csv").write_text("1,2,KNOWS\n2,3,LIKES\n")
    assert tables.read_edges_csv(spark, f"file://{tmp_path}/e.csv").count() == 2
    (tmp_path / "t.nq").write_text('<a> <b> <c> .\n<a> <n> "x \\"y\\""@en <g> .\n_:b <p> "5"^^<int> .\n# no\n')
    got = {r["p"]: r for r in tables.read_ntriples(spark, f"file://{tmp_path}/t.nq").collect()}
    assert len(got) == 3 and (got["n"]["o"], got["n"]["lang"], got["n"]["ctx"]) == ('x "y"', "en", "g") and got["p"]["datatype"] == "int"


def test_generators_give_the_same_again(spark):
    a, b = (generators.random_graph(spark, 50, 200, seed=3).edges.orderBy("eid").collect() for _ in range(2))
    assert a == b and len(a) == 200
    g = generators.layered(spark, 4, 5, 2)
    assert g.edges.count() == 30 and g.edges.where("floor(dst / 5) <> floor(src / 5) + 1").count() == 0
    p = generators.preferential_attachment(spark, 60, 2, seed=1)
    assert p.edges.count() == 118 and p.edges.where("dst is null or dst >= src").count() == 0
    w = generators.small_world(spark, 100, 4, 0.2, seed=5).edges
    assert w.count() == 400 and 20 < w.where("pmod(dst - src, 100) not between 1 and 4").count() < 140


def test_streams(spark):
    from larkspur.plans.steps import new_path
    from larkspur.streaming import timeline

    events = timeline.stream_table(spark, "/root/testdata/sf0.001", "events")
    seen = []
    timeline.work_off(events, lambda df, _: seen.append(df.count()), spark).awaitTermination()
    assert sum(seen) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    out = new_path(spark, "counts")
    timeline.windowed_counts(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] > 0.9 * sum(seen)
