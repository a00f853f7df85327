"""Queries over the driver's tables, one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .graph import BOTH, IN, OUT, Expander, PropertyGraph
from .operators import centrality, collections, generators, index, metamodel, paths, pattern, rdf, traversal
from .operators.pattern import Pattern, PatternNode, PatternRel
from .operators.traversal import Traversal
from .sources import tables
from .streaming import timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def text(col: str):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), "-")


def ids(spark: SparkSession, *node_ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in node_ids], "id long")


# SQL views of the graphs in sources.tables.
GEO = """
  geo_nodes AS (
    SELECT 1000000000000 + r_regionkey AS id, 'region' AS label, r_name AS name, NULL::DOUBLE AS acctbal, NULL::VARCHAR AS segment FROM region
    UNION ALL SELECT 2000000000000 + n_nationkey, 'nation', n_name, NULL, NULL FROM nation
    UNION ALL SELECT 3000000000000 + c_custkey, 'customer', c_name, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT 4000000000000 + s_suppkey, 'supplier', s_name, s_acctbal, NULL FROM supplier),
  geo AS (
    SELECT 2000000000000 + n_nationkey AS eid, 2000000000000 + n_nationkey AS src, 1000000000000 + n_regionkey AS dst, 'IN_REGION' AS type FROM nation
    UNION ALL SELECT 3000000000000 + c_custkey, 3000000000000 + c_custkey, 2000000000000 + c_nationkey, 'LOCATED_IN' FROM customer
    UNION ALL SELECT 4000000000000 + s_suppkey, 4000000000000 + s_suppkey, 2000000000000 + s_nationkey, 'LOCATED_IN' FROM supplier)"""
RING = """
  n AS (SELECT count(*) AS n FROM supplier),
  ring AS (
    SELECT * FROM (
      SELECT s_suppkey * 2 AS eid, s_suppkey AS src, (s_suppkey * 7 + 3) % n AS dst, 'HOP' AS type, 1 + s_suppkey % 5 AS cost FROM supplier, n
      UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey, (s_suppkey + 1) % n, 'NEXT', 3 + s_suppkey % 3 FROM supplier, n) WHERE src <> dst)"""
TRADE = """
  sales AS (
    SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, sum(round(l_extendedprice * 100)::BIGINT) AS cents
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
  trade AS (SELECT src * 2 + rank AS eid, src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cents DESC, dst) AS rank FROM sales) WHERE rank <= 2),
  both_ways AS (SELECT eid, src AS frm, dst AS "to", rank FROM trade UNION ALL SELECT eid, dst, src, rank FROM trade)"""
QUADS = """
  quads AS (
    SELECT 'supplier:' || s_suppkey AS s, 'rdf:type' AS p, 'Supplier' AS o, 'uri' AS kind, 'nation:' || s_nationkey AS ctx FROM supplier
    UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, 'uri', 'nation:' || s_nationkey FROM supplier
    UNION ALL SELECT 'supplier:' || s_suppkey, 'name', s_name, 'literal', 'nation:' || s_nationkey FROM supplier
    UNION ALL SELECT 'supplier:' || s_suppkey, 'balance', NULL, 'literal', 'nation:' || s_nationkey FROM supplier WHERE s_acctbal >= 5000)"""
MODEL = """
  sub AS (
    SELECT * FROM (VALUES ('Company', 'Thing'), ('Place', 'Thing'), ('Supplier', 'Company'), ('Customer', 'Company'), ('Nation', 'Place'), ('Region', 'Place')) t(sub, super)
    UNION ALL SELECT DISTINCT 'Customer ' || c_mktsegment, 'Customer' FROM customer),
  up AS (SELECT sub, super, 1 AS depth FROM sub UNION SELECT up.sub, sub.super, depth + 1 FROM up JOIN sub ON up.super = sub.sub)"""


# Scans and adjacency.
@query(f"WITH {GEO} SELECT label, count(*) AS n FROM geo_nodes GROUP BY label")
def scan_nodes(spark, d):
    return tables.geography(spark, d).nodes.groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {GEO} SELECT id, label, name FROM geo_nodes WHERE id = 3000000000007")
def node_by_id(spark, d):
    return tables.geography(spark, d).node(3 * tables.STEP + 7).select("id", "label", "name")


@query(f"WITH {GEO} SELECT eid, src, dst, type FROM geo WHERE eid = 2000000000003")
def relationship_by_id(spark, d):
    return tables.geography(spark, d).relationship(2 * tables.STEP + 3)


@query("SELECT * FROM (VALUES ('IN_REGION'), ('LOCATED_IN'), ('PLACED'), ('CONTAINS'), ('SUPPLIES')) t(type)")
def relationship_types(spark, d):
    return tables.commerce(spark, d).relationship_types()


@query(f"WITH {GEO} SELECT id, label, name FROM geo_nodes WHERE id = 1000000000000")
def reference_node(spark, d):
    return tables.geography(spark, d).reference_node().select("id", "label", "name")


@query(f"WITH {GEO} SELECT eid, type, 2000000000003 AS node, dst AS other FROM geo WHERE src = 2000000000003 UNION ALL SELECT eid, type, 2000000000003, src FROM geo WHERE dst = 2000000000003")
def relationships_of_node(spark, d):
    return tables.geography(spark, d).relationships(2 * tables.STEP + 3)


@query(f"WITH {GEO} SELECT eid, type, 2000000000003 AS node, src AS other FROM geo WHERE dst = 2000000000003 AND type = 'LOCATED_IN'")
def relationships_by_type_and_direction(spark, d):
    return tables.geography(spark, d).relationships(2 * tables.STEP + 3, Expander((("LOCATED_IN", IN),)))


@query("SELECT 3000000000000 + o_custkey AS id, 'PLACED' AS type, count(*) AS degree FROM orders GROUP BY o_custkey")
def out_degree_by_type(spark, d):
    return tables.commerce(spark, d).degree(Expander((("PLACED", OUT),)), by_type=True)


@query("SELECT 5000000000000 + l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY l_partkey")
def in_degree(spark, d):
    return tables.commerce(spark, d).degree(Expander((("CONTAINS", IN),)))


@query(f"WITH {GEO} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM geo UNION ALL SELECT dst FROM geo) GROUP BY id")
def both_degree(spark, d):
    return tables.geography(spark, d).degree()


@query("SELECT 3000000000000 + c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def has_relationship(spark, d):
    return tables.commerce(spark, d).with_relationship(Expander((("PLACED", OUT),))).select("id")


@query("SELECT 3000000000000 + c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders))")
def lacks_relationship(spark, d):
    """Customers without a large order."""
    g = tables.commerce(spark, d)
    large = tables.table(spark, d, "orders").agg(F.avg("o_totalprice") * 1.5).first()[0]
    return PropertyGraph(g.nodes.where("label = 'customer'"), g.edges).with_relationship(Expander((("PLACED", OUT),)).where_rel(F.col("price") > large), has=False).select("id")


@query(f"WITH {GEO} SELECT id, eid, dst AS other FROM geo_nodes LEFT JOIN geo ON src = id AND type = 'IN_REGION'")
def single_relationship(spark, d):
    return tables.geography(spark, d).single_relationship(Expander((("IN_REGION", OUT),)))


@query(f"WITH {GEO} SELECT src AS id, eid, type, dst AS other FROM geo UNION ALL SELECT dst, eid, type, src FROM geo")
def expansion(spark, d):
    g = tables.geography(spark, d)
    return g.expand(g.nodes)


@query(f"WITH {GEO} SELECT DISTINCT src AS id, dst AS other FROM geo JOIN geo_nodes ON id = src WHERE type = 'LOCATED_IN' AND acctbal > 5000 AND dst <> 2000000000003")
def expansion_pairs(spark, d):
    """Pairs of an expansion, without one node and only from some."""
    g = tables.geography(spark, d)
    got = g.expansion(g.nodes.where("acctbal > 5000"), Expander((("LOCATED_IN", OUT),)), including=g.nodes, excluding=ids(spark, 2 * tables.STEP + 3))
    return got.select("id", "other").distinct()


@query(f"WITH {GEO} SELECT src AS id, count(*) AS degree FROM geo JOIN geo_nodes ON id = dst WHERE name LIKE '%5' AND type <> 'IN_REGION' GROUP BY src")
def expander_filters(spark, d):
    e = Expander(direction=OUT).remove("IN_REGION").where_node(F.col("name").endswith("5"))
    return tables.geography(spark, d).degree(e)


@query("SELECT 3000000000000 + o_custkey AS id, count(*) AS degree FROM orders WHERE o_totalprice < 100000 GROUP BY o_custkey")
def expander_relationship_filter(spark, d):
    return tables.commerce(spark, d).degree(Expander((("PLACED", OUT),)).where_rel(F.col("price") < 100000))


# Properties and predicates.
@query(f"WITH {GEO} SELECT id, coalesce(acctbal, 0) AS bal, segment IS NOT NULL AS has_segment FROM geo_nodes")
def property_get_default_has(spark, d):
    n = tables.geography(spark, d).nodes
    return n.select("id", P.get("acctbal", 0.0).alias("bal"), P.has(F.col("segment")).alias("has_segment"))


@query(f"WITH {GEO} SELECT id, array_to_string(list_filter([CASE WHEN name IS NOT NULL THEN 'name' END, CASE WHEN acctbal IS NOT NULL THEN 'acctbal' END, CASE WHEN segment IS NOT NULL THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS keys FROM geo_nodes")
def property_keys(spark, d):
    n = tables.geography(spark, d).nodes
    return n.select("id", F.array_join(P.property_keys(n), ",").alias("keys"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_exact(spark, d):
    return tables.table(spark, d, "customer").where(P.exact(F.col("c_mktsegment"), "BUILDING")).select("c_custkey")


WORDS = "(SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)"


def _words(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))


@query(f"SELECT p_partkey FROM {WORDS} WHERE list_contains(words, (SELECT min(w) FROM (SELECT unnest(words) AS w FROM {WORDS})))")
def filter_exact_any(spark, d):
    w = _words(spark, d)
    least = w.select(F.explode("words").alias("w")).agg(F.min("w")).first()[0]
    return w.where(P.exact_any(w, "words", least)).select("p_partkey")


@query(f"SELECT p_partkey FROM {WORDS} WHERE list_has_any(words, (SELECT [min(w), max(w)] FROM (SELECT unnest(words) AS w FROM {WORDS})))")
def filter_exact_any_of(spark, d):
    w = _words(spark, d)
    both = w.select(F.explode("words").alias("w")).agg(F.min("w"), F.max("w")).first()
    return w.where(P.exact_any_of(w, "words", list(both))).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE regexp_full_match(c_mktsegment, 'B.*|.*Y')")
def filter_regex_full(spark, d):
    return tables.table(spark, d, "customer").where(P.regex_full(F.col("c_mktsegment"), "B.*|.*Y")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, 'build|ery', 'i')")
def filter_regex_partial(spark, d):
    return tables.table(spark, d, "customer").where(P.regex_partial(F.col("c_mktsegment"), "build|ery", True)).select("c_custkey")


@query(f"SELECT p_partkey FROM {WORDS} WHERE len(list_filter(words, lambda w: w >= 's')) > 0")
def filter_compare_any(spark, d):
    w = _words(spark, d)
    return w.where(P.compare(w, "words", ">=", "s")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE (c_acctbal < 0 OR c_acctbal >= 9000) AND c_mktsegment <> 'BUILDING'")
def filter_and_or(spark, d):
    c = tables.table(spark, d, "customer")
    return c.where(P.all_of(P.any_of(P.compare(c, "c_acctbal", "<", 0), P.compare(c, "c_acctbal", ">=", 9000)), ~P.exact(F.col("c_mktsegment"), "BUILDING"))).select("c_custkey")


@query("SELECT 3000000000000 + c_custkey AS id FROM customer WHERE regexp_matches(c_mktsegment, 'mach', 'i') AND regexp_matches(c_name, '1', 'i')")
def filter_property_map(spark, d):
    n = tables.geography(spark, d).nodes
    return n.where(P.property_filter(P.properties(n), {"segm": "mach", "na": "1"}, ignore_case=True, loose=True)).select("id")


@query(f"WITH {GEO} SELECT id FROM geo_nodes WHERE regexp_full_match(id::VARCHAR, '.*00[12]') OR regexp_full_match(name, '.*00[12]') OR regexp_full_match(segment, '.*00[12]') OR regexp_full_match(acctbal::VARCHAR, '.*00[12]')")
def free_search(spark, d):
    n = tables.geography(spark, d).nodes
    return n.where(P.free_search(F.col("id"), P.properties(n), ".*00[12]")).select("id")


@query("SELECT n_nationkey, round(2 * 6371 * sin(radians(n_nationkey * 3.0) / 2), 6) AS km FROM nation")
def geo_distance(spark, d):
    n = tables.table(spark, d, "nation")
    return n.select("n_nationkey", F.round(P.chord_km(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(10.0) + F.col("n_nationkey") * 3.0), 6).alias("km"))


@query("SELECT doc_id, CASE WHEN try_cast(source[4:] AS INTEGER) IS NOT NULL THEN source[4:]::INTEGER END AS v FROM documents")
def xsd_values(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", P.xsd_value(F.substring("source", 4, 100), "int").alias("v"))


# Traversals.
REACH = """
  reach AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM reach JOIN ring ON src = id WHERE depth < {k})"""
RING_OUT = Expander(direction=OUT)


@query(f"WITH RECURSIVE {RING}, {REACH.format(k=5)} SELECT id, min(depth) AS depth FROM reach GROUP BY id")
def traverse_breadth_first(spark, d):
    t = Traversal(RING_OUT).breadth_first().prune_after(5)
    return traversal.nodes(t.reached(tables.ring(spark, d), ids(spark, 0))).select("id", "depth")


@query(f"WITH RECURSIVE {RING}, r AS (SELECT 0::BIGINT AS id UNION SELECT dst FROM r JOIN ring ON src = id) SELECT id FROM r")
def reachable_nodes(spark, d):
    return Traversal(RING_OUT).reached(tables.ring(spark, d), ids(spark, 0)).select(F.col("node").alias("id"))


@query(f"WITH RECURSIVE {RING}, {REACH.format(k=2)}, low AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id) SELECT eid, min(depth) + 1 AS depth FROM low JOIN ring ON src = id GROUP BY eid")
def relationship_global(spark, d):
    t = Traversal(RING_OUT, traversal.RELATIONSHIP_GLOBAL).prune_after(3)
    return traversal.relationships(t.traverse(tables.ring(spark, d), ids(spark, 0))).select("eid", "depth")


TRAILS = """
  trails AS (
    SELECT 0::BIGINT AS node, [0::BIGINT] AS nodes, []::BIGINT[] AS rels, []::BIGINT[] AS key
    UNION ALL SELECT "to", list_append(nodes, "to"), list_append(rels, eid), list_append(key, eid)
    FROM trails JOIN {edges} ON frm = node WHERE len(rels) < {k} AND {rule})"""
DIRECTED = ', adj AS (SELECT eid, src AS frm, dst AS "to", cost FROM ring)'
BOTH_RING = ', adj AS (SELECT eid, src AS frm, dst AS "to", cost FROM ring UNION ALL SELECT eid, dst, src, cost FROM ring)'


def _trails(k, rule="NOT list_contains(rels, eid)", edges="adj"):
    return TRAILS.format(edges=edges, k=k, rule=rule)


TRAIL_COLS = "array_to_string(nodes, '-') AS nodes, array_to_string(rels, '-') AS rels"


@query(f"WITH RECURSIVE {RING}{BOTH_RING}, {_trails(3)} SELECT {TRAIL_COLS} FROM trails")
def relationship_path(spark, d):
    t = Traversal(uniqueness=traversal.RELATIONSHIP_PATH, max_depth=3)
    return t.traverse(tables.ring(spark, d), ids(spark, 0)).select(text("nodes").alias("nodes"), text("rels").alias("rels"))


@query(f"""WITH RECURSIVE {RING}{BOTH_RING}, {_trails(3, 'NOT list_contains(nodes, "to")')} SELECT {TRAIL_COLS} FROM trails""")
def node_path(spark, d):
    t = Traversal(uniqueness=traversal.NODE_PATH, max_depth=3)
    return t.traverse(tables.ring(spark, d), ids(spark, 0)).select(text("nodes").alias("nodes"), text("rels").alias("rels"))


@query(f"WITH RECURSIVE {RING}{BOTH_RING}, {_trails(3, '(len(rels) = 0 OR rels[-1] <> eid)')} SELECT {TRAIL_COLS} FROM trails")
def no_uniqueness(spark, d):
    t = Traversal(uniqueness=traversal.NONE, max_depth=3)
    return t.traverse(tables.ring(spark, d), ids(spark, 0)).select(text("nodes").alias("nodes"), text("rels").alias("rels"))


def _ordered(order):
    def run(spark, d):
        t = Traversal(RING_OUT, traversal.RELATIONSHIP_PATH, order=order, max_depth=4)
        return t.ranked(tables.ring(spark, d), ids(spark, 0)).select("pos", text("rels").alias("rels"))

    return run


for _name, _order, _sort in (
    ("order_pre_depth", traversal.PRE_DEPTH, "key"),
    ("order_pre_breadth", traversal.PRE_BREADTH, "len(key), key"),
    ("order_post_depth", traversal.POST_DEPTH, "list_append(key, 9223372036854775807)"),
    ("order_post_breadth", traversal.POST_BREADTH, "len(key) DESC, key"),
):
    QUERIES[_name] = _ordered(_order)
    ORACLE_SQL[_name] = f"WITH RECURSIVE {RING}{DIRECTED}, {_trails(4)} SELECT row_number() OVER (ORDER BY {_sort}) AS pos, array_to_string(rels, '-') AS rels FROM trails"


@query(f"WITH RECURSIVE {RING}, r AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN ring ON src = id WHERE depth < 6 AND (depth = 0 OR id % 4 <> 3)) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING id % 2 = 1 AND min(depth) > 0")
def prune_and_filter(spark, d):
    t = Traversal(RING_OUT, traversal.NODE_GLOBAL).prune(F.col("node") % 4 == 3).prune_after(6).filter(F.col("depth") > 0).filter(F.col("node") % 2 == 1)
    return t.traverse(tables.ring(spark, d), ids(spark, 0)).select(F.col("node").alias("id"), "depth")


@query(f"WITH RECURSIVE {RING}, {REACH.format(k=4)}, low AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id) SELECT id FROM low WHERE id % 5 = 0 OR depth = 2")
def filter_any(spark, d):
    t = Traversal(RING_OUT).prune_after(4).filter_any(F.col("node") % 5 == 0, F.col("depth") == 2)
    return t.traverse(tables.ring(spark, d), ids(spark, 0)).select(F.col("node").alias("id"))


@query(f"""WITH {GEO} SELECT c.src AS id, 2 AS depth FROM geo n JOIN geo c ON c.dst = n.src JOIN geo_nodes x ON x.id = c.src
           WHERE n.dst = 1000000000000 AND x.label = 'customer'""")
def customers_within_two_hops(spark, d):
    t = Traversal(Expander((("IN_REGION", IN), ("LOCATED_IN", IN))), max_depth=2, with_nodes=("label",)).filter(F.col("label") == "customer")
    return t.traverse(tables.geography(spark, d), ids(spark, tables.STEP)).select(F.col("node").alias("id"), "depth")


@query(f"WITH RECURSIVE {RING}, x AS (SELECT eid, src AS frm, dst AS \"to\", CASE type WHEN 'NEXT' THEN 0 ELSE 1 END AS k FROM ring), t AS (SELECT 0::BIGINT AS node, [] ::BIGINT[] AS rels, []::BIGINT[] AS key UNION ALL SELECT \"to\", list_append(rels, eid), list_append(key, k * 1000000000 + eid) FROM t JOIN x ON frm = node WHERE len(rels) < 3 AND NOT list_contains(rels, eid)) SELECT row_number() OVER (ORDER BY key) AS pos, array_to_string(rels, '-') AS rels FROM t")
def ordered_by_type(spark, d):
    t = Traversal(Expander((("NEXT", OUT), ("HOP", OUT))), traversal.RELATIONSHIP_PATH, max_depth=3)
    return t.ranked(tables.ring(spark, d), ids(spark, 0)).select("pos", text("rels").alias("rels"))


#: Trails with type ranks, each node's first one, in breadth-first order.
LEGACY = """
  x AS (SELECT eid, src AS frm, dst AS "to", CASE type WHEN 'HOP' THEN 0 ELSE 1 END AS k FROM ring),
  t AS (SELECT 0::BIGINT AS node, NULL::BIGINT AS previous, NULL::BIGINT AS eid, []::BIGINT[] AS key
        UNION ALL SELECT "to", node, x.eid, list_append(key, k * 1000000000 + x.eid) FROM t JOIN x ON frm = node WHERE len(key) < 3),
  f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(key), key) = 1)
  SELECT node AS id, len(key)::INTEGER AS depth, previous, eid, row_number() OVER (ORDER BY len(key), key)::INTEGER AS returned FROM f WHERE len(key) > 0"""


@query(f"WITH RECURSIVE {RING}, {LEGACY}")
def legacy_traverser(spark, d):
    got = traversal.legacy(tables.ring(spark, d), ids(spark, 0), traversal.PRE_BREADTH, F.col("depth") >= 3, traversal.ALL_BUT_START_NODE, ("HOP", OUT), ("NEXT", OUT))
    return got.select("id", "depth", "previous", "eid", "returned")


class HopsAndNexts(traversal.TraverserClass):
    """What legacy_traverser asks for, as a class."""

    types = (("HOP", OUT), ("NEXT", OUT))

    def is_stop_node(self):
        return F.col("depth") >= 3


@query(f"WITH RECURSIVE {RING}, {LEGACY}")
def traverser_class(spark, d):
    return HopsAndNexts()(tables.ring(spark, d), ids(spark, 0)).select("id", "depth", "previous", "eid", "returned")


@query(f"WITH {GEO} SELECT dst AS id FROM geo WHERE src = 4000000000001")
def traverse_depth_one(spark, d):
    """Ends of the graph and of depth one as stop conditions."""
    g = tables.geography(spark, d)
    one = traversal.legacy(g, ids(spark, 4 * tables.STEP + 1), traversal.PRE_BREADTH, traversal.DEPTH_ONE, traversal.ALL_BUT_START_NODE)
    every = traversal.legacy(g, ids(spark, 4 * tables.STEP + 1), traversal.PRE_BREADTH, traversal.END_OF_GRAPH, traversal.ALL, ("LOCATED_IN", OUT))
    return one.join(every, "id", "left_semi").select("id")


@query(f"WITH {GEO} SELECT dst AS id, 1 AS depth FROM geo WHERE src = 3000000000007 UNION ALL SELECT b.dst, 2 FROM geo a JOIN geo b ON b.src = a.dst WHERE a.src = 3000000000007")
def shell_trav(spark, d):
    got = traversal.trav(tables.geography(spark, d), ids(spark, 3 * tables.STEP + 7), types={"LOC.*": OUT, "IN_.*": OUT}, keep=lambda n: P.property_filter(P.properties(n), {"name": ".+"}), max_depth=4)
    return got.select(F.col("node").alias("id"), "depth")


def _nation_circle(spark, d):
    """Each nation to the next one, the last to the first."""
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit("nation").alias("label"))
    return PropertyGraph(n, n.select(F.col("id").alias("eid"), F.col("id").alias("src"), ((F.col("id") + 1) % 25).alias("dst"), F.lit("NEXT").alias("type")))


@query("SELECT k % 25 AS id, k::INTEGER AS depth FROM (SELECT unnest(range(0, 29)) AS k)")
def recently_unique(spark, d):
    """With a memory of five nodes the way around a circle of 25 goes on after the first node."""
    t = Traversal(RING_OUT, traversal.NODE_RECENT, recent=5).prune_after(28)
    return t.traverse(_nation_circle(spark, d), ids(spark, 0)).select(F.col("node").alias("id"), "depth")


@query("SELECT k % 25 AS eid, k + 1 AS depth FROM (SELECT unnest(range(0, 25))::INTEGER AS k)")
def recently_unique_relationships(spark, d):
    """A memory of 30 relationships ends the way where the circle closes."""
    t = Traversal(RING_OUT, traversal.RELATIONSHIP_RECENT, recent=30).prune_after(28)
    return traversal.relationships(t.traverse(_nation_circle(spark, d), ids(spark, 0))).select("eid", "depth")


@query("WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS depth FROM events) SELECT event_id AS id, depth::INTEGER AS depth FROM x")
def session_chains(spark, d):
    g = tables.sessions(spark, d)
    first = g.nodes.join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id")
    return Traversal(RING_OUT).reached(g, first).select(F.col("node").alias("id"), "depth")


@query("WITH x AS (SELECT conv_id * 1048576 + turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations) SELECT id, depth::INTEGER AS depth FROM x")
def dialogue_chains(spark, d):
    g = tables.dialogue(spark, d)
    first = g.nodes.join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id")
    return Traversal(RING_OUT).reached(g, first).select(F.col("node").alias("id"), "depth")


@query(f"""WITH RECURSIVE {RING}, x AS (SELECT 0::BIGINT AS node, 0::BIGINT AS w, []::BIGINT[] AS rels UNION ALL SELECT dst, w + cost, list_append(rels, eid) FROM x JOIN ring ON src = node WHERE len(rels) < 4 AND NOT list_contains(rels, eid))
  SELECT row_number() OVER (ORDER BY w, len(rels), rels) AS pos, w::DOUBLE AS weight, array_to_string(rels, '-') AS rels FROM x""")
def order_best_first(spark, d):
    t = Traversal(RING_OUT, traversal.RELATIONSHIP_PATH, max_depth=4).best_first(F.col("cost"))
    return t.ranked(tables.ring(spark, d), ids(spark, 0)).select("pos", "weight", text("rels").alias("rels"))


@query(f"""WITH {GEO}, many AS (SELECT dst AS id, (count(*) > 60)::INTEGER AS held FROM geo WHERE type = 'LOCATED_IN' GROUP BY dst),
  one AS (SELECT n.src AS id, [coalesce(held, 0), 0, n.eid] AS key FROM geo n LEFT JOIN many ON many.id = n.src WHERE n.dst = 1000000000000),
  two AS (SELECT c.src AS id, list_concat(key, [0, 1, c.eid]) AS key FROM one JOIN geo c ON c.dst = one.id WHERE c.type = 'LOCATED_IN')
  SELECT row_number() OVER (ORDER BY key) AS pos, id FROM (SELECT 1000000000000 AS id, []::BIGINT[] AS key UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two)""")
def order_lite_depth_first(spark, d):
    """Nations with more than 60 companies come after the others."""
    t = Traversal(Expander((("IN_REGION", IN), ("LOCATED_IN", IN))), max_depth=2).lite_depth_first(60)
    return t.ranked(tables.geography(spark, d), ids(spark, tables.STEP)).select("pos", F.col("node").alias("id"))


# Paths in the ring, from 0 to 31 and others.
PATH_COLS = f"len(rels) AS length, {TRAIL_COLS}"


def _paths(df):
    return df.select("length", text("nodes").alias("nodes"), text("rels").alias("rels"))


@query(f"WITH RECURSIVE {RING}{DIRECTED}, {_trails(6)} SELECT {PATH_COLS} FROM trails WHERE node = 31")
def all_paths(spark, d):
    return _paths(paths.all_paths(tables.ring(spark, d), 0, 31, RING_OUT, 6))


@query(f"""WITH RECURSIVE {RING}{DIRECTED}, {_trails(6, 'NOT list_contains(nodes, "to")')} SELECT {PATH_COLS} FROM trails WHERE node = 31""")
def simple_paths(spark, d):
    return _paths(paths.simple_paths(tables.ring(spark, d), 0, 31, RING_OUT, 6))


@query(f"WITH RECURSIVE {RING}{BOTH_RING}, {_trails(4)} SELECT {PATH_COLS} FROM trails WHERE node = 24 AND len(rels) = 4")
def exact_depth_paths(spark, d):
    return _paths(paths.exact_depth(tables.ring(spark, d), 0, 24, Expander(), 4))


@query(f"WITH RECURSIVE {RING}{BOTH_RING}, {_trails(5)}, p AS (SELECT * FROM trails WHERE node = 31) SELECT {PATH_COLS} FROM p WHERE len(rels) = (SELECT min(len(rels)) FROM p)")
def all_shortest_paths(spark, d):
    return _paths(paths.shortest_paths(tables.ring(spark, d), 0, 31, Expander(), 5))


@query(f"WITH RECURSIVE {RING}{BOTH_RING}, {_trails(5)}, p AS (SELECT * FROM trails WHERE node = 31) SELECT {PATH_COLS} FROM p ORDER BY len(p.rels), p.rels LIMIT 1")
def single_shortest_path(spark, d):
    return _paths(paths.single(paths.shortest_paths(tables.ring(spark, d), 0, 31, Expander(), 5)))


@query(f"WITH RECURSIVE {RING}, {REACH.format(k='(SELECT count(*) FROM supplier)')} SELECT id AS node, min(depth) AS dist FROM reach GROUP BY id")
def hop_distances(spark, d):
    return paths.hop_distances(tables.ring(spark, d), ids(spark, 0), RING_OUT).select("node", "dist")


COSTS = """
  c AS (SELECT 0::BIGINT AS node, 0::BIGINT AS dist UNION SELECT "to", dist + cost FROM c JOIN adj ON frm = node WHERE dist + cost <= {k}),
  best AS (SELECT node, min(dist) AS dist FROM c GROUP BY node)"""


#: No cheapest path costs more than a way through all nodes.
ALL_COSTS = COSTS.format(k="(SELECT 5 * count(*) FROM supplier)")


@query(f"WITH RECURSIVE {RING}{DIRECTED}, {ALL_COSTS} SELECT node, dist::DOUBLE AS dist FROM best")
def cheapest_costs(spark, d):
    return paths.distances(tables.ring(spark, d), ids(spark, 0), F.col("cost"), RING_OUT).select("node", "dist")


@query(f"WITH RECURSIVE {RING}{DIRECTED}, c AS (SELECT 0::BIGINT AS node, 0::BIGINT AS dist UNION SELECT \"to\", greatest(dist, cost) FROM c JOIN adj ON frm = node) SELECT node, min(dist)::DOUBLE AS dist FROM c GROUP BY node")
def bottleneck_costs(spark, d):
    """Costs that are not summed: the dearest relationship of the way where it is cheapest."""
    return paths.distances(tables.ring(spark, d), ids(spark, 0), F.col("cost"), RING_OUT, accumulate=F.greatest).select("node", "dist")


@query(f"WITH RECURSIVE {RING}{DIRECTED}, {COSTS.format(k=15)} SELECT node, dist::DOUBLE AS dist FROM best")
def cheapest_costs_within(spark, d):
    return paths.distances(tables.ring(spark, d), ids(spark, 0), F.col("cost"), RING_OUT, 15).select("node", "dist")


@query(f"WITH RECURSIVE {RING}{DIRECTED}, {ALL_COSTS} SELECT node AS id, dist::DOUBLE AS weight FROM best")
def best_first_nodes(spark, d):
    t = Traversal(RING_OUT).best_first(F.col("cost"))
    return t.traverse(tables.ring(spark, d), ids(spark, 0)).select(F.col("node").alias("id"), "weight")


CHEAP = """
  p AS (SELECT 0::BIGINT AS node, 0::BIGINT AS w, [0::BIGINT] AS nodes, []::BIGINT[] AS rels
        UNION ALL SELECT "to", w + cost, list_append(nodes, "to"), list_append(rels, eid) FROM p JOIN adj ON frm = node
        JOIN best ON best.node = "to" AND best.dist = w + cost)"""


@query(f"WITH RECURSIVE {RING}{DIRECTED}, {ALL_COSTS}, {CHEAP} SELECT {PATH_COLS}, w::DOUBLE AS weight FROM p WHERE node = 31")
def cheapest_paths(spark, d):
    got = paths.cheapest_paths(tables.ring(spark, d), 0, 31, F.col("cost"), RING_OUT)
    return got.select("length", text("nodes").alias("nodes"), text("rels").alias("rels"), "weight")


@query(f"WITH RECURSIVE {RING}{DIRECTED}, {ALL_COSTS}, {CHEAP} SELECT {PATH_COLS}, w::DOUBLE AS weight FROM p WHERE node = 31 ORDER BY len(p.rels), p.rels LIMIT 1")
def a_star(spark, d):
    """Every relationship costs 1 at least, so that this much is left at any node but the end."""
    got = paths.a_star(tables.ring(spark, d), 0, 31, F.col("cost"), RING_OUT, F.when(F.col("id") == 31, 0.0).otherwise(1.0))
    return got.select("length", text("nodes").alias("nodes"), text("rels").alias("rels"), "weight")


@query("""WITH RECURSIVE n AS (SELECT n_nationkey AS k, radians(n_nationkey * 3.0) AS la, radians(n_nationkey * 7.0) AS lo FROM nation),
  e AS (SELECT a.k AS a, b.k AS b, 6371.0 * sqrt(pow(cos(a.la) * cos(a.lo) - cos(b.la) * cos(b.lo), 2) + pow(cos(a.la) * sin(a.lo) - cos(b.la) * sin(b.lo), 2) + pow(sin(a.la) - sin(b.la), 2)) AS c FROM n a JOIN n b ON b.k - a.k IN (1, 3)),
  p AS (SELECT 0 AS k, 0.0::DOUBLE AS w, [0] AS nodes UNION ALL SELECT b, w + c, list_append(nodes, b::INTEGER) FROM p JOIN e ON a = p.k)
  SELECT round(w, 5) AS weight, array_to_string(nodes, '-') AS nodes FROM p WHERE k = 23 ORDER BY p.w LIMIT 1""")
def a_star_geo(spark, d):
    """Costs are distances in km, and so is the estimate of what is left."""
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit("nation").alias("label"), (F.col("n_nationkey") * 3.0).alias("lat"), (F.col("n_nationkey") * 7.0).alias("lon"))
    far = n.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    e = n.join(far, (F.col("dst") - F.col("id")).isin(1, 3)).select((F.col("id") * 100 + F.col("dst")).alias("eid"), F.col("id").alias("src"), "dst", F.lit("LEG").alias("type"), P.chord_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km"))
    g = PropertyGraph(n, e)
    return paths.a_star(g, 0, 23, F.col("km"), RING_OUT, paths.geo_estimate(g, 23) - 1e-6).select(F.round("weight", 5).alias("weight"), text("nodes").alias("nodes"))


@query(f"WITH RECURSIVE {RING}{DIRECTED}, {ALL_COSTS}, {CHEAP} SELECT DISTINCT unnest(nodes) AS node, w::DOUBLE AS weight FROM p WHERE node = 31")
def cheapest_between(spark, d):
    return paths.cheapest_between(tables.ring(spark, d), 0, 31, F.col("cost"), RING_OUT)


@query(f"WITH RECURSIVE {RING}{DIRECTED}, {REACH.format(k=8)}, low AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id) SELECT b.id AS node, a.id AS pred, eid FROM low a JOIN adj ON frm = a.id JOIN low b ON b.id = \"to\" AND b.depth = a.depth + 1")
def predecessors(spark, d):
    g = tables.ring(spark, d)
    return paths.predecessors(g, paths.hop_distances(g, ids(spark, 0), RING_OUT, 8), RING_OUT).select("node", "pred", "eid")


SIGMA = """
  d0 AS (SELECT frm AS s, "to" AS v, 1 AS k FROM both_ways UNION SELECT s, "to", k + 1 FROM d0 JOIN both_ways ON frm = v WHERE k < 25),
  dist AS (SELECT s, v, min(k) AS d FROM d0 WHERE s <> v GROUP BY s, v UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation),
  walk AS (SELECT n_nationkey::BIGINT AS s, n_nationkey::BIGINT AS v, 0 AS k FROM nation
           UNION ALL SELECT w.s, b."to", w.k + 1 FROM walk w JOIN both_ways b ON b.frm = w.v JOIN dist x ON x.s = w.s AND x.v = b."to" AND x.d = w.k + 1),
  sigma AS (SELECT s, v, k AS d, count(*) AS paths FROM walk GROUP BY s, v, k)"""


@query(f"WITH RECURSIVE {TRADE}, {SIGMA} SELECT s AS source, v AS node, d AS dist, paths FROM sigma")
def path_counts(spark, d):
    g = tables.trade(spark, d)
    return paths.path_counts(g, paths.hop_distances(g, g.nodes.select("id"), Expander()), Expander())


@query(f"""WITH RECURSIVE {TRADE},
  c AS (SELECT n_nationkey::BIGINT AS i, n_nationkey::BIGINT AS j, 0::BIGINT AS w FROM nation UNION SELECT i, dst, w + rank FROM c JOIN trade ON src = j WHERE w < 60),
  b AS (SELECT i, j, min(w) AS w FROM c GROUP BY i, j)
  SELECT b.i, b.j, b.w::DOUBLE AS dist, min(a.j) AS pred FROM b LEFT JOIN (b a JOIN trade t ON t.src = a.j) ON a.i = b.i AND t.dst = b.j AND a.w + t.rank = b.w AND b.i <> b.j GROUP BY b.i, b.j, b.w""")
def all_pairs_costs(spark, d):
    return paths.all_pairs(tables.trade(spark, d), F.col("rank"), RING_OUT)


# Centrality over the trade graph.
THROUGH = """
  through AS (
    SELECT b.v AS id, a.s, a.v AS t, (x.paths * b.paths)::DOUBLE / a.paths AS share, (x.paths * b.paths)::DOUBLE AS number
    FROM sigma a JOIN sigma x ON x.s = a.s AND x.v <> a.s AND x.v <> a.v JOIN sigma b ON b.s = a.v AND b.v = x.v WHERE a.s <> a.v AND x.d + b.d = a.d)"""


@query(f"WITH RECURSIVE {TRADE}, {SIGMA}, {THROUGH} SELECT n_nationkey::BIGINT AS id, round(coalesce(sum(share) / 2, 0), 6) AS betweenness FROM nation LEFT JOIN through ON id = n_nationkey GROUP BY n_nationkey")
def betweenness(spark, d):
    return centrality.ShortestPaths(tables.trade(spark, d)).betweenness().select("id", F.round("betweenness", 6).alias("betweenness"))


@query(f"WITH RECURSIVE {TRADE}, {SIGMA}, {THROUGH} SELECT n_nationkey::BIGINT AS id, round(coalesce(sum(number) / 2, 0), 6) AS stress FROM nation LEFT JOIN through ON id = n_nationkey GROUP BY n_nationkey")
def stress(spark, d):
    return centrality.ShortestPaths(tables.trade(spark, d)).stress().select("id", F.round("stress", 6).alias("stress"))


@query(f"WITH RECURSIVE {TRADE}, {SIGMA} SELECT s AS id, round(CASE WHEN sum(d) > 0 THEN 1.0::DOUBLE / sum(d) ELSE 0 END, 9) AS closeness FROM dist GROUP BY s")
def closeness(spark, d):
    g = tables.trade(spark, d)
    got = centrality.closeness(g, paths.hop_distances(g, g.nodes.select("id"), Expander()))
    return got.select("id", F.round("closeness", 9).alias("closeness"))


@query(f"WITH RECURSIVE {TRADE}, {SIGMA} SELECT s AS id, max(d) AS eccentricity FROM dist GROUP BY s")
def eccentricity(spark, d):
    g = tables.trade(spark, d)
    return centrality.eccentricity(g, paths.hop_distances(g, g.nodes.select("id"), Expander()))


@query(f"WITH RECURSIVE {TRADE}, {SIGMA}, e AS (SELECT s, max(d) AS e FROM dist GROUP BY s) SELECT max(e) AS diameter, min(e) AS radius FROM e")
def diameter_and_radius(spark, d):
    g = tables.trade(spark, d)
    got = centrality.eccentricity(g, paths.hop_distances(g, g.nodes.select("id"), Expander()))
    return got.agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"))


def _power_sql(rounds: int) -> str:
    steps = ["v0 AS (SELECT n_nationkey::BIGINT AS id, 1.0::DOUBLE AS x FROM nation)"]
    for k in range(1, rounds + 1):
        steps.append(f'u{k} AS (SELECT v.id, coalesce(sum(r.rank * w.x), 0) AS y FROM v{k - 1} v LEFT JOIN both_ways r ON r.frm = v.id LEFT JOIN v{k - 1} w ON w.id = r."to" GROUP BY v.id)')
        steps.append(f"v{k} AS (SELECT id, y / (SELECT sqrt(sum(y * y)) FROM u{k}) AS x FROM u{k})")
    return f"WITH {TRADE}, {', '.join(steps)} SELECT id, round(x, 6) AS eigenvector FROM v{rounds}"


@query(_power_sql(8))
def eigenvector(spark, d):
    got = centrality.eigenvector(tables.trade(spark, d), F.col("rank"), fixed=8)
    return got.select("id", F.round("eigenvector", 6).alias("eigenvector"))


@query("SELECT n_nationkey::BIGINT AS id, true AS fits FROM nation")
def eigenvector_arnoldi(spark, d):
    """The matrix times the vector is a multiple of it: the residual of every node, against the dominant value."""
    g = tables.trade(spark, d)
    x = centrality.eigenvector_arnoldi(g, F.col("rank"), precision=1e-6)
    adj = PropertyGraph(g.nodes, g.edges.withColumn("w", F.col("rank").cast("double"))).adjacency(keep=["w"])
    y = adj.join(x.select(F.col("id").alias("to"), F.col("eigenvector").alias("x")), "to").groupBy("frm").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    both = x.join(y, F.col("id") == F.col("frm"))
    top = both.agg(F.sum(F.col("y") * F.col("eigenvector"))).first()[0]
    return both.select("id", (F.abs(F.col("y") - F.lit(top) * F.col("eigenvector")) < 1e-4 * top).alias("fits"))


# Patterns.
@query(f"WITH {TRADE} SELECT a.src AS a, b.src AS b, c.src AS c FROM trade a JOIN trade b ON b.src = a.dst JOIN trade c ON c.src = b.dst AND c.dst = a.src")
def pattern_triangle(spark, d):
    p = Pattern((PatternNode("a"), PatternNode("b"), PatternNode("c")), (PatternRel("a", "b", "TRADES"), PatternRel("b", "c", "TRADES"), PatternRel("c", "a", "TRADES")))
    return pattern.match(tables.trade(spark, d), p).select("a", "b", "c")


@query("SELECT DISTINCT 5000000000000 + x.l_partkey AS part FROM lineitem x WHERE x.l_suppkey = 1 INTERSECT SELECT 5000000000000 + l_partkey FROM lineitem WHERE l_suppkey = 2")
def pattern_common_neighbour(spark, d):
    p = Pattern((PatternNode("x", 4 * tables.STEP + 1), PatternNode("y", 4 * tables.STEP + 2), PatternNode("part", label="part")), (PatternRel("x", "part", "SUPPLIES"), PatternRel("y", "part", "SUPPLIES")))
    return pattern.match(tables.commerce(spark, d), p).select("part")


@query("SELECT 3000000000000 + c_custkey AS customer, 4000000000000 + s_suppkey AS supplier, 2000000000000 + c_nationkey AS nation FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_acctbal > 9000 AND s_acctbal < 1000")
def pattern_same_place(spark, d):
    p = Pattern(
        (PatternNode("customer", label="customer", where=(lambda n: n["acctbal"] > 9000,)), PatternNode("supplier", label="supplier", where=(lambda n: n["acctbal"] < 1000,)), PatternNode("nation", label="nation")),
        (PatternRel("customer", "nation", "LOCATED_IN"), PatternRel("supplier", "nation", "LOCATED_IN", BOTH)),
    )
    return pattern.match(tables.geography(spark, d), p).select("customer", "supplier", "nation")


@query("SELECT 2000000000000 + n_nationkey AS nation, 3000000000000 + c_custkey AS customer FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500")
def pattern_optional(spark, d):
    rich = Pattern((PatternNode("nation"), PatternNode("customer", label="customer", where=(lambda n: n["acctbal"] > 9500,))), (PatternRel("customer", "nation", "LOCATED_IN"),))
    p = Pattern((PatternNode("nation", label="nation"), PatternNode("region", label="region")), (PatternRel("nation", "region", "IN_REGION"),), (rich,))
    return pattern.match(tables.geography(spark, d), p).select("nation", "customer")


_FILTERED = "SELECT 3000000000000 + o_custkey AS customer, 5000000000000 + l_partkey AS part, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45 AND "


def _orders_pattern(**more):
    return Pattern(
        (PatternNode("customer", label="customer"), PatternNode("order"), PatternNode("part")),
        (PatternRel("customer", "order", "PLACED", name="placed"), PatternRel("order", "part", "CONTAINS", where=(lambda e: e["qty"] >= 45,), name="line")),
        keep={"placed": ("price",), "line": ("qty", "price")}, **more,
    )


@query(_FILTERED + "l_extendedprice * 2 > o_totalprice")
def pattern_filters(spark, d):
    """A condition between two relationships of a match."""
    p = _orders_pattern(filters=(F.col("line_price") * 2 > F.col("placed_price"),))
    return pattern.match(tables.commerce(spark, d), p).select("customer", "part", F.col("line_qty").alias("qty"))


@query(_FILTERED + "((l_extendedprice * 2 > o_totalprice AND l_quantity >= 48) OR (o_totalprice < 100000 AND l_quantity < 47))")
def pattern_filter_groups(spark, d):
    p = _orders_pattern(any_group=True).group("large share", F.col("line_price") * 2 > F.col("placed_price"), F.col("line_qty") >= 48)
    p = p.group("small order", F.col("placed_price") < 100000).group("small order", F.col("line_qty") < 47)
    return pattern.match(tables.commerce(spark, d), p).select("customer", "part", F.col("line_qty").alias("qty"))


@query("SELECT n_nationkey::BIGINT AS a, b.n % 7 AS b FROM nation JOIN (SELECT unnest(range(0, 25)) AS n) b ON b.n = n_nationkey WHERE n_nationkey % 7 = n_nationkey")
def pattern_self(spark, d):
    """A relationship from a node to itself, and its end."""
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit("nation").alias("label"))
    g = PropertyGraph(n, n.select(F.col("id").alias("eid"), F.col("id").alias("src"), (F.col("id") % 7).alias("dst"), F.lit("REST").alias("type")))
    return pattern.match(g, Pattern((PatternNode("a"),), (PatternRel("a", "a", "REST"),))).select("a", F.col("a").alias("b"))


@query("SELECT 3000000000000 + c_custkey AS id FROM customer WHERE (c_acctbal > 9000 AND c_mktsegment = 'BUILDING') OR (c_acctbal < 0 AND c_nationkey < 10)")
def filter_groups(spark, d):
    c = tables.table(spark, d, "customer")
    groups = {"rich": [F.col("c_acctbal") > 9000, P.exact(F.col("c_mktsegment"), "BUILDING")], "poor": [F.col("c_acctbal") < 0, F.col("c_nationkey") < 10]}
    return c.where(P.filter_groups(groups, any_group=True)).select((F.lit(3 * tables.STEP) + F.col("c_custkey")).alias("id"))


# Index look-ups.
@query("SELECT 3000000000000 + c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_exact(spark, d):
    return index.get(index.build(tables.geography(spark, d).nodes, ["name", "segment"]), "segment", "BUILDING")


@query("SELECT 2000000000000 + n_nationkey AS node FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def index_single(spark, d):
    first = tables.table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return index.get_single(index.build(tables.geography(spark, d).nodes, ["name", "segment"]), "name", first)


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING')")
def index_remove(spark, d):
    i = index.build(tables.geography(spark, d).nodes, ["segment"])
    return index.values(index.remove(i, spark.createDataFrame([("segment", "BUILDING")], "key string, value string")), "segment")


TOKENS = "(SELECT doc_id AS node, list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '') AS t FROM documents)"


def _docs(spark, d):
    return tables.table(spark, d, "documents").select(F.lit("text").alias("key"), F.col("text").alias("value"), F.col("doc_id").alias("node"))


@query(f"SELECT node FROM {TOKENS} WHERE list_has_all(t, ['the', 'of', 'and'])")
def fulltext_and(spark, d):
    return index.fulltext(_docs(spark, d), "text", "the Of and")


for _name, _query, _sql in (
    ("fulltext_query_or", "idiot scum", "list_has_any(t, ['idiot', 'scum'])"),
    ("fulltext_query_must", "+the -of in", "list_contains(t, 'the') AND NOT list_contains(t, 'of')"),
    ("fulltext_query_prefix", "wort*", "len(list_filter(t, lambda x: starts_with(x, 'wort'))) > 0"),
    ("fulltext_query_fuzzy", "stupit~", "len(list_filter(t, lambda x: 1 - levenshtein(x, 'stupit') / least(length(x), 6) > 0.5)) > 0"),
    ("fulltext_query_range", "[idio TO idiots]", "len(list_filter(t, lambda x: x >= 'idio' AND x <= 'idiots')) > 0"),
    ("fulltext_query_precedence", "idiot AND the OR scum", "list_contains(t, 'idiot') AND list_contains(t, 'the')"),
    ("fulltext_query_groups", "(idiot OR scum) AND NOT the", "list_has_any(t, ['idiot', 'scum']) AND NOT list_contains(t, 'the')"),
):
    QUERIES[_name] = lambda spark, d, q=_query: index.query(_docs(spark, d), "text", q)
    ORACLE_SQL[_name] = f"SELECT node FROM {TOKENS} WHERE {_sql}"


@query(f"""WITH w AS (SELECT node, unnest(t) AS w FROM {TOKENS}), tf AS (SELECT node, w, count(*) AS tf FROM w WHERE w IN ('idiot', 'scum') GROUP BY 1, 2),
           df AS (SELECT w, count(*) AS df FROM tf GROUP BY w) SELECT node, round(sum(tf * ln(1 + (SELECT count(*) FROM documents) / df)), 6) AS score FROM tf JOIN df USING (w) GROUP BY node""")
def fulltext_relevance(spark, d):
    return index.relevance(_docs(spark, d), "text", "idiot scum").select("node", F.round("score", 6).alias("score"))


def _events(spark, d):
    return tables.table(spark, d, "events").select(F.col("event_id").alias("node"), "ts")


@query("SELECT event_id AS node FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-07 12:00:00'")
def timeline_between(spark, d):
    import datetime

    return index.between(_events(spark, d), datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 7, 12)).select("node")


@query("SELECT event_id AS node FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00'")
def timeline_after(spark, d):
    import datetime

    return index.between(_events(spark, d), after=datetime.datetime(2024, 1, 29)).select("node")


@query("SELECT (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1) AS first_node, (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 1) AS last_node")
def timeline_ends(spark, d):
    return index.ends(_events(spark, d))


@query("SELECT ts FROM events WHERE event_id = 17")
def timeline_timestamp(spark, d):
    return index.timestamp_of(_events(spark, d), 17)


@query("SELECT event_id AS node, ts FROM events")
def timeline_streamed(spark, d):
    return timeline.timeline_of(spark, d)


# Statements.
def _statements(spark, d):
    return tables.quads(spark, d)


@query(f"WITH {QUADS} SELECT s, p FROM quads WHERE ctx = 'nation:3' AND p = 'located_in'")
def statements_by_pattern(spark, d):
    return rdf.find(_statements(spark, d), rdf.ANY, "located_in", rdf.ANY, "nation:3").select("s", "p")


@query(f"WITH {QUADS} SELECT s FROM quads WHERE o = 'Supplier'")
def statements_inferred(spark, d):
    up = spark.createDataFrame([("Supplier", "Company"), ("Company", "Thing")], "sub string, super string")
    return rdf.find(_statements(spark, d), rdf.ANY, rdf.TYPE, "Thing", subclass_of=up).select("s")


@query(f"WITH {QUADS} SELECT ctx, count(*) AS size FROM quads GROUP BY ctx")
def statements_by_context(spark, d):
    return _statements(spark, d).groupBy("ctx").agg(F.count("*").alias("size"))


@query(f"WITH {QUADS} SELECT count(*) AS size FROM quads WHERE ctx IN ('nation:3', 'nation:4')")
def statements_size(spark, d):
    return rdf.size(_statements(spark, d), "nation:3", "nation:4")


@query(f"WITH {QUADS} SELECT s, p, ctx FROM quads UNION ALL SELECT 'x', 'y', 'c'")
def statements_add(spark, d):
    """A new statement twice, and all places again."""
    q = _statements(spark, d)
    new = spark.createDataFrame([("x", "y", "z", "uri", "c"), ("x", "y", "z", "uri", "c")], "s string, p string, o string, o_kind string, ctx string")
    return rdf.add(q, new.unionByName(q.where("p = 'located_in'"), allowMissingColumns=True)).select("s", "p", "ctx")


@query(f"WITH {QUADS} SELECT s, p, ctx FROM quads WHERE p <> 'name'")
def statements_remove(spark, d):
    return rdf.remove(_statements(spark, d), rdf.ANY, "name", rdf.ANY).select("s", "p", "ctx")


@query(f"WITH {QUADS} SELECT s, p, CASE ctx WHEN 'nation:3' THEN 'nation:4' ELSE ctx END AS ctx FROM quads")
def statements_rename_context(spark, d):
    return rdf.rename_context(_statements(spark, d), "nation:3", "nation:4").select("s", "p", "ctx")


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), f AS (SELECT min(lower(s_name)) AS t FROM supplier)
  SELECT 'supplier:' || s_suppkey AS s, s_name AS o, round(ln(1 + n / 1.0), 6) AS score, s_name AS snippet FROM supplier, n, f WHERE lower(s_name) = t""")
def statements_search(spark, d):
    q = _statements(spark, d).where("p = 'name'")
    first = tables.table(spark, d, "supplier").agg(F.min(F.lower("s_name"))).first()[0]
    return rdf.search(q, first, snippets=100).select("s", "o", F.round("score", 6).alias("score"), "snippet")


@query(f"WITH {QUADS} SELECT a.s AS x, b.o AS name FROM quads a JOIN quads b ON a.s = b.s AND b.p = 'name' WHERE a.p = 'located_in' AND a.o = 'nation:3'")
def select_query(spark, d):
    return rdf.evaluate(_statements(spark, d), 'SELECT ?x ?name WHERE { ?x <located_in> <nation:3> . ?x <name> ?name }')


@query("SELECT 'supplier:' || s_suppkey AS x, CASE WHEN s_acctbal >= 5000 THEN 'yes' ELSE '' END AS rich FROM supplier")
def select_optional(spark, d):
    got = rdf.evaluate(_statements(spark, d), "SELECT ?x ?b { ?x a <Supplier> OPTIONAL { ?x <balance> ?b } }")
    return got.select("x", F.when(F.col("b") != "", "yes").otherwise("").alias("rich"))


@query("SELECT 'supplier:' || s_suppkey AS x FROM supplier WHERE regexp_matches(s_name, '7$') OR s_name < 'Supplier#000000010'")
def select_filter(spark, d):
    return rdf.evaluate(_statements(spark, d), 'SELECT ?x WHERE { ?x <name> ?n FILTER ( regex(?n, "7$") || ?n < "Supplier#000000010" ) }')


@query("SELECT 'nation:' || s_nationkey AS s, 'hosts' AS p, 'supplier:' || s_suppkey AS o FROM supplier")
def construct_query(spark, d):
    return rdf.evaluate(_statements(spark, d), "CONSTRUCT { ?n <hosts> ?x } WHERE { ?x <located_in> ?n }")


# Model.
@query(f"WITH RECURSIVE {MODEL} SELECT sub, super, min(depth) AS depth FROM up GROUP BY sub, super")
def class_closure(spark, d):
    return metamodel.closure(tables.hierarchy(spark, d)[0])


@query(f"""WITH RECURSIVE {MODEL}, i AS (
  SELECT 'Supplier' AS class, 's' || s_suppkey AS instance FROM supplier UNION ALL SELECT 'Nation', 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'Region', 'r' || r_regionkey FROM region UNION ALL SELECT 'Customer ' || c_mktsegment, 'c' || c_custkey FROM customer)
  SELECT class, instance FROM i UNION SELECT super, instance FROM i JOIN up ON sub = class""")
def all_instances(spark, d):
    return metamodel.all_instances(*tables.hierarchy(spark, d))


@query("SELECT class, 'size' AS property, CASE WHEN class = 'Company' OR class = 'Supplier' OR starts_with(class, 'Customer') THEN 'int' ELSE 'double' END AS value FROM (SELECT unnest(['Thing', 'Company', 'Place', 'Supplier', 'Customer', 'Nation', 'Region']) AS class UNION ALL SELECT DISTINCT 'Customer ' || c_mktsegment FROM customer)")
def range_lookup(spark, d):
    own = spark.createDataFrame([("Company", "size", "int")], "class string, property string, range string")
    props = spark.createDataFrame([("measure", "double")], "property string, range string")
    return metamodel.lookup(tables.hierarchy(spark, d)[0], own, props, spark.createDataFrame([("size", "measure")], "sub string, super string"), "range").where("property = 'size'")


# Collections and changes.
@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def bag_union(spark, d):
    return collections.bag_union(tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), tables.table(spark, d, "region").select(F.col("r_regionkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def retain_all(spark, d):
    return collections.retain_all(tables.table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), tables.table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def latest_entries(spark, d):
    return collections.latest(tables.table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], 3).select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def third_page(spark, d):
    return collections.page(tables.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 20, 2)


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 10")
def queue_head(spark, d):
    return collections.queue_head(tables.table(spark, d, "events"), ["ts", "event_id"], 10).select("event_id")


@query(f"WITH {GEO} SELECT label, count(*) AS n FROM geo_nodes WHERE id NOT IN (SELECT 1000000000000 UNION ALL SELECT src FROM geo WHERE dst = 1000000000000 UNION ALL SELECT c.src FROM geo c JOIN geo n ON c.dst = n.src WHERE n.dst = 1000000000000) GROUP BY label")
def delete_reachable(spark, d):
    g = collections.delete_reachable(tables.geography(spark, d), ids(spark, tables.STEP), Expander(direction=IN))
    return g.nodes.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT 3000000000000 + c_custkey AS id, 'assigned' AS kind, 'segment' AS property, 'BUILDING' AS old, 'HOUSES' AS new FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 2000000000000, 'deleted', '', '', NULL UNION ALL SELECT 2000000000000, 'removed', 'name', n_name, NULL FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 2000000000000, 'removed', 'label', 'nation', NULL UNION ALL SELECT 1, 'created', '', NULL, '' UNION ALL SELECT 1, 'assigned', 'label', NULL, 'new'")
def snapshot_changes(spark, d):
    old = tables.geography(spark, d)
    new = old.set_property("segment", F.lit("HOUSES"), F.col("segment") == "BUILDING").delete_nodes(ids(spark, 2 * tables.STEP)).create_nodes(spark.createDataFrame([(1, "new")], "id long, label string"))
    return collections.changes(old.nodes, new.nodes, "id")


# Generators.
@query("SELECT (i - 1) // 2 AS src, i AS dst FROM (SELECT unnest(range(1, 1000)) AS i)")
def generate_tree(spark, d):
    return generators.tree(spark, 1000).edges.select("src", "dst")


@query("SELECT i AS src, (i + k) % 500 AS dst FROM (SELECT unnest(range(0, 500)) AS i), (SELECT unnest([1, 2, 3]) AS k)")
def generate_small_world(spark, d):
    """Without an end drawn anew it is a ring."""
    return generators.small_world(spark, 500, 3, 0.0).edges.select("src", "dst")


@query("SELECT i AS src, 3 AS n, true AS earlier FROM (SELECT unnest(range(1, 201)) AS i)")
def generate_preferential(spark, d):
    """Every node but the first links to three earlier ones."""
    e = generators.preferential_attachment(spark, 201, 3).edges
    return e.groupBy("src").agg(F.count("*").cast("int").alias("n"), F.min((F.col("dst") >= 0) & (F.col("dst") < F.col("src"))).alias("earlier"))


@query("SELECT i AS src, i // 20 + 1 AS layer, 4 AS n FROM (SELECT unnest(range(0, 100)) AS i)")
def generate_layered(spark, d):
    e = generators.layered(spark, 6, 20, 4).edges
    return e.groupBy("src", F.floor(F.col("dst") / 20).alias("layer")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT i AS eid, true AS inside FROM (SELECT unnest(range(0, 5000)) AS i)")
def generate_random(spark, d):
    return generators.random_graph(spark, 300, 5000, 1).edges.select("eid", (F.col("src").between(0, 299) & F.col("dst").between(0, 299)).alias("inside"))


@query(f"WITH {GEO} SELECT type, count(*) AS n FROM geo WHERE src <> 2000000000003 AND dst <> 2000000000003 GROUP BY type UNION ALL SELECT 'NEAR', 1")
def change_relationships(spark, d):
    g = tables.geography(spark, d).delete_nodes(ids(spark, 2 * tables.STEP + 3))
    g = g.create_relationships(spark.createDataFrame([(1, 2 * tables.STEP, 2 * tables.STEP + 1, "NEAR")], "eid long, src long, dst long, type string"))
    return g.delete_relationships(spark.createDataFrame([(-1,)], "eid long")).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {GEO} SELECT label, count(segment) AS n FROM (SELECT label, CASE WHEN segment <> 'BUILDING' THEN segment END AS segment FROM geo_nodes) GROUP BY label")
def remove_property(spark, d):
    g = tables.geography(spark, d).remove_property("segment", F.coalesce(F.col("segment") == "BUILDING", F.lit(False)))
    return g.nodes.groupBy("label").agg(F.count("segment").alias("n"))


@query(f"WITH {GEO} SELECT type, count(*) AS n FROM geo GROUP BY type")
def bulk_load(spark, d):
    """Writes the graph by kind and reads it back."""
    from .plans.steps import new_path

    path = new_path(spark, "graph")
    tables.write_graph(tables.geography(spark, d), path)
    return tables.read_graph(spark, path).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {RING}, {REACH.format(k=3)}, low AS (SELECT id, min(depth) AS depth FROM reach WHERE depth < 3 GROUP BY id) SELECT DISTINCT eid FROM low JOIN ring ON src = id WHERE type = 'HOP'")
def last_type_filter(spark, d):
    t = Traversal(RING_OUT, traversal.RELATIONSHIP_GLOBAL, max_depth=3).filter(F.col("last_type").isin("HOP"))
    return traversal.relationships(t.traverse(tables.ring(spark, d), ids(spark, 0))).select("eid")


@query(f"WITH {GEO} SELECT eid AS node FROM geo WHERE type = 'IN_REGION'")
def index_of_relationships(spark, d):
    return index.get(index.build(tables.geography(spark, d).edges, ["type"], "eid"), "type", "IN_REGION")


@query(f"WITH {QUADS} SELECT DISTINCT ctx FROM quads")
def statement_contexts(spark, d):
    return rdf.contexts(_statements(spark, d))


@query(f"WITH {QUADS} SELECT s FROM quads WHERE p = 'name'")
def statement_metadata(spark, d):
    q = _statements(spark, d).withColumn("meta", F.create_map().cast("map<string,string>"))
    return rdf.with_metadata(q, "source", F.lit("import"), F.col("p") == "name").where("meta['source'] = 'import'").select("s")


@query(f"WITH {QUADS} SELECT s AS src, p AS type, o AS dst FROM quads WHERE kind <> 'literal'")
def statements_as_graph(spark, d):
    g = rdf.as_graph(_statements(spark, d))
    name = lambda c: g.nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return g.edges.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_name").alias("src"), "type", F.col("dst_name").alias("dst"))


@query("SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS words FROM documents")
def array_as_set(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return docs.select("doc_id", F.size(P.as_set(F.col("w"), True)).cast("long").alias("words"))


@query("SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT * (o_orderkey % 7))::DOUBLE AS value FROM orders GROUP BY o_custkey")
def sparse_matrix_times_vector(spark, d):
    """In whole cents, whose sums are exact."""
    o = tables.table(spark, d, "orders")
    matrix = o.select(F.col("o_custkey").alias("row"), F.col("o_orderkey").alias("col"), F.round(F.col("o_totalprice") * 100).alias("value"))
    return centrality.mat_vec(matrix, o.select(F.col("o_orderkey").alias("col"), (F.col("o_orderkey") % 7).cast("double").alias("value"))).withColumnRenamed("row", "o_custkey")


from . import model_queries  # noqa: E402, F401
