"""More queries with SQL: sources, indexes, statements, models, collections and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import predicates as P
from .graph import IN, OUT, Expander, PropertyGraph
from .operators import collections, index, metamodel, rdf, traversal
from .operators.pattern import Pattern, PatternNode, PatternRel
from .operators.traversal import Traversal
from .plans.steps import new_path
from .queries import GEO, QUADS, _docs, _statements, ids, query
from .sources import tables
from .streaming import timeline


# Sources and sinks.
@query("SELECT n_nationkey AS src, n_regionkey AS dst, 'IN' AS type FROM nation")
def csv_edges(spark, d):
    path = new_path(spark, "edges")
    tables.table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint)", "cast(n_regionkey as bigint)", "'IN'").write.csv(path)
    return tables.read_edges_csv(spark, path).select("src", "dst", "type")


@query("SELECT 'supplier:' || s_suppkey AS s, s_name AS o, 'en' AS lang FROM supplier")
def ntriples(spark, d):
    path = new_path(spark, "triples")
    s = tables.table(spark, d, "supplier")
    s.select(F.concat(F.lit("<supplier:"), "s_suppkey", F.lit('> <name> "'), "s_name", F.lit('"@en .'))).write.text(path)
    return tables.read_ntriples(spark, path).select("s", "o", "lang")


ONTOLOGY = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<owl:Class rdf:about="Ship"><rdfs:subClassOf rdf:resource="Vehicle"/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="crew"/><owl:minCardinality>2</owl:minCardinality><owl:maxCardinality>40</owl:maxCardinality></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="Vehicle"/><owl:ObjectProperty rdf:about="crew"><rdfs:range rdf:resource="Sailor"/><rdfs:domain rdf:resource="Ship"/><owl:inverseOf rdf:resource="serves"/></owl:ObjectProperty>
<Ship rdf:about="anna"><crew rdf:resource="tom"/></Ship></rdf:RDF>"""


def _ontology(spark):
    path = new_path(spark, "ontology")
    spark.createDataFrame([(ONTOLOGY.replace("\n", " "),)], "value string").coalesce(1).write.text(path)
    return metamodel.from_statements(tables.read_rdf_xml(spark, f"{path}/*.txt"))


@query("SELECT * FROM (VALUES ('sub', 'Ship', 'Vehicle'), ('range', 'crew', 'Sailor'), ('domain', 'Ship', 'crew'), ('inverse', 'crew', 'serves'), ('instance', 'Ship', 'anna'), ('bounds', 'Ship crew', '2 40')) t(kind, a, b)")
def ontology_import(spark, d):
    m = _ontology(spark)
    pick = lambda t, kind, a, b: m[t].select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")).where("not startswith(b, '_:')")
    bounds = m["restrictions"].select(F.lit("bounds"), F.concat_ws(" ", "class", "property"), F.concat_ws(" ", "min", "max"))
    out = pick("subclass_of", "sub", "sub", "super").union(pick("range", "range", "property", "range")).union(pick("domain", "domain", "class", "property"))
    return out.union(pick("inverse_of", "inverse", "property", "inverse")).union(pick("instance_of", "instance", "class", "instance").where("a = 'Ship'")).union(bounds)


@query(f"""WITH {GEO} SELECT 'digraph places {{' AS line UNION ALL SELECT '}}' UNION ALL SELECT '  n' || id || ' [label="' || label || '"];' FROM geo_nodes
           UNION ALL SELECT '  n' || src || ' -> n' || dst || ' [label="' || type || '"];' FROM geo""")
def dot_file(spark, d):
    path = new_path(spark, "dot")
    tables.write_dot(tables.geography(spark, d), path, "places")
    return spark.read.text(path).toDF("line")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_nationkey < 5 THEN 'first' END AS grade, n_regionkey::BIGINT AS other FROM nation")
def bulk_loader(spark, d):
    """Nodes, relationships and a property that is set later."""
    n = tables.table(spark, d, "nation")
    load = tables.Loader(spark).nodes(n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")), "nation")
    load = load.relationships(n.selectExpr("cast(n_nationkey as bigint) as eid", "cast(n_nationkey as bigint) as src", "cast(n_regionkey as bigint) as dst"), "IN")
    load = load.set_properties(n.where("n_nationkey < 5").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit("first").alias("value")), "grade")
    g = load.load(new_path(spark, "loaded"))
    return g.nodes.join(g.edges, g.nodes.id == g.edges.src).select("id", "name", "grade", F.col("dst").alias("other"))


@query("SELECT '(customer:customer)' AS line UNION ALL SELECT '(order = 7)' UNION ALL SELECT '(customer)-[PLACED]->(order)' UNION ALL SELECT 'group large: 1 conditions'")
def pattern_print(spark, d):
    p = Pattern((PatternNode("customer", label="customer"), PatternNode("order", 7)), (PatternRel("customer", "order", "PLACED"),)).group("large", F.col("order") > 0)
    return spark.createDataFrame([(x,) for x in str(p).split("\n")], "line string")


# Properties and literals.
@query(f"WITH {GEO} SELECT id, array_to_string(list_filter([name, segment], lambda x: x IS NOT NULL), '|') AS v FROM geo_nodes")
def property_values(spark, d):
    n = tables.geography(spark, d).nodes.drop("acctbal")
    return n.select("id", F.array_join(P.property_values(n), "|").alias("v"))


@query("SELECT c_custkey FROM customer WHERE c_custkey::VARCHAR >= '5'")
def filter_compare_as_strings(spark, d):
    """A number against a string: both as strings."""
    c = tables.table(spark, d, "customer")
    return c.where(P.compare(c, "c_custkey", ">=", "5")).select("c_custkey")


@query("SELECT p_partkey, length(p_name) AS n FROM part WHERE length(p_name) % 3 = 0")
def filter_own_matcher(spark, d):
    """Any condition of one's own in a pattern node."""
    g = PropertyGraph(tables.table(spark, d, "part").selectExpr("cast(p_partkey as bigint) as id", "'part' as label", "p_name as name"), spark.createDataFrame([], "eid long, src long, dst long, type string"))
    got = pattern_nodes(g, PatternNode("p", where=(lambda n: F.length(n["name"]) % 3 == 0,)), ("name",))
    return got.select(F.col("p").alias("p_partkey"), F.length("p_name").cast("long").alias("n"))


def pattern_nodes(graph, node, keep):
    from .operators import pattern

    return pattern.match(graph, Pattern((node,), (), keep={node.name: keep}))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || 'Z' AS literal, date_trunc('second', ts) + INTERVAL 90 MINUTE AS later FROM events")
def xsd_date_times(spark, d):
    """Time stamps to literals, and literals with another zone back."""
    e = tables.table(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    literal = P.xsd_literal(F.col("ts"), "dateTime")
    west = F.replace(literal, F.lit("Z"), F.lit("-01:30"))
    return e.select("event_id", literal.alias("literal"), P.xsd_value(west, "dateTime").cast("timestamp_ntz").alias("later"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day, year(o_orderdate) AS y, true AS flag, NULL::INTEGER AS bad FROM orders WHERE o_orderkey < 1000")
def xsd_dates(spark, d):
    o = tables.table(spark, d, "orders").where("o_orderkey < 1000").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    day, year = F.concat(F.col("day").cast("string"), F.lit("+02:00")), F.concat(F.date_format("day", "yyyy"), F.lit("Z"))
    return o.select("o_orderkey", P.xsd_value(day, "date").alias("day"), P.xsd_value(year, "gYear").cast("long").alias("y"), P.xsd_value(F.lit("1"), "boolean").alias("flag"), P.xsd_value(F.lit("12:3"), "int").alias("bad"))


# Indexes.
def _names(spark, d):
    return index.build(tables.geography(spark, d).nodes, ["name", "segment"])


@query("SELECT 'segment' AS key, c_mktsegment AS value, 3000000000000 + c_custkey AS node FROM customer")
def index_saved(spark, d):
    path = new_path(spark, "index")
    index.save(_names(spark, d), path)
    return index.load(spark, path).where("key = 'segment'")


@query("SELECT count(*) AS size FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_command(spark, d):
    """Indexes by name, and the shell's line that counts."""
    held = index.Indexes()
    held.put("places", _names(spark, d))
    return held.command("index -c places segment BUILDING")


@query("SELECT n_name AS value, 2000000000000 + n_nationkey AS node FROM nation WHERE n_name >= 'NATION_1' AND n_name < 'NATION_2'")
def index_submap(spark, d):
    return index.submap(index.build(tables.geography(spark, d).nodes.where("label = 'nation'"), ["name"]), "name", "NATION_1", "NATION_2")


@query("SELECT max(n_name) FILTER (n_name <= 'NATION_15x') AS floor, min(n_name) FILTER (n_name >= 'NATION_15x') AS ceiling, max(n_name) FILTER (n_name < 'NATION_15x') AS lower, min(n_name) FILTER (n_name > 'NATION_15x') AS higher FROM nation")
def index_neighbours(spark, d):
    return index.neighbours_of(index.build(tables.geography(spark, d).nodes.where("label = 'nation'"), ["name"]), "name", "NATION_15x")


@query("SELECT DISTINCT ts, event_id AS node FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 25")
def sorted_set_from(spark, d):
    import datetime

    e = tables.table(spark, d, "events").select("ts", F.col("event_id").alias("node"))
    return index.sorted_nodes(e.where(F.col("ts") >= datetime.datetime(2024, 1, 10)), "ts", "node").limit(25)


@query("SELECT c_mktsegment AS value, 3000000000000 + c_custkey AS node FROM customer")
def index_as_graph(spark, d):
    g = index.as_graph(index.build(tables.geography(spark, d).nodes, ["segment"]))
    values = g.nodes.where("label = 'value'").select(F.col("id").alias("src"), F.col("name").alias("value"))
    return g.edges.where("type = 'VALUE'").join(values, "src").select("value", F.col("dst").alias("node"))


@query("""WITH new AS (SELECT * FROM (VALUES ('BUILDING', 1), ('BUILDING', 2), ('OTHER', 3)) t(value, node)), old AS (SELECT c_mktsegment AS value, 3000000000000 + c_custkey AS node FROM customer)
  SELECT value, node::BIGINT AS node FROM old WHERE value NOT IN (SELECT value FROM new) UNION ALL SELECT value, max(node) FROM new GROUP BY value""")
def index_single_replaced(spark, d):
    rows = spark.createDataFrame([("segment", "BUILDING", 1), ("segment", "BUILDING", 2), ("segment", "OTHER", 3)], "key string, value string, node long")
    return index.add(index.build(tables.geography(spark, d).nodes, ["segment"]), rows, single=True).select("value", "node")


_TOKENS = "(SELECT doc_id AS node, list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '') AS t FROM documents)"


@query(f"SELECT node FROM {_TOKENS} WHERE list_has_all(t, ['scum', 'the'])")
def fulltext_default_and(spark, d):
    return index.query(_docs(spark, d), "text", "scum the", default_and=True)


@query(f"SELECT node FROM {_TOKENS} WHERE len(list_filter(t, lambda x: starts_with(x, 'idio'))) > 0")
def fulltext_by_tokens(spark, d):
    return index.by_token(index.token_index(_docs(spark, d)), "text", "idio*")


@query(f"""WITH w AS (SELECT node, unnest(t) AS w FROM {_TOKENS}), tf AS (SELECT node, w, count(*) AS tf FROM w WHERE w IN ('moron', 'trash') GROUP BY 1, 2),
           df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), x AS (SELECT node, sum(tf * ln(1 + (SELECT count(*) FROM documents) / df)) AS score FROM tf JOIN df USING (w) GROUP BY node)
           SELECT node, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, node) AS pos FROM x""")
def fulltext_by_relevance(spark, d):
    got = index.relevance(_docs(spark, d), "text", "moron trash").withColumn("score", F.round("score", 9))
    from pyspark.sql import Window as W

    return got.select("node", F.round("score", 6).alias("score"), F.row_number().over(W.orderBy(F.col("score").desc(), "node")).cast("long").alias("pos"))


@query("SELECT doc_id AS node FROM documents WHERE lang = 'de'")
def fulltext_exact(spark, d):
    """The whole value, beside the tokens."""
    return index.get(tables.table(spark, d, "documents").select(F.lit("lang").alias("key"), F.col("lang").alias("value"), F.col("doc_id").alias("node")), "lang", "de")


# Statements.
@query(f"""WITH {QUADS} SELECT 's' AS shape, count(*) AS n FROM quads WHERE s = 'supplier:1' UNION ALL SELECT 'p', count(*) FROM quads WHERE p = 'name' UNION ALL SELECT 'o', count(*) FROM quads WHERE o = 'nation:3'
           UNION ALL SELECT 'sp', count(*) FROM quads WHERE s = 'supplier:1' AND p = 'name' UNION ALL SELECT 'po', count(*) FROM quads WHERE p = 'located_in' AND o = 'nation:3' UNION ALL SELECT 'all', count(*) FROM quads""")
def statement_shapes(spark, d):
    q, a = _statements(spark, d), rdf.ANY
    shapes = {"s": ("supplier:1", a, a), "p": (a, "name", a), "o": (a, a, "nation:3"), "sp": ("supplier:1", "name", a), "po": (a, "located_in", "nation:3"), "all": (a, a, a)}
    out = None
    for k, x in shapes.items():
        one = rdf.find(q, *x).agg(F.count("*").alias("n")).select(F.lit(k).alias("shape"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {QUADS} SELECT s, p FROM quads WHERE p = 'name' UNION ALL SELECT 'loose', 'note'")
def statements_default_context(spark, d):
    """None stands for the default context, no context for any."""
    q = rdf.add(_statements(spark, d), spark.createDataFrame([("loose", "note", "x", "literal", rdf.DEFAULT)], "s string, p string, o string, o_kind string, ctx string"))
    return rdf.find(q, rdf.ANY, "name", rdf.ANY).union(rdf.find(q, rdf.ANY, rdf.ANY, rdf.ANY, None)).select("s", "p")


@query("SELECT side, s FROM (SELECT 'missing' AS side, 'supplier:' || s_suppkey AS s FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'stale', 'gone') UNION ALL SELECT 'left', 'none' WHERE false")
def literal_index_verified(spark, d):
    q = _statements(spark, d).where("p = 'name'")
    half = rdf.literals(q.where(F.substring("s", 10, 20).cast("int") % 2 == 0))
    gone = rdf.literals(spark.createDataFrame([("gone", "name", "x", "literal", "c")], "s string, p string, o string, o_kind string, ctx string"))
    old = half.union(gone)
    left = rdf.verify(q, rdf.reindex(q, old)).select(F.lit("left").alias("side"), F.lit("none").alias("s"))
    return rdf.verify(q, old).select("side", "node.s").union(left)


@query(f"WITH {QUADS} SELECT s, p, kind = 'literal' AS literal FROM quads")
def statements_as_verbose_graph(spark, d):
    """Every statement as a node, put together again from its relationships."""
    q = _statements(spark, d)
    g = rdf.as_verbose_graph(q)
    name = g.nodes.select(F.col("id").alias("dst"), "name")
    part = lambda kind, c: g.edges.where(F.col("type") == kind).join(name, "dst").select("src", F.col("name").alias(c))
    return part("SUBJECT", "s").join(part("PREDICATE", "p"), "src").join(part("OBJECT", "o"), "src").select("s", "p", F.col("o").startswith('"').alias("literal"))


@query(f"WITH {QUADS} SELECT s, p, CASE p WHEN 'located_in' THEN 'literal' WHEN 'name' THEN 'uri' ELSE kind END AS kind FROM quads")
def statements_typed_by_range(spark, d):
    ranges = spark.createDataFrame([("located_in", "string"), ("name", None)], "property string, datatype string")
    return rdf.typed_by_range(_statements(spark, d), ranges).select("s", "p", F.col("o_kind").alias("kind"))


@query("SELECT * FROM (VALUES ('supplier:', 'firm:')) t(old, new), (SELECT 'rdf:' AS prefix)")
def statement_namespaces(spark, d):
    q = rdf.renamed_namespace(_statements(spark, d), "supplier:", "firm:")
    first = q.select(F.regexp_extract("s", "^(.*:)", 1).alias("new")).distinct()
    return rdf.namespaces(q).join(first, F.lit(True)).select(F.lit("supplier:").alias("old"), "new", "prefix")


@query(f"WITH {QUADS} SELECT s, p FROM quads WHERE o = 'nation:3'")
def triple_source(spark, d):
    return rdf.TripleSource(_statements(spark, d)).get_triples(rdf.ANY, rdf.ANY, "nation:3").select("s", "p")


@query("SELECT 'supplier:' || s_suppkey AS x, CASE WHEN s_acctbal >= 7000 THEN 'yes' ELSE '' END AS rich FROM supplier")
def select_filter_in_optional(spark, d):
    """A filter within an optional part leaves the others."""
    q = _statements(spark, d).withColumn("o", F.when(F.col("p") == "balance", F.col("o").cast("double")).otherwise(None).cast("string")).where("p = 'balance'").union(_statements(spark, d).where("p <> 'balance'"))
    got = rdf.evaluate(q, "SELECT ?x ?b { ?x a <Supplier> OPTIONAL { ?x <balance> ?b FILTER ( ?b >= 7000 ) } }")
    return got.select("x", F.when(F.col("b") != "", "yes").otherwise("").alias("rich"))


# Models.
def _model(spark):
    m = metamodel.Model(spark)
    m = m.create("subclass_of", ("m#Dog", "m#Pet"), ("m#Puppy", "m#Dog"), ("m#Cat", "m#Pet")).create("classes", ("m#Dog",), ("m#Pet",), ("m#Puppy",), ("n/Cat",))
    m = m.create("properties", ("m#owner",), ("m#leg",)).create("domain", ("m#Pet", "m#owner"), ("m#Dog", "m#leg")).create("range", ("m#owner", "m#Person"))
    m = m.create("restrictions", ("m#Dog", "m#leg", None, 3, 4), ("m#Puppy", "m#leg", None, 4, None), ("m#Pet", "m#owner", "m#Keeper", 1, 1))
    return m.create("inverse_of", ("m#owner", "m#owns")).create("instance_of", ("m#Puppy", "rex"), ("m#Cat", "tom"), ("m#Person", "eva")).create("behaviour", ("m#leg", "list", True), ("m#owner", "single", False))


@query("SELECT * FROM (VALUES ('sub', 'm#Dog'), ('sub', 'm#Cat'), ('super', 'm#Dog')) t(kind, class)")
def class_neighbours(spark, d):
    m = _model(spark)
    subs = metamodel.direct_subs(m.subclass_of, "m#Pet").select(F.lit("sub").alias("kind"), F.col("sub").alias("class"))
    return subs.union(metamodel.direct_supers(m.subclass_of, "m#Puppy").select(F.lit("super"), "super"))


@query("SELECT * FROM (VALUES ('m#Pet', 'm#owner'), ('m#Dog', 'm#owner'), ('m#Dog', 'm#leg'), ('m#Puppy', 'm#owner'), ('m#Puppy', 'm#leg'), ('m#Cat', 'm#owner')) t(class, property)")
def class_properties(spark, d):
    return _model(spark).properties_of()


@query("SELECT * FROM (VALUES ('min', 'm#Dog', 'm#leg', 3), ('max', 'm#Dog', 'm#leg', 4), ('min', 'm#Puppy', 'm#leg', 4), ('max', 'm#Puppy', 'm#leg', 4), ('min', 'm#Pet', 'm#owner', 1), ('min', 'm#Dog', 'm#owner', 1), ('min', 'm#Puppy', 'm#owner', 1), ('min', 'm#Cat', 'm#owner', 1), ('max', 'm#Pet', 'm#owner', 1), ('max', 'm#Dog', 'm#owner', 1), ('max', 'm#Puppy', 'm#owner', 1), ('max', 'm#Cat', 'm#owner', 1)) t(what, class, property, value)")
def cardinality_lookup(spark, d):
    m = _model(spark)
    return m.lookup("min").select(F.lit("min").alias("what"), "class", "property", "value").union(m.lookup("max").select(F.lit("max"), "class", "property", "value"))


@query("SELECT * FROM (VALUES ('namespace', 'm#'), ('namespace', 'x/'), ('class', 'x/Cat'), ('restricting', 'm#Dog'), ('restricting', 'm#Puppy'), ('created', 'm#New')) t(kind, name)")
def model_names(spark, d):
    """Namespaces, a renamed one, the classes that restrict a property, and a class that is created when asked for."""
    m = _model(spark).rename("n/", "x/")
    out = m.namespaces().select(F.lit("namespace").alias("kind"), F.col("namespace").alias("name"))
    out = out.union(m.in_namespace("x/").select(F.lit("class"), "class")).union(m.restricting_classes().where("property = 'm#leg'").select(F.lit("restricting"), "class"))
    return out.union(m.find("classes", "m#New", create=True)[1].select(F.lit("created"), "class"))


@query("SELECT * FROM (VALUES ('m#owner', 'm#Person', 'eva')) t(property, range, instance)")
def class_ranges(spark, d):
    return _model(spark).class_ranges()


@query("SELECT * FROM (VALUES ('rex', 'm#owner', 'eva'), ('eva', 'm#owns', 'rex'), ('eva', 'm#owns', 'tom'), ('tom', 'm#owner', 'eva')) t(s, p, o)")
def inverse_statements(spark, d):
    return _model(spark).with_inverses(spark.createDataFrame([("rex", "m#owner", "eva"), ("eva", "m#owns", "tom")], "s string, p string, o string"))


@query("SELECT * FROM (VALUES ('rex', 'm#leg', 'a,a,b'), ('rex', 'm#owner', 'z'), ('rex', 'm#tag', 'u,v')) t(instance, property, v)")
def property_collections(spark, d):
    values = spark.createDataFrame([("rex", "m#leg", "a"), ("rex", "m#leg", "b"), ("rex", "m#leg", "a"), ("rex", "m#owner", "y"), ("rex", "m#owner", "z"), ("rex", "m#tag", "u"), ("rex", "m#tag", "u"), ("rex", "m#tag", "v")], "instance string, property string, value string")
    return _model(spark).collected(values).select("instance", "property", F.array_join("values", ",").alias("v"))


@query("SELECT * FROM (VALUES ('rex', 'm#leg', 3, 4, 4), ('tom', 'm#owner', 2, 1, 1)) t(instance, property, n, min, max)")
def restriction_violations(spark, d):
    values = spark.createDataFrame([("m#Puppy", "rex", "m#leg", x) for x in "abc"] + [("m#Cat", "tom", "m#owner", x) for x in "yz"] + [("m#Puppy", "rex", "m#owner", "y")], "class string, instance string, property string, value string")
    return _model(spark).violations(values).select("instance", "property", F.col("n").cast("int").alias("n"), "min", "max")


@query("SELECT 'm#leg' AS key, 'a' AS value, 'rex' AS node")
def indexed_properties(spark, d):
    values = spark.createDataFrame([("rex", "m#leg", "a"), ("rex", "m#owner", "y")], "instance string, property string, value string")
    return _model(spark).indexed(values)


# Collections, changes and streams.
@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 7")
def stack_top(spark, d):
    return collections.queue_head(tables.table(spark, d, "events"), ["ts", "event_id"], 7, lifo=True).select("event_id")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) > 10")
def queue_rest(spark, d):
    return collections.queue_rest(tables.table(spark, d, "events"), ["ts", "event_id"], 10).select("event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def queue_workers(spark, d):
    """A worker that is handed every batch of a queue once."""
    path = new_path(spark, "worked")

    def work(batch, number):
        batch.select("event_type").write.mode("append").parquet(path)

    timeline.work_off(timeline.stream_table(spark, d, "events"), work, spark).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT i AS id FROM (SELECT unnest(range(5, 500, 3)) AS i)")
def number_range(spark, d):
    return spark.range(5, 500, 3)


@query("SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS INTEGER) AS n FROM part WHERE try_cast(split_part(p_brand, '#', 2) AS INTEGER) > 20")
def map_skipping(spark, d):
    """Rows whose value cannot be computed are left out."""
    p = tables.table(spark, d, "part").select("p_partkey", F.element_at(F.split("p_brand", "#"), 2).alias("b"))
    return collections.map_skipping(p, F.when(F.col("b").try_cast("int") > 20, F.col("b").try_cast("int")), "n").select("p_partkey", "n")


@query("SELECT 2000000000000 + n_nationkey AS id, CASE n_nationkey WHEN 3 THEN 1000000000004 ELSE 1000000000000 + n_regionkey END AS other FROM nation WHERE n_nationkey <> 5")
def typed_links(spark, d):
    """One link of a kind for each node: one replaced, one removed."""
    link = collections.Typed("IN_REGION", single=True)
    g = link.set(tables.geography(spark, d), spark.createDataFrame([(2 * tables.STEP + 3, tables.STEP + 4)], "id long, other long"))
    return link.get(link.remove(g, ids(spark, 2 * tables.STEP + 5)))


@query(f"WITH {GEO} SELECT id, CASE label WHEN 'region' THEN 'continent' ELSE label END AS label FROM geo_nodes WHERE id <> 2000000000007")
def migrated(spark, d):
    """Two steps from version 1 on; the first one is done already."""
    m = collections.Migration(
        lambda g: g.remove_property("name"),
        lambda g: g.set_property("label", F.lit("continent"), F.col("label") == "region"),
        lambda g: g.delete_nodes(ids(spark, 2 * tables.STEP + 7)),
    )
    return m.apply(tables.geography(spark, d), 1)[0].nodes.where("name is not null").select("id", "label")


@query("SELECT 'node' AS element, 2000000000000 + n_nationkey AS id, 'assigned' AS kind, 'name' AS property FROM nation WHERE n_nationkey < 3")
def change_handlers(spark, d):
    seen = []
    old = tables.geography(spark, d)
    collections.handled(old, old.set_property("name", F.lit("x"), F.col("id").between(2 * tables.STEP, 2 * tables.STEP + 2)), seen.append)
    return seen[0].select("element", "id", "kind", "property")


@query(f"WITH {GEO} SELECT n.src AS id, 'go ' || n.src AS command FROM geo n WHERE n.dst = 1000000000001 AND n.type = 'IN_REGION'")
def shell_trav_command(spark, d):
    got = traversal.trav(tables.geography(spark, d), ids(spark, tables.STEP + 1), types={"IN_.*": IN}, command="go $i")
    return got.select(F.col("node").alias("id"), "command")


@query(f"WITH {GEO} SELECT DISTINCT dst AS id FROM geo WHERE type = 'LOCATED_IN'")
def unique_by_own_key(spark, d):
    """A traversal that visits one company of every nation and the nation: unique by nation, however many companies there are."""
    g = tables.geography(spark, d)
    t = Traversal(Expander((("LOCATED_IN", OUT),)), max_depth=1).unique_by(F.col("node"))
    return t.traverse(g, g.nodes.where("label in ('customer', 'supplier')").select("id")).where("depth = 1").select(F.col("node").alias("id")).distinct()
