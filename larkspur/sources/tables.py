"""Graph, text and statement views of relational tables, and readers and writers of edge files, triples and DOT."""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import PropertyGraph

#: Node ids are kind * STEP + key.
STEP = 1_000_000_000_000
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, USER, EVENT = range(1, 9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: int, col: str):
    return F.lit(kind * STEP) + F.col(col).cast("bigint")


def geography(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers and suppliers: IN_REGION and LOCATED_IN."""
    t = lambda n: table(spark, sf_dir, n)
    no = lambda kind: F.lit(None).cast(kind)
    # Table, kind, key, label, name, balance, segment.
    nodes = [
        (t("region"), REGION, "r_regionkey", "region", "r_name", no("double"), no("string")), (t("nation"), NATION, "n_nationkey", "nation", "n_name", no("double"), no("string")),
        (t("customer"), CUSTOMER, "c_custkey", "customer", "c_name", F.col("c_acctbal"), F.col("c_mktsegment")), (t("supplier"), SUPPLIER, "s_suppkey", "supplier", "s_name", F.col("s_acctbal"), no("string")),
    ]
    # Table, type, kind and key of the source, which are those of the relationship, kind and key of the target.
    edges = [
        (t("nation"), "IN_REGION", NATION, "n_nationkey", REGION, "n_regionkey"), (t("customer"), "LOCATED_IN", CUSTOMER, "c_custkey", NATION, "c_nationkey"),
        (t("supplier"), "LOCATED_IN", SUPPLIER, "s_suppkey", NATION, "s_nationkey"),
    ]

    def node_rows(df, kind, key, label, name, bal, segment) -> DataFrame:
        return df.select(_id(kind, key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), bal.alias("acctbal"), segment.alias("segment"))

    def edge_rows(df, kind, src_kind, src, dst_kind, dst) -> DataFrame:
        return df.select(_id(src_kind, src).alias("eid"), _id(src_kind, src).alias("src"), _id(dst_kind, dst).alias("dst"), F.lit(kind).alias("type"))

    def parts(column: str, value: int) -> DataFrame:
        """Only the tables of the id's kind, filtered by its key."""
        kind, key = divmod(value, STEP)
        if column == "id":
            got = [node_rows(n[0].where(F.col(n[2]) == key), *n[1:]) for n in nodes if n[1] == kind]
            return reduce(DataFrame.union, got) if got else node_rows(*nodes[0]).limit(0)
        at = 4 if column == "dst" else 2
        got = [edge_rows(e[0].where(F.col(e[at + 1]) == key), *e[1:]) for e in edges if e[at] == kind]
        return reduce(DataFrame.union, got) if got else edge_rows(*edges[0]).limit(0)

    return PropertyGraph(reduce(DataFrame.union, [node_rows(*n) for n in nodes]), reduce(DataFrame.union, [edge_rows(*e) for e in edges]), REGION * STEP, parts)


def commerce(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Adds orders and parts: PLACED, CONTAINS and SUPPLIES."""
    g = geography(spark, sf_dir)
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem")
    nodes = g.nodes.union(t("part").select(_id(PART, "p_partkey"), F.lit("part"), "p_name", F.lit(None).cast("double"), F.lit(None).cast("string")))
    nodes = nodes.union(t("orders").select(_id(ORDER, "o_orderkey"), F.lit("order"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")))
    none = F.lit(None).cast("double")
    edges = g.edges.select("*", none.alias("qty"), none.alias("price"))
    edges = edges.union(t("orders").select(_id(ORDER, "o_orderkey"), _id(CUSTOMER, "o_custkey"), _id(ORDER, "o_orderkey"), F.lit("PLACED"), none, F.col("o_totalprice")))
    edges = edges.union(line.select(F.xxhash64(*line.columns), _id(ORDER, "l_orderkey"), _id(PART, "l_partkey"), F.lit("CONTAINS"), "l_quantity", "l_extendedprice"))
    pairs = line.select("l_suppkey", "l_partkey").distinct()
    edges = edges.union(pairs.select(-(F.col("l_suppkey") * (1 << 33) + F.col("l_partkey")) - 1, _id(SUPPLIER, "l_suppkey"), _id(PART, "l_partkey"), F.lit("SUPPLIES"), none, none))
    return PropertyGraph(nodes, edges, g.ref_id)


def ring(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A sparse graph over supplier keys: HOP to (7s + 3) mod N at cost 1 + s mod 5, NEXT to (s + 1) mod N at cost 3 + s mod 3."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("s"), F.col("s_name").alias("name"))
    n = s.count()
    hop = s.select((F.col("s") * 2).alias("eid"), F.col("s").alias("src"), ((F.col("s") * 7 + 3) % n).alias("dst"), F.lit("HOP").alias("type"), (1 + F.col("s") % 5).cast("bigint").alias("cost"))
    nxt = s.select(F.col("s") * 2 + 1, "s", (F.col("s") + 1) % n, F.lit("NEXT"), (3 + F.col("s") % 3).cast("bigint"))
    return PropertyGraph(s.select(F.col("s").alias("id"), F.lit("supplier").alias("label"), "name"), hop.union(nxt).where("src <> dst"), 0)


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each supplier nation to the two customer nations, other than itself, with the highest sales; ties to the lowest key."""
    t = lambda n: table(spark, sf_dir, n)
    sales = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    total = sales.groupBy("s_nationkey", "c_nationkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents")).where("s_nationkey <> c_nationkey")
    best = total.withColumn("rank", F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.col("cents").desc(), "c_nationkey"))).where("rank <= 2")
    edges = best.select((F.col("s_nationkey") * 2 + F.col("rank")).cast("bigint").alias("eid"), F.col("s_nationkey").cast("bigint").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"), F.lit("TRADES").alias("type"), "cents", "rank")
    return PropertyGraph(t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit("nation").alias("label"), F.col("n_name").alias("name")), edges, 0)


def sessions(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Events, each linked to the next one of its user by NEXT_EVENT."""
    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(F.col("event_id").alias("eid"), F.col("event_id").alias("src"), nxt.alias("dst"), F.lit("NEXT_EVENT").alias("type")).where("dst is not null")
    return PropertyGraph(e.select(F.col("event_id").alias("id"), F.lit("event").alias("label"), "event_type", "user_id", "ts", "value"), edges)


def dialogue(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns, each linked to the next one of its conversation by REPLY."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("id"), F.lit("turn").alias("label"), "conv_id", "turn", "role")
    edges = c.select(F.col("id").alias("eid"), F.col("id").alias("src"), F.lead("id").over(W.partitionBy("conv_id").orderBy("turn")).alias("dst"), F.lit("REPLY").alias("type"))
    return PropertyGraph(c, edges.where("dst is not null"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about suppliers, in a context for each nation."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("s"), "s_name", F.concat(F.lit("nation:"), "s_nationkey").alias("ctx"), F.col("s_acctbal").cast("string").alias("bal"), F.col("s_acctbal").alias("amount"))
    none = F.lit(None).cast("string")
    parts = [
        s.select("s", F.lit("rdf:type").alias("p"), F.lit("Supplier").alias("o"), F.lit("uri").alias("o_kind"), none.alias("datatype"), none.alias("lang"), "ctx"),
        s.select("s", F.lit("located_in"), F.col("ctx"), F.lit("uri"), none, none, "ctx"),
        s.select("s", F.lit("name"), "s_name", F.lit("literal"), F.lit("string"), none, "ctx"),
        s.where("amount >= 5000").select("s", F.lit("balance"), "bal", F.lit("literal"), F.lit("double"), none, "ctx"),
    ]
    return reduce(DataFrame.union, parts)


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A class hierarchy over places and companies: (sub, super), and (class, instance)."""
    t = lambda n: table(spark, sf_dir, n)
    fixed = spark.createDataFrame([("Company", "Thing"), ("Place", "Thing"), ("Supplier", "Company"), ("Customer", "Company"), ("Nation", "Place"), ("Region", "Place")], "sub string, super string")
    sub = fixed.union(t("customer").select(F.concat(F.lit("Customer "), "c_mktsegment"), F.lit("Customer")).distinct())
    inst = [
        t("supplier").select(F.lit("Supplier").alias("class"), F.concat(F.lit("s"), "s_suppkey").alias("instance")), t("nation").select(F.lit("Nation"), F.concat(F.lit("n"), "n_nationkey")),
        t("region").select(F.lit("Region"), F.concat(F.lit("r"), "r_regionkey")), t("customer").select(F.concat(F.lit("Customer "), "c_mktsegment"), F.concat(F.lit("c"), "c_custkey")),
    ]
    return sub, reduce(DataFrame.union, inst)


def read_edges_csv(spark: SparkSession, path: str, sep: str = ",", types: str = "src bigint, dst bigint, type string") -> DataFrame:
    """Edges of a delimited file; their ids come from a hash of the row."""
    df = spark.read.csv(path, sep=sep, schema=types)
    return df.select(F.xxhash64(*df.columns).alias("eid"), *df.columns)


_TRIPLE = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"(?:\^\^<[^>]*>|@[\w-]+)?)\s*(<[^>]*>)?\s*\.\s*$"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Statements of N-Triples or N-Quads lines; other lines are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(_TRIPLE))
    part = lambda i: F.regexp_extract("value", _TRIPLE, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = part(3).startswith('"')
    return lines.select(
        bare(part(1)).alias("s"), bare(part(2)).alias("p"),
        F.when(literal, F.regexp_replace(F.regexp_extract(part(3), r'^"((?:[^"\\]|\\.)*)"', 1), r'\\"', '"')).otherwise(bare(part(3))).alias("o"),
        F.when(literal, "literal").otherwise("uri").alias("o_kind"), F.nullif(F.regexp_extract(part(3), r"\^\^<([^>]*)>$", 1), F.lit("")).alias("datatype"),
        F.nullif(F.regexp_extract(part(3), r'"@([\w-]+)$', 1), F.lit("")).alias("lang"), F.coalesce(F.nullif(bare(part(4)), F.lit("")), F.lit("default")).alias("ctx"),
    )


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """Statements of RDF/XML ontology files, which are small; one task reads a file."""
    import xml.etree.ElementTree as ET

    names = {"http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:", "http://www.w3.org/2000/01/rdf-schema#": "rdfs:", "http://www.w3.org/2002/07/owl#": "owl:"}

    def short(name: str) -> str:
        m = re.fullmatch(r"\{(.*)\}(.*)", name)
        uri = m[1] + m[2] if m else name
        return next((p + uri.removeprefix(u) for u, p in names.items() if uri.startswith(u)), uri)

    def statements(batches):
        import pandas as pd

        rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"

        def walk(x, out: list, blank: list[int]) -> str:
            """Statements of a node element; its name, or a blank one of the file."""
            s = x.get(rdf + "about") or (("#" + x.get(rdf + "ID")) if x.get(rdf + "ID") else None)
            if s is None:
                blank[0] += 1
                s = f"_:{blank[1]}.{blank[0]}"
            s = short(s)
            if short(x.tag) != "rdf:Description":
                out.append((s, "rdf:type", short(x.tag), "uri", None))
            for y in x:
                ref, inner = y.get(rdf + "resource"), list(y)
                if ref is not None or inner:
                    out.append((s, short(y.tag), short(ref) if ref is not None else walk(inner[0], out, blank), "uri", None))
                else:
                    kind = y.get(rdf + "datatype")
                    out.append((s, short(y.tag), (y.text or "").strip(), "literal", None if kind is None else kind.rpartition("#")[2]))
            return s

        for b in batches:
            out: list[tuple] = []
            for content in b["content"]:
                blank = [0, zlib.crc32(content)]
                for x in ET.fromstring(content):
                    walk(x, out, blank)
            yield pd.DataFrame(out, columns=["s", "p", "o", "o_kind", "datatype"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(statements, "s string, p string, o string, o_kind string, datatype string")


def write_graph(graph: PropertyGraph, path: str) -> None:
    """Nodes by label and relationships by type, so that scans of a kind skip the others."""
    graph.nodes.write.partitionBy("label").parquet(f"{path}/nodes")
    graph.edges.write.partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def write_dot(graph: PropertyGraph, path: str, name: str = "graph_") -> None:
    """A GraphViz digraph as text files: the first one opens it, the last one closes it, in the order of their names."""
    esc = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r'(["\\])', r"\\$1")
    spark = graph.nodes.sparkSession
    nodes = graph.nodes.select(F.lit(1).alias("at"), F.concat(F.lit("  n"), "id", F.lit(' [label="'), esc(F.col("label")), F.lit('"];')).alias("value"))
    edges = graph.edges.select(F.lit(2), F.concat(F.lit("  n"), "src", F.lit(" -> n"), "dst", F.lit(' [label="'), esc(F.col("type")), F.lit('"];')))
    frame = spark.createDataFrame([(0, f"digraph {name} {{"), (3, "}")], "at int, value string")
    frame.union(nodes).union(edges).repartitionByRange("at", "value").sortWithinPartitions("at", "value").select("value").write.text(path)


class Loader:
    """Bulk loading: nodes and relationships come as tables with keys of their own, and are written as a graph by kind.

    Properties that are set for keys are joined in before writing.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._nodes, self._edges = spark, [], []

    def nodes(self, rows: DataFrame, label: str) -> Loader:
        """`rows` has id and properties."""
        self._nodes.append(rows.withColumn("label", F.lit(label)))
        return self

    def relationships(self, rows: DataFrame, kind: str) -> Loader:
        """`rows` has eid, src, dst and properties."""
        self._edges.append(rows.withColumn("type", F.lit(kind)))
        return self

    def set_properties(self, rows: DataFrame, key: str) -> Loader:
        """Values (id, value) of one property, for nodes that were given before; others keep theirs."""
        new = rows.select("id", F.col("value").alias("__new"))
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self._nodes)
        old = F.col(key) if key in merged.columns else F.lit(None)
        self._nodes = [merged.join(new, "id", "left").withColumn(key, F.coalesce("__new", old)).drop("__new")]
        return self

    def graph(self) -> PropertyGraph:
        both = [reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), x) for x in (self._nodes, self._edges)]
        return PropertyGraph(*both)

    def get_properties(self, ids: DataFrame) -> DataFrame:
        return self.graph().nodes.join(ids.select("id"), "id", "left_semi")

    def load(self, path: str) -> PropertyGraph:
        write_graph(self.graph(), path)
        return read_graph(self.spark, path)
