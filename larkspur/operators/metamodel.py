"""Classes, properties and restrictions: hierarchies, instances, and look-ups along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import xsd_value
from ..plans.steps import settled


def closure(subclass_of: DataFrame) -> DataFrame:
    """(sub, super, depth) over any number of steps, the fewest for each pair; cycles end."""
    base = settled(subclass_of.select("sub", "super").distinct().withColumn("depth", F.lit(1)), "closure")
    done, tip = base, base
    while True:
        nxt = tip.select("sub", F.col("super").alias("mid"), "depth").join(base.select(F.col("sub").alias("mid"), "super"), "mid")
        new = nxt.groupBy("sub", "super").agg((F.min("depth") + 1).alias("depth")).join(done, ["sub", "super"], "left_anti")
        tip = settled(new.select("sub", "super", "depth"), "closure")
        if tip.isEmpty():
            return done
        done = done.union(tip)


def direct_subs(subclass_of: DataFrame, name: str) -> DataFrame:
    return subclass_of.where(F.col("super") == name).select("sub")


def direct_supers(subclass_of: DataFrame, name: str) -> DataFrame:
    return subclass_of.where(F.col("sub") == name).select("super")


def is_sub_of(subclass_of: DataFrame, sub: str, super_: str) -> bool:
    return not closure(subclass_of).where((F.col("sub") == sub) & (F.col("super") == super_)).isEmpty()


def all_instances(subclass_of: DataFrame, instance_of: DataFrame) -> DataFrame:
    """(class, instance): direct ones and those of all sub-classes."""
    up = closure(subclass_of).select(F.col("sub").alias("class"), "super")
    more = instance_of.join(up, "class").select(F.col("super").alias("class"), "instance")
    return instance_of.select("class", "instance").union(more).distinct()


def all_properties(subclass_of: DataFrame, class_properties: DataFrame) -> DataFrame:
    """(class, property): own and inherited ones."""
    up = closure(subclass_of).select(F.col("sub").alias("class"), "super")
    more = up.join(class_properties.select(F.col("class").alias("super"), "property"), "super").select("class", "property")
    return class_properties.select("class", "property").union(more).distinct()


def lookup(subclass_of: DataFrame, restrictions: DataFrame, property_values: DataFrame, subproperty_of: DataFrame, what: str) -> DataFrame:
    """(class, property, value) of `what` (range, min or max): the class's restriction, else its nearest super-class's, else the property's, else its nearest super-property's.

    `restrictions` has class, property and `what`; `property_values` property
    and `what`. Ties in distance go to the smallest name.
    """
    classes = subclass_of.select(F.col("sub").alias("class")).union(subclass_of.select("super")).union(restrictions.select("class")).distinct()
    up = closure(subclass_of).select(F.col("sub").alias("class"), F.col("super").alias("at"), "depth").union(classes.select("class", F.col("class").alias("at"), F.lit(0).alias("depth")))
    r = restrictions.where(F.col(what).isNotNull()).select(F.col("class").alias("at"), "property", F.col(what).alias("value"))
    by_class = up.join(r, "at").groupBy("class", "property").agg(F.min(F.struct("depth", "at", "value"))["value"].alias("value"))
    props = property_values.select("property").union(subproperty_of.select("sub")).union(subproperty_of.select("super")).union(restrictions.select("property")).distinct()
    upp = closure(subproperty_of).select(F.col("sub").alias("property"), F.col("super").alias("at"), "depth").union(props.select("property", F.col("property").alias("at"), F.lit(0).alias("depth")))
    v = property_values.where(F.col(what).isNotNull()).select(F.col("property").alias("at"), F.col(what).alias("value"))
    by_prop = upp.join(v, "at").groupBy("property").agg(F.min(F.struct("depth", "at", "value"))["value"].alias("fallback"))
    # Every class has every property with a value of its own: names of the model, not data.
    pairs = by_class.select("class", "property").union(classes.withColumn("__k", F.lit(1)).join(by_prop.select("property", F.lit(1).alias("__k")), "__k").select("class", "property")).distinct()
    got = pairs.join(by_class, ["class", "property"], "left").join(by_prop, "property", "left")
    return got.select("class", "property", F.coalesce("value", "fallback").alias("value")).where("value is not null")


def all_names(subclass_of: DataFrame, name: str) -> DataFrame:
    """(class): a class and all below it."""
    return closure(subclass_of).where(F.col("super") == name).select(F.col("sub").alias("class")).union(subclass_of.sparkSession.createDataFrame([(name,)], "class string"))


class Model:
    """Classes, properties and restrictions in namespaces, as tables of names; changes give a new model.

    tables: subclass_of (sub, super), subproperty_of (sub, super), classes
    (class), properties (property), domain (class, property), range (property,
    range), restrictions (class, property, range, min, max), inverse_of
    (property, inverse), instance_of (class, instance).
    """

    KINDS = {
        "subclass_of": "sub string, super string", "subproperty_of": "sub string, super string", "classes": "class string", "properties": "property string", "domain": "class string, property string",
        "range": "property string, range string", "restrictions": "class string, property string, range string, min int, max int", "inverse_of": "property string, inverse string", "instance_of": "class string, instance string",
        "behaviour": "property string, collection string, indexed boolean",
    }

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark = spark
        self.tables = {k: (tables or {}).get(k, spark.createDataFrame([], kind)) for k, kind in self.KINDS.items()}

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def _with(self, **tables: DataFrame) -> Model:
        return Model(self.spark, self.tables | tables)

    def create(self, kind: str, *rows: tuple) -> Model:
        """Adds rows to a table; those that are there stay."""
        return self._with(**{kind: self.tables[kind].union(self.spark.createDataFrame(list(rows), self.KINDS[kind])).distinct()})

    def find(self, kind: str, name: str, create: bool = False) -> tuple[Model, DataFrame]:
        """The row of a class or property by its name, created if asked for and missing."""
        col = self.tables[kind].columns[0]
        model = self.create(kind, (name,)) if create else self
        return model, model.tables[kind].where(F.col(col) == name)

    def namespaces(self) -> DataFrame:
        names = self.classes.toDF("n").union(self.properties.toDF("n"))
        return names.select(F.regexp_extract("n", r"^(.*[#/:])[^#/:]*$", 1).alias("namespace")).distinct()

    def in_namespace(self, prefix: str, kind: str = "classes") -> DataFrame:
        return self.tables[kind].where(F.col(self.tables[kind].columns[0]).startswith(prefix))

    def rename(self, old: str, new: str) -> Model:
        """Another name for a class, property, instance or namespace (names that begin with it, where it ends in # / or :)."""
        whole = old[-1:] not in "#/:"

        def swap(c: str) -> Column:
            col = F.col(c)
            return F.when(col == old, F.lit(new)).otherwise(col) if whole else F.when(col.startswith(old), F.concat(F.lit(new), F.substring(col, len(old) + 1, 1 << 30))).otherwise(col)

        return self._with(**{k: t.select(*[swap(f.name).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in t.schema]).distinct() for k, t in self.tables.items()})

    def properties_of(self) -> DataFrame:
        """(class, property): own and inherited ones."""
        return all_properties(self.subclass_of, self.domain)

    def restricting_classes(self) -> DataFrame:
        """(property, class) of the classes that restrict a property."""
        return self.restrictions.select("property", "class").distinct()

    def lookup(self, what: str) -> DataFrame:
        """(class, property, value) of range, min or max."""
        own = self.range if what == "range" else self.spark.createDataFrame([], f"property string, {what} int")
        return lookup(self.subclass_of, self.restrictions, own, self.subproperty_of, what)

    def class_ranges(self) -> DataFrame:
        """(property, range, instance): ranges that are classes, with all instances that fit."""
        at = all_instances(self.subclass_of, self.instance_of).select(F.col("class").alias("range"), "instance")
        return self.range.join(at, "range").select("property", "range", "instance")

    def violations(self, values: DataFrame) -> DataFrame:
        """(instance, property, n, min, max) of instances of (class, instance, property, value) whose number of values is out of their class's bounds."""
        low, high = (self.lookup(w).select("class", "property", F.col("value").alias(w)) for w in ("min", "max"))
        n = values.groupBy("class", "instance", "property").agg(F.count("value").alias("n"))
        got = n.join(low, ["class", "property"], "left").join(high, ["class", "property"], "left")
        return got.where("n < min or n > max").select("instance", "property", "n", "min", "max")

    def with_inverses(self, statements: DataFrame) -> DataFrame:
        """Statements (s, p, o) with those that inverse properties imply, either way."""
        both = self.inverse_of.select(F.col("property").alias("p"), F.col("inverse").alias("q")).union(self.inverse_of.select("inverse", "property")).distinct()
        return statements.select("s", "p", "o").union(statements.join(both, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))).distinct()

    def collected(self, values: DataFrame) -> DataFrame:
        """(instance, property, values) of (instance, property, value): lists keep repeats, sets don't, single values are the last by order of value."""
        got = values.join(self.behaviour, "property", "left")
        kind = F.coalesce(F.first("collection"), F.lit("set"))
        all_ = F.sort_array(F.collect_list("value"))
        rows = got.groupBy("instance", "property").agg(all_.alias("v"), kind.alias("kind"))
        v = F.when(F.col("kind") == "list", F.col("v")).when(F.col("kind") == "single", F.slice("v", -1, 1)).otherwise(F.array_distinct("v"))
        return rows.select("instance", "property", v.alias("values"))

    def indexed(self, values: DataFrame) -> DataFrame:
        """Index entries (key, value, node) of the properties that are to be indexed."""
        return values.join(self.behaviour.where("indexed").select("property"), "property", "left_semi").select(F.col("property").alias("key"), "value", F.col("instance").alias("node"))


def in_range(col: Column, kind: str, spec: str | Sequence) -> Column:
    """Whether a value lies in a range: an XSD datatype, or one of given values."""
    if kind == "datatype":
        return xsd_value(col, spec).isNotNull()
    if kind in ("data", "instances"):
        return col.isin(*spec)
    raise ValueError(f"unknown range {kind}")


def cardinality_violations(values: DataFrame, least: int | None, most: int | None) -> DataFrame:
    """(instance, n) of instances whose number of values is out of bounds; `values` has a null value where an instance has none."""
    n = values.groupBy("instance").agg(F.count("value").alias("n"))
    bad = F.lit(False)
    if least is not None:
        bad = bad | (F.col("n") < least)
    if most is not None:
        bad = bad | (F.col("n") > most)
    return n.where(bad)


def from_statements(quads: DataFrame) -> dict[str, DataFrame]:
    """Model tables from RDFS and OWL statements: subclass_of, subproperty_of, instance_of, classes, properties, domain, range."""
    pick = lambda *p: quads.where(F.col("p").isin(*p))
    kinds = ("rdfs:Class", "owl:Class", "rdf:Property", "owl:ObjectProperty", "owl:DatatypeProperty")
    typed = pick("rdf:type")
    return {
        "subclass_of": pick("rdfs:subClassOf").select(F.col("s").alias("sub"), F.col("o").alias("super")),
        "subproperty_of": pick("rdfs:subPropertyOf").select(F.col("s").alias("sub"), F.col("o").alias("super")),
        "classes": typed.where(F.col("o").isin(*kinds[:2])).select(F.col("s").alias("class")),
        "properties": typed.where(F.col("o").isin(*kinds[2:])).select(F.col("s").alias("property")),
        "instance_of": typed.where(~F.col("o").isin(*kinds)).select(F.col("o").alias("class"), F.col("s").alias("instance")),
        "domain": pick("rdfs:domain").select(F.col("o").alias("class"), F.col("s").alias("property")),
        "range": pick("rdfs:range").select(F.col("s").alias("property"), F.col("o").alias("range")),
        "restrictions": _restrictions(quads),
        "inverse_of": pick("owl:inverseOf").select(F.col("s").alias("property"), F.col("o").alias("inverse")),
    }


def _restrictions(quads: DataFrame) -> DataFrame:
    """(class, property, range, min, max) of OWL restrictions that classes are sub-classes of."""
    o = lambda p, name: quads.where(F.col("p") == p).select(F.col("s").alias("r"), F.col("o").alias(name))
    held = quads.where("p = 'rdfs:subClassOf'").select(F.col("s").alias("class"), F.col("o").alias("r"))
    got = held.join(o("owl:onProperty", "property"), "r")
    for p, name in (("owl:allValuesFrom", "range"), ("owl:minCardinality", "min"), ("owl:maxCardinality", "max"), ("owl:cardinality", "both")):
        got = got.join(o(p, name), "r", "left")
    num = lambda c: F.coalesce(F.col(c).try_cast("int"), F.col("both").try_cast("int")).alias(c)
    return got.select("class", "property", "range", num("min"), num("max"))
