"""Statements (s, p, o, o_kind, datatype, lang, ctx): patterns with wildcards, changes, search, and a query subset."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import regex_partial
from . import index
from .metamodel import closure

TYPE = "rdf:type"
DEFAULT = "default"
KEYS = ["s", "p", "o", "ctx"]


class Any_:
    """The wildcard."""


ANY = Any_()


def matches(s=ANY, p=ANY, o=ANY, *contexts) -> Column:
    """Condition for statements; at most one context may be given, None means the default one, none any."""
    if len(contexts) > 1:
        raise ValueError("at most one context")
    out = F.lit(True)
    for c, v in (("s", s), ("p", p), ("o", o)):
        if v is not ANY:
            out = out & (F.col(c) == F.lit(v))
    if contexts and contexts[0] is not ANY:
        out = out & (F.col("ctx") == F.lit(DEFAULT if contexts[0] is None else contexts[0]))
    return out


def add(quads: DataFrame, rows: DataFrame) -> DataFrame:
    """Adding is idempotent for each statement and context; what is there already stays as it is."""
    new = rows.dropDuplicates(KEYS).join(quads.select(*KEYS), KEYS, "left_anti")
    return quads.unionByName(new, allowMissingColumns=True)


def find(quads: DataFrame, s=ANY, p=ANY, o=ANY, *contexts, subclass_of: DataFrame | None = None, subproperty_of: DataFrame | None = None) -> DataFrame:
    """Statements that fit; with hierarchies (sub, super), those of sub-classes and sub-properties fit as well."""
    got = quads
    if subproperty_of is not None and p is not ANY:
        subs = closure(subproperty_of).where(F.col("super") == p).select(F.col("sub").alias("p")).union(quads.sparkSession.createDataFrame([(p,)], "p string"))
        got, p = got.join(subs, "p", "left_semi").select(*quads.columns), ANY
    if subclass_of is not None and p == TYPE and o is not ANY:
        subs = closure(subclass_of).where(F.col("super") == o).select(F.col("sub").alias("o")).union(quads.sparkSession.createDataFrame([(o,)], "o string"))
        got, o = got.join(subs, "o", "left_semi").select(*quads.columns), ANY
    return got.where(matches(s, p, o, *contexts))


def remove(quads: DataFrame, s=ANY, p=ANY, o=ANY, *contexts) -> DataFrame:
    return quads.where(~F.coalesce(matches(s, p, o, *contexts), F.lit(False)))


def size(quads: DataFrame, *contexts: str) -> DataFrame:
    some = quads.where(F.col("ctx").isin(*contexts)) if contexts else quads
    return some.agg(F.count("*").alias("size"))


def contexts(quads: DataFrame) -> DataFrame:
    return quads.select("ctx").distinct()


def clear(quads: DataFrame, *names: str) -> DataFrame:
    return quads.where(~F.col("ctx").isin(*names)) if names else quads.limit(0)


def rename_context(quads: DataFrame, old: str, new: str) -> DataFrame:
    """Statements that are in both contexts already become one; those that were there stay as they are."""
    moved = quads.where(F.col("ctx") == old).withColumn("ctx", F.lit(new))
    rest = quads.where(~F.coalesce(F.col("ctx") == old, F.lit(False)))
    return rest.unionByName(moved.join(rest.select(*KEYS), KEYS, "left_anti").select(*quads.columns))


def with_metadata(quads: DataFrame, key: str, value: Column, where: Column) -> DataFrame:
    """Sets a key of the statements' meta maps."""
    return quads.withColumn("meta", F.when(where, F.map_concat(F.map_filter("meta", lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))).otherwise(F.col("meta")))


def without_metadata(quads: DataFrame, key: str, where: Column) -> DataFrame:
    return quads.withColumn("meta", F.when(where, F.map_filter("meta", lambda k, _: k != key)).otherwise(F.col("meta")))


def literals(quads: DataFrame) -> DataFrame:
    """The full-text index over literals: equal literals of a subject and predicate once."""
    return quads.where("o_kind = 'literal'").select(F.lit("o").alias("key"), F.col("o").alias("value"), F.struct("s", "p", "o").alias("node")).distinct()


def search(quads: DataFrame, text: str, snippets: int = 0, around: int = 20) -> DataFrame:
    """(s, p, o, score) of literals that hold any of the words; with `snippets` the first so many by score have a snippet, the others null."""
    got = index.relevance(literals(quads), "o", text).select("node.*", "score")
    if not snippets:
        return got
    first = got.orderBy(F.col("score").desc(), "s", "p", "o").limit(snippets)
    word = "|".join(re.escape(w) for w in text.split())
    cut = first.select("s", "p", "o", F.regexp_extract("o", f"(?i)(.{{0,{around}}}(?:{word}).{{0,{around}}})", 1).alias("snippet"))
    return got.join(cut, ["s", "p", "o"], "left")


def verify(quads: DataFrame, indexed: DataFrame) -> DataFrame:
    """Differences between literals and an index of them: a row with `side` for each."""
    a, b = literals(quads), indexed.select("key", "value", "node")
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("stale")))


def reindex(quads: DataFrame, indexed: DataFrame) -> DataFrame:
    """An index without differences: stale entries go, missing ones come."""
    diff = verify(quads, indexed)
    stale = diff.where("side = 'stale'").drop("side")
    return indexed.select("key", "value", "node").exceptAll(stale).unionByName(diff.where("side = 'missing'").drop("side"))


def namespaces(quads: DataFrame) -> DataFrame:
    """(prefix): what precedes the last #, / or : of predicates and of types."""
    terms = quads.select(F.col("p").alias("t")).union(quads.where((F.col("p") == TYPE) & (F.col("o_kind") == "uri")).select("o"))
    return terms.select(F.regexp_extract("t", r"^(.*[#/:])[^#/:]*$", 1).alias("prefix")).where("prefix <> ''").distinct()


def renamed_namespace(quads: DataFrame, old: str, new: str) -> DataFrame:
    """Terms that begin with one prefix begin with another; statements that become equal are one."""
    swap = lambda c: F.when(F.col(c).startswith(old), F.concat(F.lit(new), F.substring(F.col(c), len(old) + 1, 1 << 30))).otherwise(F.col(c))
    o = F.when(F.col("o_kind") == "uri", swap("o")).otherwise(F.col("o"))
    return quads.withColumn("s", swap("s")).withColumn("p", swap("p")).withColumn("o", o).dropDuplicates(KEYS)


def typed_by_range(quads: DataFrame, ranges: DataFrame) -> DataFrame:
    """Objects become literals or URIs by the range of their property: (property, datatype), datatype null for classes.

    Properties without a range keep what they have.
    """
    r = ranges.select(F.col("property").alias("p"), F.col("datatype").alias("__d"), F.lit(True).alias("__known"))
    got = quads.join(r, "p", "left")
    kind = F.when(F.col("__known"), F.when(F.col("__d").isNull(), "uri").otherwise("literal")).otherwise(F.col("o_kind"))
    kind_type = F.when(F.col("__known"), F.col("__d")).otherwise(F.col("datatype"))
    return got.withColumn("o_kind", kind).withColumn("datatype", kind_type).select(*quads.columns)


def as_verbose_graph(quads: DataFrame):
    """Verbose layout: a node for every statement, with SUBJECT, PREDICATE, OBJECT and CONTEXT relationships to nodes of its terms.

    Literals are nodes as well, one for each value and datatype.
    """
    from ..graph import PropertyGraph

    literal = F.concat(F.lit('"'), "o", F.lit('"^^'), F.coalesce("datatype", F.lit("")))
    rows = quads.select("s", "p", F.when(F.col("o_kind") == "literal", literal).otherwise(F.col("o")).alias("o"), "ctx", F.concat_ws("\x1f", "s", "p", literal, "o_kind", "ctx").alias("name"))
    rows = rows.dropDuplicates(["name"])
    term = lambda c: F.xxhash64(F.lit("term"), c)
    statement = F.xxhash64(F.lit("statement"), F.col("name"))
    nodes = rows.select(statement.alias("id"), F.lit("statement").alias("label"), F.lit(None).cast("string").alias("name"))
    edges = None
    for c, kind in (("s", "SUBJECT"), ("p", "PREDICATE"), ("o", "OBJECT"), ("ctx", "CONTEXT")):
        nodes = nodes.union(rows.select(term(F.col(c)), F.lit("term"), c))
        e = rows.select(F.xxhash64(F.lit(kind), "name").alias("eid"), statement.alias("src"), term(F.col(c)).alias("dst"), F.lit(kind).alias("type"))
        edges = e if edges is None else edges.union(e)
    return PropertyGraph(nodes.distinct(), edges)


class TripleSource:
    """A statement table behind the three calls that a query engine asks for."""

    def __init__(self, quads: DataFrame) -> None:
        self.quads = quads

    def get_triples(self, s=ANY, p=ANY, o=ANY, *contexts) -> DataFrame:
        return find(self.quads, s, p, o, *contexts).select("s", "p", "o")

    def count(self, s=ANY, p=ANY, o=ANY, *contexts) -> int:
        return find(self.quads, s, p, o, *contexts).count()

    def evaluate(self, query: str, prefixes: dict[str, str] | None = None) -> DataFrame:
        return evaluate(self.quads, query, prefixes)


def as_graph(quads: DataFrame):
    """Dense layout: statements about objects become relationships, literals become properties (map `props`)."""
    from ..graph import PropertyGraph

    ids = quads.select(F.col("s").alias("name")).union(quads.where("o_kind <> 'literal'").select("o")).distinct().withColumn("id", F.xxhash64("name"))
    props = quads.where("o_kind = 'literal'").groupBy(F.xxhash64("s").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("p", "o")))).alias("props"))
    edges = quads.where("o_kind <> 'literal'").select(F.xxhash64("s", "p", "o", "ctx").alias("eid"), F.xxhash64("s").alias("src"), F.xxhash64("o").alias("dst"), F.col("p").alias("type"))
    return PropertyGraph(ids.select("id", F.lit(None).cast("string").alias("label"), "name").join(props, "id", "left"), edges)


# A query subset: SELECT and CONSTRUCT over basic patterns, OPTIONAL and FILTER.
_TOKEN = re.compile(r"""\s*(?:(<[^>]*>)|("(?:[^"\\]|\\.)*"(?:\^\^\S+|@\w+)?)|([?$]\w+)|(&&|\|\||[<>]=?|!=|=|[{}().,;!*])|([^\s{}();,=<>!&|]+(?<![.])|\S))""")


@dataclass
class Query:
    kind: str
    variables: list[str]
    distinct: bool = False
    template: list[tuple[str, str, str]] = field(default_factory=list)
    where: list[tuple[str, str, str]] = field(default_factory=list)
    optional: list[list[tuple[str, str, str]]] = field(default_factory=list)
    #: Conditions by group: 0 is the main pattern, k the k-th optional one.
    filters: dict[int, list[tuple[set[str], Column]]] = field(default_factory=dict)


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    """Parses the subset; anything else raises."""
    toks, at = [next(x for x in m.groups() if x is not None) for m in _TOKEN.finditer(text) if m[0].strip()], 0
    names = dict(prefixes or {})

    def peek() -> str:
        return toks[at] if at < len(toks) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        t = peek()
        if want is not None and t.upper() != want:
            raise ValueError(f"expected {want}, found {t or 'the end'}")
        at += 1
        return t

    def term(t: str) -> str:
        if t[0] in "?$":
            return "?" + t[1:]
        if t[0] == "<":
            return t[1:-1]
        if t[0] == '"':
            return re.match(r'"((?:[^"\\]|\\.)*)"', t)[1].replace('\\"', '"')
        if t == "a":
            return TYPE
        head, mark, rest = t.partition(":")
        return names[head] + rest if mark and head in names else t

    def triples(group: int = 0) -> list[tuple[str, str, str]]:
        out: list[tuple[str, str, str]] = []
        take("{")
        while peek() != "}":
            up = peek().upper()
            if up in ("OPTIONAL", "FILTER", "GRAPH", "UNION") or peek() == "{":
                if up == "OPTIONAL":
                    take()
                    if group:
                        raise NotImplementedError("OPTIONAL within OPTIONAL")
                    q.optional.append([])
                    q.optional[-1] = triples(len(q.optional))
                elif up == "FILTER":
                    take()
                    begin = at
                    c = condition()
                    q.filters.setdefault(group, []).append(({"?" + t[1:] for t in toks[begin:at] if t[0] in "?$"}, c))
                else:
                    raise NotImplementedError(up or "nested groups")
                continue
            if peek() == ".":
                take()
                continue
            s = term(take())
            while True:
                p = term(take())
                while True:
                    out.append((s, p, term(take())))
                    if peek() != ",":
                        break
                    take()
                if peek() != ";":
                    break
                take()
        take("}")
        return out

    def condition() -> Column:
        def factor() -> Column:
            t = take()
            if t == "(":
                c = either()
                take(")")
                return c
            if t == "!":
                return ~factor()
            if t.lower() == "regex":
                take("(")
                v = take()
                take(",")
                pattern = term(take())
                flags = ""
                if peek() == ",":
                    take()
                    flags = term(take())
                take(")")
                return regex_partial(F.col(f"`?{v[1:]}`"), pattern, "i" in flags)
            if t.lower() == "bound":
                take("(")
                v = take()
                take(")")
                return F.col(f"`?{v[1:]}`").isNotNull()
            left, op, right = value(t), take(), value(take())
            return {"=": lambda: left == right, "!=": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right}[op]()

        def value(t: str) -> Column:
            if t[0] in "?$":
                return F.col(f"`?{t[1:]}`")
            return F.lit(float(t)) if re.fullmatch(r"-?\d+(\.\d+)?", t) else F.lit(term(t))

        def both() -> Column:
            c = factor()
            while peek() == "&&":
                take()
                c = c & factor()
            return c

        def either() -> Column:
            c = both()
            while peek() == "||":
                take()
                c = c | both()
            return c

        return factor()

    while peek().upper() == "PREFIX":
        take()
        head = take().rstrip(":")
        names[head] = take()[1:-1]
    kind = take().upper()
    if kind not in ("SELECT", "CONSTRUCT"):
        raise NotImplementedError(kind)
    q = Query(kind, [])
    if kind == "SELECT":
        if peek().upper() == "DISTINCT":
            take()
            q.distinct = True
        while peek() == "*" or peek()[:1] in ("?", "$"):
            q.variables.append(term(take()))
    else:
        q.template = triples()
    if peek().upper() == "WHERE":
        take()
    q.where = triples()
    if peek():
        raise NotImplementedError(peek())
    return q


def _bind(quads: DataFrame, triple: tuple[str, str, str]) -> DataFrame:
    df, cols = quads, {}
    for c, t in zip("spo", triple, strict=True):
        if t[0] != "?":
            df = df.where(F.col(c) == t)
        elif t in cols:
            df = df.where(F.col(c) == F.col(cols[t]))
        else:
            cols[t] = c
    return df.select(*[F.col(c).alias(t) for t, c in cols.items()]).distinct()


def _group(quads: DataFrame, triples: list[tuple[str, str, str]], bound: set[str]) -> DataFrame:
    """Joins of the triples. Begins with the most bound one; of several class patterns with that of the smallest class."""
    left, df = list(triples), None
    classes = [t[2] for t in left if t[1] == TYPE and t[2][0] != "?"]
    size = {r["o"]: r["count"] for r in quads.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).groupBy("o").count().collect()} if len(classes) > 1 else {}  # one row a class of the query
    while left:
        have = bound if df is None else set(df.columns)
        t = max(left, key=lambda t: (any(x in have for x in t), sum(x[0] != "?" for x in t), -size.get(t[2], 0)))
        left.remove(t)
        one = _bind(quads, t)
        if df is None:
            df = one
            continue
        shared = [c for c in one.columns if c in df.columns]
        if not shared:
            raise NotImplementedError("patterns without a common variable")
        df = df.join(one, shared)
    return df


def evaluate(quads: DataFrame, query: str | Query, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Bindings of a SELECT as columns named by the variables, missing ones as empty strings; triples (s, p, o) of a CONSTRUCT."""
    q = parse(query, prefixes) if isinstance(query, str) else query
    df, late = _group(quads, q.where, set()), []
    for names, c in q.filters.get(0, []):  # as soon as all variables are there
        if names <= set(df.columns):
            df = df.where(c)
        else:
            late.append(c)
    for k, triples in enumerate(q.optional, 1):
        part = _group(quads, triples, set(df.columns))
        on = [c for c in part.columns if c in df.columns]
        for names, c in q.filters.get(k, []):
            if not names <= set(part.columns):  # conditions on variables of the main pattern
                part = part.join(df.select(*on, *[x for x in names - set(part.columns) if x in df.columns]).distinct(), on)
            part = part.where(c)
        df = df.join(part.select(*on, *[c for c in part.columns if c not in df.columns]), on, "left")
    for c in late:
        df = df.where(c)
    if q.kind == "SELECT":
        names = df.columns if q.variables in ([], ["?*"], ["*"]) else q.variables
        out = df.select(*[F.coalesce(F.col(f"`{v}`"), F.lit("")).alias(v.lstrip("?")) for v in names])
        return out.distinct() if q.distinct else out
    term = lambda t: F.col(f"`{t}`") if t[0] == "?" else F.lit(t)
    rows = F.array(*[F.struct(*[term(x).alias(c) for c, x in zip("spo", t, strict=True)]) for t in q.template])
    return df.select(F.explode(rows).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()
