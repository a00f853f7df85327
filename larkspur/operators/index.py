"""Exact, full-text and ordered look-ups over an index table (key, value, node)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def build(nodes: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """An entry for each value that a node has; array values give one each."""
    parts = []
    for k in keys:
        many = nodes.schema[k].dataType.typeName() == "array"
        value = F.explode(k) if many else F.col(k)
        part = nodes.where(F.col(k).isNotNull()).select(F.lit(k).alias("key"), value.alias("value"), F.col(id_col).alias("node"))
        parts.append(part.withColumn("value", F.col("value").cast("string")))
    return reduce(DataFrame.union, parts).distinct()


def save(index: DataFrame, path: str) -> None:
    """Writes the index by key, each key's values in ranges over files, so that look-ups read little and no key is one task."""
    index.repartitionByRange("key", "value").sortWithinPartitions("key", "value").write.partitionBy("key").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved index; keys are read as strings."""
    return spark.read.schema("value string, node bigint, key string").parquet(path).select("key", "value", "node")


class Indexes:
    """Indexes by name, over nodes or relationships, each a table (key, value, node)."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], DataFrame] = {}

    def put(self, name: str, index: DataFrame, kind: str = "node") -> None:
        self._held[kind, name] = index

    def get(self, name: str, kind: str = "node") -> DataFrame:
        return self._held[kind, name]

    def names(self, kind: str = "node") -> list[str]:
        return sorted(n for k, n in self._held if k == kind)

    def drop(self, name: str, kind: str = "node") -> None:
        del self._held[kind, name]

    def clear(self, name: str, kind: str = "node") -> None:
        self._held[kind, name] = self._held[kind, name].limit(0)

    def command(self, line: str) -> DataFrame:
        """A shell line: `index -g NAME KEY VALUE` gets nodes, `index -q NAME KEY QUERY` queries, `index -c NAME KEY VALUE` counts."""
        import shlex

        word, flag, name, key, *rest = shlex.split(line)
        if word != "index" or flag not in ("-g", "-q", "-c") or not rest:
            raise ValueError("index -g|-q|-c NAME KEY VALUE")
        held = self.get(name)
        if flag == "-q":
            return query(held, key, " ".join(rest))
        got = get(held, key, " ".join(rest))
        return got if flag == "-g" else hits(got)


def hits(found: DataFrame) -> DataFrame:
    """How many nodes a look-up has, as one row."""
    return found.agg(F.count("*").alias("size"))


def as_graph(index: DataFrame, first_id: int = 0):
    """The index as a graph of its own: a node for each key and for each value, KEY and VALUE relationships down to the nodes found.

    Ids of keys and values are numbered in order below `first_id`.
    """
    from ..graph import PropertyGraph

    entries = index.select("key", "value").distinct()
    by = W.orderBy("key", "value")  # one row a value of the index: names, not nodes
    numbered = entries.select("key", F.lit(None).cast("string").alias("value")).distinct().union(entries).withColumn("id", F.lit(first_id) - F.row_number().over(by))
    nodes = numbered.select("id", F.when(F.col("value").isNull(), "key").otherwise("value").alias("label"), F.coalesce("value", "key").alias("name"))
    keys = numbered.where("value is null").select("key", F.col("id").alias("src"))
    values_ = numbered.where("value is not null").select("key", "value", F.col("id").alias("dst"))
    down = keys.join(values_, "key").select("src", "dst", F.lit("KEY").alias("type"))
    found = index.join(values_, ["key", "value"]).select(F.col("dst").alias("src"), F.col("node").alias("dst"), F.lit("VALUE").alias("type"))
    edges = down.union(found.distinct())
    return PropertyGraph(nodes, edges.select(F.xxhash64("src", "dst", "type").alias("eid"), "src", "dst", "type"))


def add(index: DataFrame, rows: DataFrame, single: bool = False) -> DataFrame:
    """With more entries; a single-value index keeps the new node of a value only, of several new ones the largest."""
    if not single:
        return index.unionByName(rows).distinct()
    old = index.join(rows.select("key", "value").distinct(), ["key", "value"], "left_anti")
    return old.unionByName(rows.groupBy("key", "value").agg(F.max("node").alias("node")))


def remove(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Without entries that agree with `rows` in the columns that those have: (key), (node, key) or (node, key, value)."""
    return index.join(rows.select(*[c for c in index.columns if c in rows.columns]).distinct(), [c for c in index.columns if c in rows.columns], "left_anti")


def get(index: DataFrame, key: str, value: str) -> DataFrame:
    return index.where((F.col("key") == key) & (F.col("value") == str(value))).select("node")


def get_single(index: DataFrame, key: str, value: str) -> DataFrame:
    """The one node, no row if there is none; several raise when the result is computed."""
    one = get(index, key, value).agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return one.where("n > 0").select(F.when(F.assert_true(F.col("n") == 1, "more than one node").isNull(), F.col("node")).alias("node"))


def values(index: DataFrame, key: str) -> DataFrame:
    return index.where(F.col("key") == key).select("value").distinct()


def tokens(col: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(col), r"\s+"), lambda t: t != "")


def fulltext(index: DataFrame, key: str, query: str) -> DataFrame:
    """Nodes with a value that holds every token of the query."""
    want = query.lower().split()
    return index.where((F.col("key") == key) & (F.size(F.array_except(F.array(*map(F.lit, want)), tokens(F.col("value")))) == 0)).select("node").distinct()


_QUERY = re.compile(r'\s*(?:(AND|OR|NOT)\b|([+-]?)(\(|\)|\[[^\]]*\]|\{[^}]*\}|"[^"]*"|[^\s()]+)|(\())')


def _term(term: str, toks: Column) -> Column:
    if term[0] in "[{":
        low, _, high = term[1:-1].strip().partition(" TO ")
        low, high, closed = low.strip(), high.strip(), term[0] == "["

        def inside(t: Column) -> Column:
            a = F.lit(True) if low == "*" else t >= low if closed else t > low
            b = F.lit(True) if high == "*" else t <= high if closed else t < high
            return a & b

        return F.exists(toks, inside)
    if term[0] == '"':
        phrase = term[1:-1].lower().split()
        return F.array_join(toks, " ", "").contains(" ".join(phrase)) if phrase else F.lit(False)
    t = term.lower()
    if m := re.fullmatch(r"(.*)~([0-9.]*)", t):
        word, share = m[1], float(m[2] or 0.5)
        # Similarity 1 - distance / shorter length has to be above the share.
        return F.exists(toks, lambda x: 1 - F.levenshtein(x, F.lit(word)) / F.least(F.length(x), F.lit(len(word))) > share)
    if "*" in t or "?" in t:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in t)
        return F.exists(toks, lambda x: x.rlike(f"^{pattern}$"))
    return F.array_contains(toks, t)


def parse_query(query: str, toks: Column, default_and: bool = False) -> Column:
    """Condition on tokens: terms, +must, -not, AND OR NOT, ( ), "phrase", prefix*, fuzzy~, [low TO high]."""
    parts = [(m[1], m[2] or "", m[3] or m[4]) for m in _QUERY.finditer(query) if m[0].strip()]
    at = 0

    def group() -> Column:
        nonlocal at
        must, may, no, join, negate = [], [], [], "", False
        while at < len(parts):
            word, sign, term = parts[at]
            at += 1
            if word:
                if word == "NOT":
                    negate = True
                else:
                    join = word
                    if word == "AND" and may and not must:
                        must.append(may.pop())
                continue
            if term == ")":
                break
            c = group() if term == "(" else _term(term, toks)
            if negate or sign == "-":
                no.append(c)
            elif sign == "+" or join == "AND" or (default_and and join != "OR"):
                must.append(c)
            else:
                may.append(c)
            join, negate = "", False
        if must:
            out = reduce(lambda a, b: a & b, must)
        else:
            out = reduce(lambda a, b: a | b, may) if may else F.lit(True)
        return reduce(lambda a, b: a & ~b, no, out)

    return group()


def query(index: DataFrame, key: str, text: str, default_and: bool = False) -> DataFrame:
    """Nodes with a value that fits the query."""
    rows = index.where(F.col("key") == key)
    return rows.where(parse_query(text, tokens(F.col("value")), default_and)).select("node").distinct()


def relevance(index: DataFrame, key: str, text: str) -> DataFrame:
    """(node, score) of values with any of the terms, by sum of tf * idf; idf is ln(1 + values / values with the term)."""
    want = sorted(set(text.lower().split()))
    some = index.where(F.col("key") == key)
    # Texts without any of the words are left out before they are taken apart.
    near = reduce(lambda a, b: a | b, [F.contains(F.lower("value"), F.lit(w)) for w in want], F.lit(False))
    rows = some.where(near).select("node", "value", F.explode(F.filter(tokens(F.col("value")), lambda t: t.isin(*want))).alias("t"))
    tf = rows.groupBy("node", "value", "t").agg(F.count("*").alias("tf"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))  # one row a term of the query
    every = some.agg(F.count("*")).first()[0]
    return tf.join(F.broadcast(df), "t").groupBy("node").agg(F.sum(F.col("tf") * F.log(1 + F.lit(every) / F.col("df"))).alias("score"))


def by_relevance(index: DataFrame, key: str, text: str) -> DataFrame:
    """relevance() with `pos`, the place by falling score; equal scores in the order of nodes."""
    got = relevance(index, key, text)
    return got.withColumn("pos", F.row_number().over(W.orderBy(F.col("score").desc(), "node")))  # one row a hit


def token_index(index: DataFrame) -> DataFrame:
    """(key, token, node): the distinct tokens of every entry. Saved, it answers term, prefix, fuzzy and range queries by its few tokens."""
    return index.select("key", F.explode(F.array_distinct(tokens(F.col("value")))).alias("token"), "node").distinct()


def by_token(token_table: DataFrame, key: str, term: str) -> DataFrame:
    """Nodes with a token that fits one term of a query (word, prefix*, fuzzy~ or range): distinct tokens are tested once."""
    some = token_table.where(F.col("key") == key)
    good = some.select("token").distinct().where(_term(term, F.array("token")))
    return some.join(good, "token", "left_semi").select("node").distinct()


# Ordered maps and sets: tables whose rows are asked for by ranges and places of their keys.
def submap(index: DataFrame, key: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """(value, node) of entries with low <= value < high; open where None."""
    out = index.where(F.col("key") == key)
    out = out if low is None else out.where(F.col("value") >= low)
    out = out if high is None else out.where(F.col("value") < high)
    return out.select("value", "node")


def neighbours_of(index: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the values at or below, and at or above a value (floor, ceiling), and next to it (lower, higher)."""
    v, x = F.col("value"), F.lit(value)
    cond = lambda c, f: f(F.when(c, v))
    return index.where(F.col("key") == key).agg(cond(v <= x, F.max).alias("floor"), cond(v >= x, F.min).alias("ceiling"), cond(v < x, F.max).alias("lower"), cond(v > x, F.min).alias("higher"))


# Timelines: tables (node, ts).
def between(timeline: DataFrame, after=None, before=None) -> DataFrame:
    """Entries strictly between the bounds, null ones open; sort by ts, node for the timeline's order."""
    out = timeline
    if after is not None:
        out = out.where(F.col("ts") > F.lit(after))
    if before is not None:
        out = out.where(F.col("ts") < F.lit(before))
    return out


def at(timeline: DataFrame, ts) -> DataFrame:
    return timeline.where(F.col("ts") == F.lit(ts))


def ends(timeline: DataFrame) -> DataFrame:
    """First and last node; ties go to the smallest id."""
    first = F.min(F.struct("ts", "node"))
    last = F.max(F.struct(F.col("ts"), F.bitwise_not("node").alias("node")))
    return timeline.agg(first["node"].alias("first_node"), F.bitwise_not(last["node"]).alias("last_node"))


def timestamp_of(timeline: DataFrame, node: int) -> DataFrame:
    return timeline.where(F.col("node") == node).select("ts")


def sorted_nodes(nodes: DataFrame, *by: str) -> DataFrame:
    """A sorted set: each row once, in order."""
    return nodes.distinct().orderBy(*by)


def sorted_from(nodes: DataFrame, by: str, at, n: int) -> DataFrame:
    """The first n rows of a sorted set from `at` on."""
    return nodes.where(F.col(by) >= at).distinct().orderBy(by).limit(n)
