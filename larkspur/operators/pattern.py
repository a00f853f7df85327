"""Sub-graph patterns compiled to joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import BOTH, OUT, Direction, PropertyGraph


@dataclass(frozen=True)
class PatternNode:
    """A node to find: perhaps a fixed id, a label, and conditions on its columns."""

    name: str
    id: int | None = None
    label: str | None = None
    where: tuple[Callable[[DataFrame], Column], ...] = ()


@dataclass(frozen=True)
class PatternRel:
    """A relationship between two pattern nodes; without type any, with BOTH in either direction."""

    a: str
    b: str
    type: str | None = None
    direction: Direction = OUT
    where: tuple[Callable[[DataFrame], Column], ...] = ()
    name: str | None = None


@dataclass(frozen=True)
class Pattern:
    """Nodes and relationships; `optional` patterns share nodes with it and may be missing; `filters` and `groups` of them see a match's columns.

    `keep` names columns of pattern nodes, and of named pattern relationships,
    that a match has as well, as name_column.

    A match never uses one relationship for two pattern relationships; nodes
    may stand for several pattern nodes unless `distinct_nodes`.
    """

    nodes: tuple[PatternNode, ...]
    rels: tuple[PatternRel, ...]
    optional: tuple[Pattern, ...] = ()
    filters: tuple[Column, ...] = ()
    distinct_nodes: bool = False
    keep: dict[str, tuple[str, ...]] = field(default_factory=dict)
    groups: dict[str, tuple[Column, ...]] = field(default_factory=dict)
    any_group: bool = False

    def group(self, name: str, *conditions: Column) -> Pattern:
        """With conditions on a match's columns in a named group."""
        return replace(self, groups={**self.groups, name: (*self.groups.get(name, ()), *conditions)})

    def condition(self) -> Column | None:
        """All filters, and all conditions of every group; with `any_group` those of one group are enough."""
        both = lambda cs: reduce(lambda a, b: a & b, cs)
        groups = [both(cs) for cs in self.groups.values() if cs]
        parts = list(self.filters) + ([reduce(lambda a, b: a | b, groups)] if groups and self.any_group else groups)
        return both(parts) if parts else None

    def __str__(self) -> str:
        lines = [f"({n.name}{':' + n.label if n.label else ''}{'' if n.id is None else ' = ' + str(n.id)})" for n in self.nodes]
        lines += [f"({r.a}){'<' if r.direction is Direction.INCOMING else ''}-[{r.type or ''}]-{'>' if r.direction is OUT else ''}({r.b})" for r in self.rels]
        lines += [f"group {g}: {len(cs)} conditions" for g, cs in self.groups.items()]
        return "\n".join(lines + [f"optional {o}" for o in self.optional])


def _nodes(graph: PropertyGraph, p: PatternNode, keep: tuple[str, ...]) -> DataFrame:
    df = graph.nodes
    if p.id is not None:
        df = df.where(F.col("id") == p.id)
    if p.label is not None:
        df = df.where(F.col("label") == p.label)
    for c in p.where:
        df = df.where(c(df))
    return df.select(F.col("id").alias(p.name), *[F.col(c).alias(f"{p.name}_{c}") for c in keep])


def _plain(p: PatternNode, keep: tuple[str, ...]) -> bool:
    return p.label is None and p.id is None and not p.where and not keep


def _rels(graph: PropertyGraph, r: PatternRel, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    e = graph.edges
    if r.type is not None:
        e = e.where(F.col("type") == r.type)
    for c in r.where:
        e = e.where(c(e))
    a, b = (r.a, r.b) if r.direction is not Direction.INCOMING else (r.b, r.a)
    own = [F.col("eid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in keep]]
    if a == b:  # from a node to itself
        return e.where("src = dst").select(F.col("src").alias(a), *own)
    out = e.select(F.col("src").alias(a), F.col("dst").alias(b), *own)
    if r.direction is BOTH:
        out = out.union(e.where("src <> dst").select(F.col("dst").alias(a), F.col("src").alias(b), *own))
    return out


def match(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """A row for each match: the node id of every pattern node, the eid of every pattern relationship (r0, r1, ... unless named).

    Joins begin at the most restricted node and follow the pattern.
    """
    by = {n.name: n for n in pattern.nodes}
    kept = lambda n: tuple(pattern.keep.get(n, ()))
    left = list(enumerate(pattern.rels))
    names = {i: r.name or f"r{i}" for i, r in left}
    first = min(pattern.nodes, key=lambda n: (n.id is None, n.label is None, not n.where))
    df, bound = _nodes(graph, first, kept(first.name)), {first.name}
    used: list[str] = []
    while left:
        i, r = min(left, key=lambda x: ((x[1].a not in bound) + (x[1].b not in bound), by[x[1].a].id is None and by[x[1].b].id is None))
        if r.a not in bound and r.b not in bound:
            raise ValueError("the pattern falls apart; match its parts by themselves")
        left.remove((i, r))
        side = _rels(graph, r, names[i], kept(names[i]))
        for end in dict.fromkeys((r.a, r.b)):
            if end not in bound and not _plain(by[end], kept(end)):
                side = side.join(_nodes(graph, by[end], kept(end)), end)
        on = [n for n in dict.fromkeys((r.a, r.b)) if n in bound]
        df = df.join(side, on)
        for u in used:
            df = df.where(F.col(u) != F.col(names[i]))
        used.append(names[i])
        bound |= {r.a, r.b}
    if pattern.distinct_nodes:
        order = [n.name for n in pattern.nodes if n.name in bound]
        for i, a in enumerate(order):
            for b in order[:i]:
                df = df.where(F.col(a) != F.col(b))
    for k, o in enumerate(pattern.optional):
        shared = [n.name for n in o.nodes if n.name in bound]
        part = match(graph, Pattern(tuple(PatternNode(n.name) if n.name in shared else n for n in o.nodes), tuple(PatternRel(r.a, r.b, r.type, r.direction, r.where, r.name or f"o{k}_{i}") for i, r in enumerate(o.rels)), o.optional, o.filters, o.distinct_nodes, o.keep, o.groups, o.any_group))
        df = df.join(part, shared, "left")
    condition = pattern.condition()
    return df if condition is None else df.where(condition)
