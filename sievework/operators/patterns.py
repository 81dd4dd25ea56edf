"""Small labelled pattern graphs, found in all graphs at once.

Tables are those of ``graph``: ``nodes(g, n, label)`` and ``edges(g, u, v, label)`` with both
directions of every edge. A pattern is matched one vertex at a time, and all patterns take their
next step in the same join: a partial match knows its pattern, and the pattern which node to go
on from. So the number of joins is that of the longest pattern, not of all together. Matches are
keyed by (graph, node) and spread over all nodes, whatever the size of a graph.

Symmetric matches are found once: vertices that a symmetry of the pattern exchanges are matched
in the order of their nodes. Like leaves around one vertex are counted and not listed, so a hub
with ``d`` neighbours gives ``d`` rows where a star of ``k`` leaves has ``d choose k`` matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.graph import _typed_edges, by_key
from sievework.session import materialize

#: Labels that a vertex or an edge may have: one, any of several, or (None) whatever there is.
Labels = str | tuple[str, ...] | None


@dataclass(frozen=True)
class Pattern:
    """A connected graph: ``vertices`` by their labels, ``edges`` as (vertex, vertex, labels).

    Its key is set for graphs with at least ``least`` matches. A match maps vertices to
    different nodes and edges to edges; nodes may have further edges.
    """

    vertices: tuple[Labels, ...]
    edges: tuple[tuple[int, int, Labels], ...] = ()
    least: int = 1


def chain(*labels: Labels, edge: Labels = None) -> Pattern:
    """Vertices in a row."""
    return Pattern(labels, tuple((i, i + 1, edge) for i in range(len(labels) - 1)))


def ring(*labels: Labels, edge: Labels = None) -> Pattern:
    """Vertices in a ring."""
    last = (len(labels) - 1, 0, edge)
    return Pattern(labels, (*chain(*labels, edge=edge).edges, last))


def star(centre: Labels, *leaves: Labels, edge: Labels = None) -> Pattern:
    """Leaves around a centre."""
    return Pattern((centre, *leaves), tuple((0, i + 1, edge) for i in range(len(leaves))))


def _allowed(labels: Labels) -> frozenset[str] | None:
    return labels if labels is None else frozenset([labels] if isinstance(labels, str) else labels)


def _around(pattern: Pattern) -> list[dict[int, frozenset[str] | None]]:
    around: list[dict] = [{} for _ in pattern.vertices]
    for a, b, labels in pattern.edges:
        if a == b or b in around[a]:
            raise ValueError("a pattern has no loops and no double edges")
        around[a][b] = around[b][a] = _allowed(labels)
    return around


def symmetries(pattern: Pattern) -> list[tuple[int, ...]]:
    """All renumberings of the vertices that leave the pattern as it is."""
    around = _around(pattern)
    labels = [_allowed(v) for v in pattern.vertices]
    found, image = [], []

    def extend() -> None:
        v = len(image)
        if v == len(labels):
            found.append(tuple(image))
            return
        for w in range(len(labels)):
            if w in image or labels[w] != labels[v] or len(around[w]) != len(around[v]):
                continue
            if all((u in around[v]) == (x in around[w]) and around[v].get(u) == around[w].get(x) for u, x in enumerate(image)):
                image.append(w)
                extend()
                image.pop()

    extend()
    return found


@dataclass
class _Program:
    """How a pattern is matched: its first vertex, then one step after the other.

    Steps are ("extend", place to go on from, edge labels, vertex labels, places whose nodes
    come before, places whose nodes come after), ("close", place, place, edge labels) and, last,
    ("leaves", place, edge labels, vertex labels, number). Places count matched vertices.
    """

    first: frozenset[str] | None
    steps: list[tuple] = field(default_factory=list)


def _leaves(around: list[dict], labels: list, group: list[tuple[int, ...]], size) -> tuple[int, list[int]] | None:
    """(centre, leaves) of the most numerous like leaves that may be counted."""
    classes: dict[tuple, list[int]] = {}
    for v, near in enumerate(around):
        if len(near) == 1:
            (centre, edge), = near.items()
            classes.setdefault((centre, edge, labels[v]), []).append(v)
    best = None
    for (centre, _, _), leaves in classes.items():
        # An exchange of the centre with one of its leaves would have to be ordered.
        if not any(s[centre] in leaves for s in group):
            rank = (len(leaves), size(leaves[0]), -centre)
            best = max(best, (rank, centre, leaves)) if best else (rank, centre, leaves)
    return best and best[1:]


def _program(pattern: Pattern, count: dict[str, int], total: int) -> _Program:
    around = _around(pattern)
    labels = [_allowed(v) for v in pattern.vertices]

    def size(v: int) -> int:
        """Nodes that the vertex could be."""
        return total if labels[v] is None else sum(count.get(label, 0) for label in labels[v])

    group = symmetries(pattern)
    centre, leaves = _leaves(around, labels, group, size) or (None, [])
    listed = [v for v in range(len(labels)) if v not in leaves]
    first = min(listed, key=lambda v: (size(v), -len(around[v]), v))
    order = [first]
    while len(order) < len(listed):
        near = [v for v in listed if v not in order and any(u in around[v] for u in order)]
        if not near:
            raise ValueError("a pattern is connected")
        order.append(min(near, key=lambda v: (-sum(u in around[v] for u in order), size(v), v)))

    # Vertices that some symmetry exchanges are matched in the order of their nodes. Each gets its
    # turn, the centre of counted leaves first; what is left are the symmetries that keep it.
    before: list[tuple[int, int]] = []
    for v in sorted(listed, key=lambda v: (v != centre, order.index(v))):
        before += [(v, w) for w in sorted({s[v] for s in group}) if w != v]
        group = [s for s in group if s[v] == v]
    if len(group) != factorial(len(leaves)):
        raise AssertionError("counted leaves are exchanged freely and nothing else is")

    program, place = _Program(labels[first]), {first: 0}
    for v in order[1:]:
        known = [u for u in order[: len(place)] if u in around[v]]
        smaller = [place[a] for a, b in before if b == v and a in place]
        larger = [place[b] for a, b in before if a == v and b in place]
        program.steps.append(("extend", place[known[0]], around[v][known[0]], labels[v], smaller, larger))
        place[v] = len(place)
        program.steps += [("close", place[u], place[v], around[v][u]) for u in known[1:]]
    if leaves:
        program.steps.append(("leaves", place[centre], around[leaves[0]][centre], labels[leaves[0]], len(leaves)))
    return program


def _per_pattern(values: dict[int, object], n: int, kind: str) -> Column:
    """The value of a row's pattern, out of a short list that is part of the plan."""

    def literal(value) -> Column:
        if isinstance(value, (list, frozenset)):
            return F.array(*[F.lit(v) for v in sorted(value)]).cast(kind)
        return F.lit(value).cast(kind)

    return F.get(F.array(*[literal(values.get(p)) for p in range(n)]), F.col("p"))


def _fits(allowed: Column, label: str) -> Column:
    return allowed.isNull() | F.array_contains(allowed, F.col(label))


def pattern_counts(nodes: DataFrame, edges: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Number of matches ``(g, pattern, n)`` of every pattern that a graph has at all.

    ``pattern`` is the index in ``patterns``; symmetric matches count once. A number beyond a
    long is null. Rows without label fit unlabelled vertices and edges only.
    """
    patterns = list(patterns)
    named = {label for p in patterns for v in [*p.vertices, *(e[2] for e in p.edges)] for label in _allowed(v) or ()}
    sizes = nodes.groupBy(F.when(F.col("label").isin(*sorted(named)), F.col("label")).alias("label")).count().collect()
    count, total = {r["label"]: r["count"] for r in sizes}, sum(r["count"] for r in sizes)
    programs, n = [_program(p, count, total) for p in patterns], len(patterns)

    typed = materialize(_typed_edges(nodes, edges), "typed")
    labels = _per_pattern({p: q.first for p, q in enumerate(programs)}, n, "array<string>")
    rows = nodes.select("g", F.array("n").alias("m"), "label", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p"))
    rows = rows.filter(_fits(labels, "label")).select("g", "p", "m")
    done = [_ended(rows, [p for p, q in enumerate(programs) if not q.steps])]
    for i in range(max(len(q.steps) for q in programs)):
        now = {p: q.steps[i] for p, q in enumerate(programs) if i < len(q.steps)}
        kinds = {kind: {p: s for p, s in now.items() if s[0] == kind} for kind in ("extend", "close", "leaves")}
        if kinds["leaves"]:
            done.append(_count_leaves(rows, typed, kinds["leaves"], n))
        moved = []
        if kinds["extend"]:
            moved.append(_extend(rows, typed, kinds["extend"], n))
        if kinds["close"]:
            moved.append(_close(rows, typed, kinds["close"], n))
        if moved:
            rows = materialize(reduce(DataFrame.unionByName, moved), "matches")
            done.append(_ended(rows, [p for p, s in now.items() if len(programs[p].steps) == i + 1 and s[0] != "leaves"]))
    found = reduce(DataFrame.unionByName, done)
    return found.groupBy("g", F.col("p").alias("pattern")).agg(F.try_sum("n").alias("n"))


def _ended(rows: DataFrame, patterns: list[int]) -> DataFrame:
    return rows.filter(F.col("p").isin(*patterns)).select("g", "p", F.lit(1).cast("bigint").alias("n"))


def _from_place(rows: DataFrame, steps: dict[int, tuple], n: int) -> DataFrame:
    at = _per_pattern({p: s[1] for p, s in steps.items()}, n, "int")
    return rows.filter(F.col("p").isin(*steps)).withColumn("u", F.get("m", at))


def _neighbours(rows: DataFrame, typed: DataFrame, steps: dict[int, tuple], n: int) -> DataFrame:
    """Matches with each next node ``v`` that has the labels and is not used yet."""
    edge = _per_pattern({p: s[2] for p, s in steps.items()}, n, "array<string>")
    vertex = _per_pattern({p: s[3] for p, s in steps.items()}, n, "array<string>")
    pairs = _from_place(rows, steps, n).join(by_key(typed.select("g", "u", "v", "e", "lv")), ["g", "u"])
    return pairs.filter(_fits(edge, "e") & _fits(vertex, "lv") & ~F.array_contains("m", F.col("v")))


def _extend(rows: DataFrame, typed: DataFrame, steps: dict[int, tuple], n: int) -> DataFrame:
    smaller = _per_pattern({p: s[4] for p, s in steps.items()}, n, "array<int>")
    larger = _per_pattern({p: s[5] for p, s in steps.items()}, n, "array<int>")
    pairs = _neighbours(rows, typed, steps, n)
    pairs = pairs.filter(F.forall(smaller, lambda i: F.get("m", i) < F.col("v")) & F.forall(larger, lambda i: F.get("m", i) > F.col("v")))
    return pairs.select("g", "p", F.array_append("m", F.col("v")).alias("m"))


def _close(rows: DataFrame, typed: DataFrame, steps: dict[int, tuple], n: int) -> DataFrame:
    to = _per_pattern({p: s[2] for p, s in steps.items()}, n, "int")
    edge = _per_pattern({p: s[3] for p, s in steps.items()}, n, "array<string>")
    pairs = _from_place(rows, steps, n).withColumn("v", F.get("m", to)).join(by_key(typed.select("g", "u", "v", "e")), ["g", "u", "v"])
    return pairs.filter(_fits(edge, "e")).select("g", "p", "m")


def _count_leaves(rows: DataFrame, typed: DataFrame, steps: dict[int, tuple], n: int) -> DataFrame:
    number = _per_pattern({p: s[4] for p, s in steps.items()}, n, "int")
    found = _neighbours(rows, typed, steps, n).groupBy("g", "p", "m").agg(F.count(F.lit(1)).alias("c"))
    ways = F.lit(None).cast("bigint")
    for k in sorted({s[4] for s in steps.values()}):
        choose = F.col("c")
        for i in range(1, k):
            # Each quotient is a binomial coefficient, so no division leaves a rest.
            choose = _times(choose, F.col("c") - i, i + 1)
        ways = F.when(number == k, choose).otherwise(ways)
    return found.filter(F.col("c") >= number).select("g", "p", ways.alias("n"))


def _times(a: Column, b: Column, by: int) -> Column:
    """``a * b / by`` where it is whole and fits a long, else null."""
    return (F.try_multiply(a.cast("decimal(20,0)"), b.cast("decimal(18,0)")) / F.lit(by)).try_cast("bigint")


def pattern_bits(nodes: DataFrame, edges: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Keys ``(g, bit)``: the patterns that a graph has often enough."""
    least = F.get(F.array(*[F.lit(p.least) for p in patterns]), F.col("pattern"))
    found = pattern_counts(nodes, edges, patterns).filter(F.coalesce(F.col("n") >= least, F.lit(True)))
    return found.select("g", F.col("pattern").alias("bit"))
