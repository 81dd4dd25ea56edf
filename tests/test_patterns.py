"""Pattern keys against all injective maps."""

import itertools
import random

import pytest

from sievework.operators import patterns as pt
from sievework.operators.patterns import Pattern, chain, ring, star

PATTERNS = [
    Pattern(("a",)), Pattern((None,), least=3), chain("a", "b"), chain("a", "a"), chain(None, None),
    chain("a", None, "a"), chain("a", "b", "a", "b"), chain(None, None, None, None), chain("a", ("a", "b"), "c", edge="2"),
    star("a", "b", "b"), star(None, None, None, None), star("a", "a", "a", "b"), star(("a", "c"), "b", "b", None),
    ring("a", "a", "a"), ring(None, None, None), ring("a", "b", "a", "b"), ring(None, None, None, None), ring(None, None, None, None, None, edge=("1", "2")),
    Pattern((None,) * 4, tuple((i, j, None) for i in range(4) for j in range(i))),
    Pattern((None,) * 4, ((0, 1, None), (1, 2, None), (2, 0, None), (2, 3, None))),
    Pattern(("a", "a", "b", "b", "b", "b"), ((0, 1, None), (0, 2, None), (0, 3, None), (1, 4, None), (1, 5, None))),
    Pattern((None, None, None, None, None), ((0, 1, "1"), (1, 2, "2"), (1, 3, "2"), (3, 4, None))),
]


def random_graphs(seed, n):
    rng = random.Random(seed)
    nodes, edges = [], []
    for g in range(n):
        size = rng.randint(1, 7)
        nodes += [(g, i * 7 % 11, rng.choice("aabbc") if rng.random() < 0.95 else None) for i in range(size)]
        for i, j in itertools.combinations(range(size), 2):
            if rng.random() < 0.45:
                label = rng.choice(["1", "1", "2", None])
                edges += [(g, i * 7 % 11, j * 7 % 11, label), (g, j * 7 % 11, i * 7 % 11, label)]
    return nodes, edges


def fits(labels, label):
    return labels is None or (label == labels if isinstance(labels, str) else label in labels)


def brute(nodes, edges, pattern):
    """Matches per graph: all maps, divided by the maps of the pattern onto itself."""
    symmetric = sum(
        all(pattern.vertices[i] == pattern.vertices[s[i]] for i in range(len(s)))
        and {(min(s[a], s[b]), max(s[a], s[b]), e) for a, b, e in pattern.edges} == {(min(a, b), max(a, b), e) for a, b, e in pattern.edges}
        for s in itertools.permutations(range(len(pattern.vertices)))
    )
    out = {}
    label, edge = {(g, n): x for g, n, x in nodes}, {(g, u, v): x for g, u, v, x in edges}
    for g in {g for g, *_ in nodes}:
        here = [n for h, n, _ in nodes if h == g]
        n = sum(
            all(fits(p, label[g, m]) for p, m in zip(pattern.vertices, ms))
            and all((g, ms[a], ms[b]) in edge and fits(e, edge[g, ms[a], ms[b]]) for a, b, e in pattern.edges)
            for ms in itertools.permutations(here, len(pattern.vertices))
        )
        assert n % symmetric == 0
        if n:
            out[g] = n // symmetric
    return out


def frames(spark, nodes, edges):
    return (
        spark.createDataFrame(nodes, "g long, n long, label string"),
        spark.createDataFrame(edges, "g long, u long, v long, label string"),
    )


def test_symmetries():
    sizes = [len(pt.symmetries(p)) for p in (ring(None, None, None, None), star("a", "b", "b", "b"), chain("a", "b"), PATTERNS[18])]
    assert sizes == [8, 6, 1, 24]


def test_against_all_maps(spark):
    nodes, edges = random_graphs(0, 60)
    found = pt.pattern_counts(*frames(spark, nodes, edges), PATTERNS).collect()
    got = {}
    for r in found:
        got.setdefault(r.pattern, {})[r.g] = r.n
    for k, pattern in enumerate(PATTERNS):
        assert got.get(k, {}) == brute(nodes, edges, pattern), pattern
    bits = {(r.g, r.bit) for r in pt.pattern_bits(*frames(spark, nodes, edges), PATTERNS).collect()}
    assert bits == {(g, k) for k, counts in got.items() for g, n in counts.items() if n >= PATTERNS[k].least}


def test_hub_is_counted_not_listed(spark):
    d = 3000
    nodes = [(1, 0, "hub")] + [(1, k, "leaf") for k in range(1, d + 1)]
    edges = [e for k in range(1, d + 1) for e in ((1, 0, k, None), (1, k, 0, None))]
    stars = [star("hub", *["leaf"] * k) for k in (1, 2, 3, 5, 8)] + [chain("leaf", None, "leaf"), star(None, None, None, None, None)]
    got = {r.pattern: r.n for r in pt.pattern_counts(*frames(spark, nodes, edges), stars).collect()}
    choose = lambda k: __import__("math").comb(d, k)
    assert got == {0: d, 1: choose(2), 2: choose(3), 3: choose(5), 4: None, 5: choose(2), 6: choose(4)}
    assert {r.bit for r in pt.pattern_bits(*frames(spark, nodes, edges), stars).collect()} == set(range(7))


def test_no_graphs_and_bad_patterns(spark):
    nodes, edges = frames(spark, [], [])
    assert pt.pattern_counts(nodes, edges, PATTERNS).count() == 0
    alone = frames(spark, [(1, 1, "a"), (2, 5, None)], [])
    assert sorted((r.g, r.pattern, r.n) for r in pt.pattern_counts(*alone, PATTERNS[:4]).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
    for bad in (Pattern(("a", "b")), Pattern(("a", "b"), ((0, 1, None), (1, 0, None))), Pattern(("a",), ((0, 0, None),))):
        with pytest.raises(ValueError):
            pt.pattern_counts(*alone, [bad])


def test_edges_are_not_broadcast(spark):
    """Small files of many rows would make hash tables of a hundred bytes a row on the driver."""
    nodes = spark.createDataFrame([(1, n, "A") for n in range(4)], "g long, n int, label string")
    pairs = [(0, 1), (0, 2), (0, 3)]
    edges = spark.createDataFrame([(1, *p, "1") for u, v in pairs for p in ((u, v), (v, u))], "g long, u int, v int, label string")
    found = pt.pattern_counts(nodes, edges, [star("A", "A", "A", "A")])
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 0, 1)]
