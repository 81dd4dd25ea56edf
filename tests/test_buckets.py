"""Small graphs are worked on where they lie; large ones give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import graph, keys
from sievework.session import materialize


def graphs_of(spark):
    """Graphs of 1 to 12 nodes, some with rings, loose ends and twins."""
    rng, nodes, edges = random.Random(5), [], []
    for g in range(40):
        size = 1 + g % 12
        nodes += [(g, n, rng.choice("AB")) for n in range(size)]
        ways = {tuple(sorted(rng.sample(range(size), 2))) for _ in range(size + 1)} if size > 1 else set()
        edges += [(g, a, b, "12"[(u + v) % 2]) for u, v in ways for a, b in ((u, v), (v, u))]
    return (
        spark.createDataFrame(nodes, "g long, n int, label string"),
        spark.createDataFrame(edges, "g long, u int, v int, label string"),
    )


OPERATORS = {
    "circular": lambda n, e: graph.circular_bits(n, e),
    "paths": lambda n, e: graph.path_bits(n, e, 3),
    "long paths": lambda n, e: graph.path_bits(n, e, 5),
    "torsions": lambda n, e: graph.torsion_counts(n, e),
    "pairs": lambda n, e: graph.pair_bits(n, e),
    "graph keys": lambda n, e: keys.graph_key(n, e),
    "core keys": lambda n, e: keys.core_keys(n, e, own_key=True, keep=["2"]),
    "cores": lambda n, e: keys.core_nodes(n, e, keep=["2"])[1],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_small_and_large_graphs_agree(spark, monkeypatch, name):
    nodes, edges = graphs_of(spark)
    rows = lambda: sorted(map(tuple, OPERATORS[name](nodes, edges).collect()), key=str)
    monkeypatch.setattr(graph, "SMALL", 0)
    large = rows()
    assert large
    # Some of the graphs.
    monkeypatch.setattr(graph, "SMALL", 20)
    assert rows() == large


def test_known_core_gives_the_same_keys(spark):
    nodes, edges = graphs_of(spark)
    core = keys.core_nodes(nodes, edges, keep=["2"])
    known = keys.core_keys(nodes, edges, keep=["2"], core=core)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, keys.core_keys(nodes, edges, keep=["2"]).collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_tables_kept_by_graph_are_not_moved(spark):
    nodes, edges = (materialize(t, "kept", "g") for t in graphs_of(spark))
    looked = graph._run(True, graph.environments, nodes, edges, 1)[-1]
    assert shuffles(looked) == 0
    # What is left is to make the bits distinct.
    assert shuffles(graph.circular_bits(nodes, edges)) <= 1
    assert looked.filter(F.col("id").isNull()).isEmpty()
