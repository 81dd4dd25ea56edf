"""Cores and canonical keys of many small labelled graphs.

Tables are those of ``graph``. All graphs are worked on at once: a round of refinement, of pointer
doubling or of branching is one job over the nodes of all graphs that still need it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.hashing import multiset_digest
from sievework.operators import graph
from sievework.operators.graph import _look_around, by_graph, by_size, meet
from sievework.session import materialize


#: Branches per graph beyond which mirror images among them are looked for.
MANY = 8


def stored(df: DataFrame, name: str) -> DataFrame:
    """``graph.stored``; tables of large graphs are plain files."""
    return graph.stored(df, name) if graph._together.get() else materialize(df, name)


# Cores.


def _pendant(bonds: DataFrame, degree: DataFrame) -> DataFrame:
    """Nodes ``(g, n)`` of all chains that hang off at one end or at both.

    An arrow u -> v leads on to v's other neighbour while v has just two. Every arrow's goal is
    found by pointer doubling, so a chain of length L takes log L rounds. Nodes on a chain with a
    loose end see that end along one of their two arrows.
    """
    loose = degree.filter("d = 1").select("g").distinct()
    here = bonds.join(by_graph(loose), "g", "left_semi").select("g", "u", "v")
    at = lambda n, *more: degree.select("g", F.col("u").alias(n), F.col("d").alias(f"d{n}"), *more)
    sized = here.transform(meet, at("u"), ["g", "u"]).transform(meet, at("v", "low", "high"), ["g", "v"])
    on = F.col("dv") == 2
    arrows = sized.select(
        "g", "u", "v", "du",
        F.when(on, F.col("v")).alias("a"),
        F.when(on, F.when(F.col("low") == F.col("u"), F.col("high")).otherwise(F.col("low"))).alias("b"),
        F.when(~on, F.col("dv") == 1).alias("loose"),
    )
    arrows = stored(arrows, "arrows")
    before = None
    while True:
        open_ = arrows.filter("loose is null")
        left = open_.count()
        # What no round brings to an end goes in circles.
        if left == 0 or left == before:
            break
        before = left
        ahead = arrows.select("g", F.col("u").alias("a"), F.col("v").alias("b"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("loose").alias("then"))
        moved = open_.drop("loose").transform(meet, ahead, ["g", "a", "b"])
        moved = moved.select("g", "u", "v", "du", F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("then").alias("loose"))
        arrows = stored(arrows.filter("loose is not null").unionByName(moved), "arrows")
    chain = arrows.filter("loose and du = 2").select("g", F.col("u").alias("n"))
    return chain.unionByName(degree.filter("d = 1").select("g", F.col("u").alias("n"))).distinct()


def core_edges(edges: DataFrame) -> DataFrame:
    """Edges of rings and of chains between rings; loops of one node are left out.

    Every round takes off all chains with a loose end, whatever their length. What then becomes
    a loose end had two chains or more, so the loose ends of a graph halve from round to round.
    """
    bonds = edges.filter(F.col("u") != F.col("v")).select("g", "u", "v", "label")
    while True:
        degree = bonds.groupBy("g", "u").agg(F.count(F.lit(1)).alias("d"), F.min("v").alias("low"), F.max("v").alias("high"))
        degree = stored(degree, "degrees")
        if degree.filter("d = 1").isEmpty():
            return bonds
        gone = stored(_pendant(bonds, degree), "pendant")
        at = lambda name: gone.select("g", F.col("n").alias(name))
        bonds = stored(bonds.transform(meet, at("u"), ["g", "u"], "left_anti").transform(meet, at("v"), ["g", "v"], "left_anti"), "core")


def _core(nodes: DataFrame, edges: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the core with what is kept, and the edges of the core alone."""
    rings = bonds = core_edges(edges)
    inside = stored(bonds.select("g", F.col("u").alias("n")).distinct(), "inside")
    if keep:
        at = lambda name: inside.select("g", F.col("n").alias(name))
        hanging = edges.filter((F.col("u") != F.col("v")) & F.col("label").isin(*keep))
        hanging = hanging.transform(meet, at("u"), ["g", "u"], "left_semi").transform(meet, at("v"), ["g", "v"], "left_anti")
        hanging = stored(hanging.select("g", "u", "v", "label"), "hanging")
        turned = hanging.select("g", F.col("v").alias("u"), F.col("u").alias("v"), "label")
        bonds = bonds.unionByName(hanging).unionByName(turned)
        inside = inside.unionByName(hanging.select("g", F.col("v").alias("n")))
    return nodes.transform(meet, inside, ["g", "n"], "left_semi"), bonds, rings


@by_size
def core_nodes(nodes: DataFrame, edges: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rings and the chains between them, as nodes and edges.

    ``keep`` names labels of edges, such as double bonds, that stay with the node at their other
    end where they hang off the core. A node without edges is in no core.
    """
    return _core(nodes, edges, keep)[:2]


@by_size
def _keys_of_cores(nodes: DataFrame, edges: DataFrame, keep: Sequence[str]) -> DataFrame:
    return graph_key(*_core(nodes, edges, keep))


def core_keys(
    nodes: DataFrame, edges: DataFrame, own_key: bool = False, keep: Sequence[str] = (),
    core: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Key of every graph's core; ``''`` for graphs without a ring.

    All ringless graphs share the empty key; ``own_key`` gives each a key of its own. ``keep``
    is that of ``core_nodes``, and ``core`` what that returned, where it is there already.
    """
    keys = _keys_of_cores(nodes, edges, keep) if core is None else graph_key(*core)
    none = F.concat(F.lit("#"), F.col("g").cast("string")) if own_key else F.lit("")
    graphs = nodes.select("g").distinct()
    return graphs.join(keys, "g", "left").select("g", F.coalesce("key", none).alias("key"))


# Canonical keys.


def _refined(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node identifiers ``(g, n, id)``, refined per graph until a round tells no more nodes apart
    than the one before, and ``(g, digest, now, nodes)`` of them: their multiset, the number of
    different ones and of all.

    Rounds go on only for graphs that still grew: a few deep graphs do not make the others
    be looked at again. The longest path of a graph bounds its rounds.
    """
    classes = ids.groupBy("g").agg(F.count_distinct("id").alias("before"))
    done, digests = [], []
    while True:
        ids = stored(_look_around(ids, edges), "refined")
        found = ids.groupBy("g").agg(
            F.count_distinct("id").alias("now"), F.count(F.lit(1)).alias("nodes"), multiset_digest(F.col("id")).alias("digest")
        )
        seen = stored(found.join(by_graph(classes), "g"), "classes")
        stable = F.col("now") == F.col("before")
        done.append(ids.join(by_graph(seen.filter(stable).select("g")), "g", "left_semi"))
        digests.append(seen.filter(stable).select("g", "digest", "now", "nodes"))
        classes = seen.filter(~stable).select("g", F.col("now").alias("before"))
        if classes.isEmpty():
            return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, digests)
        ids = ids.join(by_graph(classes.select("g")), "g", "left_semi")


def _marked(id_: Column) -> Column:
    return F.md5(F.concat(id_, F.lit("*")))


def _cells(ids: DataFrame) -> DataFrame:
    """``(g, id)``: the smallest class of several nodes of every graph that has one."""
    sizes = ids.groupBy("g", "id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return sizes.groupBy("g").agg(F.min(F.struct("c", "id")).alias("cell")).select("g", "cell.id")


def _certificates(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(g, cert)``: the edges between identifiers; where all differ, this is the whole graph."""
    at = lambda end: ids.select("g", F.col("n").alias(end), F.col("id").alias(f"i{end}"))
    named = edges.transform(meet, at("u"), ["g", "u"]).transform(meet, at("v"), ["g", "v"])
    text = F.concat_ws("~", "iu", "label", "iv")
    return named.groupBy("g").agg(multiset_digest(text).alias("cert"))


def _first_leaf(ids: DataFrame, digests: DataFrame, edges: DataFrame) -> DataFrame:
    """Certificates ``(g, cert)`` after marking the first node of an ambiguous class until none is left."""
    found = []
    while True:
        ended = digests.filter("now = nodes").select("g")
        found.append(_certificates(ids.join(by_graph(ended), "g", "left_semi"), edges))
        ids = stored(ids.join(by_graph(ended), "g", "left_anti"), "ambiguous")
        if ids.isEmpty():
            return reduce(DataFrame.unionByName, found)
        first = ids.transform(meet, _cells(ids), ["g", "id"], "left_semi").groupBy("g").agg(F.min("n").alias("first"))
        ids = ids.join(by_graph(first), "g").withColumn("id", F.when(F.col("n") == F.col("first"), _marked(F.col("id"))).otherwise(F.col("id")))
        ids, digests = _refined(ids.select("g", "n", "id"), edges)


def _without_mirrors(ids: DataFrame, branches: DataFrame, edges: DataFrame) -> DataFrame:
    """``branches`` without those whose first leaf is also that of another branch of one node."""
    leaves = _first_leaf(ids, branches.select("g", "now", "nodes"), edges)
    named = branches.join(by_graph(leaves), "g")
    first = named.groupBy("parent", "cert").agg(F.min("g").alias("g")).select("g")
    return stored(branches.join(by_graph(first), "g", "left_semi"), "mirrors")


def _canonical(ids: DataFrame, bonds: DataFrame) -> DataFrame:
    """Certificates ``(g, cert)`` of graphs in which refinement leaves nodes alike.

    One node of the smallest ambiguous class is marked and all is refined again, for each node of
    the class in a branch of its own, until all nodes differ; the least certificate is the
    graph's. Of the branches of one node only those with the least multiset of identifiers go
    on. Where they are many, only one goes on of those whose first leaves have one certificate:
    two equal leaves are a symmetry of the graph that takes one branch to the other, so the
    least certificate stays the same.
    """
    graphs = ids.select(F.col("g").alias("graph"), F.col("g").cast("string").alias("g")).distinct()
    ids = ids.select(F.col("g").cast("string").alias("g"), "n", "id")
    found = []
    while True:
        # A branch is a graph of its own, named by the nodes that were marked.
        chosen = ids.transform(meet, _cells(ids), ["g", "id"], "left_semi").select("g", F.col("n").alias("marked"))
        child = F.md5(F.to_json(F.array("g", F.col("marked").cast("string"))))
        branches = stored(chosen.join(by_graph(graphs), "g").select("graph", F.col("g").alias("parent"), "marked", child.alias("g")), "branches")
        parts = ids.withColumnRenamed("g", "parent").join(by_graph(branches), "parent")
        parts = parts.withColumn("id", F.when(F.col("n") == F.col("marked"), _marked(F.col("id"))).otherwise(F.col("id")))
        edges = bonds.withColumnRenamed("g", "graph").join(by_graph(branches), "graph").select("g", "u", "v", "label")
        ids, digests = _refined(parts.select("g", "n", "id"), edges)
        digests = digests.join(by_graph(branches.select("graph", "parent", "g")), "g")
        least = digests.groupBy("parent").agg(F.min("digest").alias("digest"))
        kept = stored(digests.join(by_graph(least), ["parent", "digest"], "left_semi"), "kept")
        ended = kept.filter("now = nodes").select("graph", "g")
        certs = _certificates(ids.join(by_graph(ended), "g", "left_semi"), edges.join(by_graph(ended), "g", "left_semi"))
        found.append(certs.join(by_graph(ended), "g").select("graph", "cert"))
        rest = kept.filter("now < nodes")
        number = rest.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("graph").alias("graphs")).first()
        if not number.rows:
            out = reduce(DataFrame.unionByName, found).groupBy("graph").agg(F.min("cert").alias("cert"))
            return out.withColumnRenamed("graph", "g")
        if number.rows > MANY * number.graphs:
            edges = stored(edges.join(by_graph(rest.select("g")), "g", "left_semi"), "branch-edges")
            rest = _without_mirrors(ids.join(by_graph(rest.select("g")), "g", "left_semi"), rest, edges)
        graphs = rest.select("graph", "g")
        ids = stored(ids.join(by_graph(graphs.select("g")), "g", "left_semi"), "branch")


@by_size
def graph_key(nodes: DataFrame, edges: DataFrame, bonds: DataFrame | None = None) -> DataFrame:
    """Key ``(g, key)`` that is equal exactly for equal graphs, whatever their node numbers.

    Weisfeiler-Lehman refinement tells apart all graphs whose core it resolves: trees, and
    whatever hangs off a core, are known by their identifiers. Where nodes of the core stay
    alike, as in regular graphs, the core's canonical certificate is part of the key. The search
    for it has as many branches as the ambiguous classes have nodes, times the nodes of the
    graph, at every level: large, highly symmetric cores are costly. ``bonds`` are the core's
    edges where they are known.
    """
    ids, digests = _refined(nodes.select("g", "n", F.md5(F.col("label")).alias("id")), edges)
    plain = digests.select("g", F.col("digest").alias("key"))
    doubtful = digests.filter("now < nodes").select("g")
    bonds = core_edges(edges.join(by_graph(doubtful), "g", "left_semi")) if bonds is None else bonds.join(by_graph(doubtful), "g", "left_semi")
    bonds = stored(bonds, "bonds")
    core = bonds.select("g", F.col("u").alias("n")).distinct()
    ids = ids.transform(meet, core, ["g", "n"], "left_semi")
    alike = ids.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("c")).filter("c < n").select("g")
    ids = stored(ids.join(by_graph(alike), "g", "left_semi"), "alike")
    if ids.isEmpty():
        return plain
    certs = _canonical(ids, bonds)
    both = plain.join(by_graph(certs), "g", "left")
    return both.select("g", F.when(F.col("cert").isNull(), F.col("key")).otherwise(F.md5(F.concat_ws("~", "key", "cert"))).alias("key"))
