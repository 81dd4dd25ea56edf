"""Fingerprints and keys of many small labelled graphs.

Tables: ``nodes(g, n, label)`` and ``edges(g, u, v, label)`` with both directions of every
edge and no double edges. Work is keyed by (graph, node), so it spreads over all nodes of all
graphs; neighbourhoods are summarised by digests and counts that are combined on the map
side, never gathered into a list. A hub node or one huge graph therefore fits in no special
way into any task.

Graphs of up to ``SMALL`` rows, which are nearly all where graphs are many, are not taken apart
between steps: all tables of them are kept in buckets of ``g``, so that the same joins and sums
run where the rows lie (``by_size``). Tables made by ``materialize(..., by="g")`` are not moved at all.

Results are long: one row per graph and bit. ``pack`` makes sparse arrays of them.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.hashing import fold, multiset_digest
from sievework.session import materialize


def by_key(df: DataFrame) -> DataFrame:
    """``df``, to be met in a join by shuffle.

    Nodes and edges take some bytes a row in files and a hundred in a hash table. Spark goes by the
    files, and would send tables of a million rows to the driver and from there to all executors.
    """
    return df.hint("merge")


#: Most nodes and edges of a graph that stays in one bucket. Its rows are compared with each other there.
SMALL = 100

#: Whether the graphs at hand are kept in buckets; None outside of ``by_size``.
_together: ContextVar[bool | None] = ContextVar("together", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, in buckets of graphs where these are small."""
    return materialize(df, name, "g" if _together.get() else None)


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on the graph and other columns; rows of small graphs meet where they lie.

    Spark shuffles tables that are kept by ``g`` for a join on more columns. So ``g`` alone is the key
    for these, and the other columns are compared within a graph of at most ``SMALL`` rows.
    """
    if not _together.get():
        return left.join(right, on, how)
    other = right.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns])
    same = F.col("g") == F.col("_g")
    for c in on[1:]:
        # An equality would be one more key.
        same = same & F.col(c).between(F.col(f"_{c}"), F.col(f"_{c}"))
    out = left.join(by_key(other), same, how)
    if how in ("left_semi", "left_anti"):
        return out
    more = [c for c in [*left.columns, *right.columns] if c not in on]
    return out.select(*on, *more)


def by_graph(df: DataFrame) -> DataFrame:
    """``df``, to be met on the graph alone.

    Where graphs are small, such a table has up to a row for every few nodes, but a few bytes of
    each in files: as ``by_key``, and rows that are kept by ``g`` are not moved. Large graphs are few.
    """
    return by_key(df) if _together.get() else df


def _run(together: bool, operator: Callable, *args, **options):
    token = _together.set(together)
    try:
        return operator(*args, **options)
    finally:
        _together.reset(token)


def by_size(operator: Callable) -> Callable:
    """The operator, run on small graphs in buckets and on the others by (graph, node).

    Large graphs are fewer than the rows over ``SMALL``, so their names can be broadcast.
    """

    @wraps(operator)
    def run(nodes: DataFrame, edges: DataFrame, *args, **options):
        if _together.get() is not None:
            return operator(nodes, edges, *args, **options)
        sizes = nodes.select("g").unionByName(edges.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
        large = materialize(sizes.filter(F.col("rows") > SMALL).select("g"), "large")
        if large.isEmpty():
            return _run(True, operator, nodes, edges, *args, **options)
        parts = []
        for together, how in ((True, "left_anti"), (False, "left_semi")):
            part = [t.join(F.broadcast(large), "g", how) for t in (nodes, edges)]
            # Buckets for tables that may have none, so that steps do not move them one by one.
            part = [materialize(t, "part", "g" if together else None) for t in part]
            parts.append(_run(together, operator, *part, *args, **options))
        if isinstance(parts[0], tuple):
            return tuple(a.unionByName(b) for a, b in zip(*parts))
        return parts[0].unionByName(parts[1])

    return run


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws("~", a, b)


def _look_around(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """The next identifiers ``(g, n, id)`` of the nodes in ``ids``."""
    seen = edges.select("g", F.col("u").alias("to"), F.col("v").alias("n"), "label")
    around = (
        seen.transform(meet, ids, ["g", "n"])
        .groupBy("g", F.col("to").alias("n"))
        .agg(multiset_digest(_pair(F.col("label"), F.col("id"))).alias("around"))
    )
    return ids.transform(meet, around, ["g", "n"], "left").select(
        "g", "n", F.md5(_pair(F.col("id"), F.coalesce("around", F.lit("")))).alias("id")
    )


def environments(nodes: DataFrame, edges: DataFrame, rounds: int) -> list[DataFrame]:
    """Node identifiers ``(g, n, id)`` after 0..rounds looks at the neighbours.

    A new identifier digests the old one and the multiset of (edge label, neighbour's old
    identifier).
    """
    ids = nodes.select("g", "n", F.md5(F.col("label")).alias("id"))
    levels = [ids]
    for i in range(rounds):
        ids = _look_around(ids, edges)
        if i + 1 < rounds:
            # Read by the next round and by the result.
            ids = stored(ids, "environments")
        levels.append(ids)
    return levels


@by_size
def circular_bits(nodes: DataFrame, edges: DataFrame, radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """Circular fingerprint: bits ``(g, bit)`` of all environments up to ``radius``."""
    levels = environments(nodes, edges, radius)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("g", fold(F.col("id"), n_bits).alias("bit")).distinct()


# Paths. A path's type is the sequence of its node and edge labels; read from either end it
# is the same path, so the smaller of the two texts names it.


def _name(*parts: Column) -> Column:
    there, back = F.concat_ws("-", *parts), F.concat_ws("-", *reversed(parts))
    return F.least(there, back)


def _typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed edges with the labels of both ends: (g, u, v, lu, e, lv)."""
    at = lambda name, label: nodes.select("g", F.col("n").alias(name), F.col("label").alias(label))
    plain = edges.select("g", "u", "v", F.col("label").alias("e"))
    return plain.transform(meet, by_key(at("u", "lu")), ["g", "u"]).transform(meet, by_key(at("v", "lv")), ["g", "v"])


def _triangles(typed: DataFrame) -> DataFrame:
    """Ordered triangles (g, b, c, la, eab, eac): edge b -> c with a common neighbour a.

    Edges point from the end with fewer neighbours to the other, which bounds the wedges
    that have to be tried even around a hub.
    """
    degree = typed.groupBy("g", F.col("u").alias("x")).agg(F.count(F.lit(1)).alias("d"))
    # A node of degree one is in no triangle.
    degree = degree.filter(F.col("d") > 1)
    pick = lambda n: degree.select("g", F.col("x").alias(n), F.col("d").alias(f"d{n}"))
    sized = typed.transform(meet, pick("u"), ["g", "u"]).transform(meet, pick("v"), ["g", "v"])
    up = sized.filter(
        F.struct(F.col("du"), F.col("u").cast("string")) < F.struct(F.col("dv"), F.col("v").cast("string"))
    )
    one = up.select("g", F.col("u").alias("x"), F.col("v").alias("y"), F.col("lu").alias("lx"),
                    F.col("lv").alias("ly"), F.col("e").alias("exy"))
    two = up.select("g", F.col("u").alias("x"), F.col("v").alias("z"), F.col("lv").alias("lz"),
                    F.col("e").alias("exz"))
    last = typed.select("g", F.col("u").alias("y"), F.col("v").alias("z"), F.col("e").alias("eyz"))
    # Every wedge is taken once (y before z) and closed by an equi-join.
    wedge = one.transform(meet, two, ["g", "x"]).filter(F.col("y").cast("string") < F.col("z").cast("string"))
    found = wedge.transform(meet, last, ["g", "y", "z"])
    turns = [
        ("x", "y", "lz", "exz", "eyz"), ("y", "x", "lz", "eyz", "exz"),
        ("x", "z", "ly", "exy", "eyz"), ("z", "x", "ly", "eyz", "exy"),
        ("y", "z", "lx", "exy", "exz"), ("z", "y", "lx", "exz", "exy"),
    ]
    names = ("b", "c", "la", "eab", "eac")
    rows = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(t, names)]) for t in turns])
    return found.select("g", F.explode(rows).alias("r")).select("g", "r.*")


@by_size
def path_counts(nodes: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """Number of simple paths of ``length`` edges per type: (g, path, n).

    Paths of up to three edges are counted, not listed. A node's neighbours are summarised by how many there are
    of each (edge label, node label); a path of two edges joins two entries of the middle
    node's summary, one of three edges joins the summaries of both ends of its middle edge,
    less the combinations that would use a node twice. A hub with millions of neighbours has
    as many entries as there are label pairs. Longer paths are walked edge by edge, so work
    grows with their number.
    """
    _check_length(length)
    typed = stored(_typed_edges(nodes, edges), "typed")
    if length <= 3:
        return _count_paths(nodes, typed, length)
    walks = _walks(typed, length)[-1]
    return _sum_paths(walks.select("g", _walk_name().alias("path"), F.lit(1).alias("w")))


def _check_length(length: int) -> None:
    if length < 1:
        raise ValueError("length must be at least 1")


def _walk_name() -> Column:
    back = F.concat_ws("-", F.reverse("parts"))
    return F.least(F.concat_ws("-", "parts"), back)


def _walks(typed: DataFrame, length: int) -> list[DataFrame]:
    """Simple paths of 4..length edges, read from both ends: (g, end, seen, parts).

    ``seen`` are the nodes, ``parts`` the labels of nodes and edges on the way. Each length
    goes on from the one before, which is kept in the shared folder.
    """
    walks = typed.select(
        "g", F.col("v").alias("end"), F.array("u", "v").alias("seen"), F.array("lu", "e", "lv").alias("parts")
    )
    step = typed.select("g", F.col("u").alias("end"), F.col("v").alias("to"), "e", "lv")
    out = []
    for i in range(2, length + 1):
        walks = walks.transform(meet, step, ["g", "end"]).filter(~F.array_contains("seen", F.col("to"))).select(
            "g", F.col("to").alias("end"), F.array_append("seen", F.col("to")).alias("seen"),
            F.concat("parts", F.array("e", "lv")).alias("parts"),
        )
        walks = stored(walks, "walks")
        if i > 3:
            out.append(walks)
    return out


def _few_twins(nodes: DataFrame, typed: DataFrame, length: int) -> DataFrame:
    """Typed edges without twins that no path of ``length`` edges needs.

    Nodes with one label and the same neighbours by the same edges are interchangeable, and
    a path has ``length + 1`` nodes: so many twins give every type of path that all give.
    """
    around = typed.groupBy("g", F.col("u").alias("n"), F.col("lu").alias("label")).agg(
        multiset_digest(_pair(F.col("e"), F.col("v").cast("string"))).alias("around")
    )
    # Salted, so that the twins around a hub are ranked in many tasks first.
    salted = around.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(256)))
    group = ["g", "label", "around"]
    first = lambda df, by: df.withColumn(
        "r", F.row_number().over(Window.partitionBy(*by).orderBy("n"))
    ).filter(F.col("r") <= length + 1).drop("r")
    kept = stored(first(first(salted, [*group, "salt"]), group).select("g", "n"), "twins")
    return typed.transform(meet, kept.withColumnRenamed("n", "u"), ["g", "u"], "left_semi").transform(meet, 
        kept.withColumnRenamed("n", "v"), ["g", "v"], "left_semi"
    )


def _count_paths(nodes: DataFrame, typed: DataFrame, length: int) -> DataFrame:
    if length == 1:
        named = typed.select("g", _name(F.col("lu"), F.col("e"), F.col("lv")).alias("path"))
        # Both directions are in the table.
        return named.groupBy("g", "path").agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n"))
    around = typed.groupBy("g", "u", "lu", "e", "lv").agg(F.count(F.lit(1)).alias("c"))
    side = lambda tag, at: around.select(
        "g", F.col("u").alias(at), F.col("e").alias(f"e{tag}"), F.col("lv").alias(f"l{tag}"),
        F.col("c").alias(f"c{tag}"),
    )
    if length == 2:
        centre = nodes.select("g", F.col("n").alias("u"), F.col("label").alias("lu"))
        both = side("1", "u").transform(meet, side("2", "u"), ["g", "u"]).transform(meet, centre, ["g", "u"])
        same = (F.col("e1") == F.col("e2")) & (F.col("l1") == F.col("l2"))
        # Ordered pairs of different neighbours; halved, as each path is seen from both ends.
        ways = F.col("c1") * (F.col("c2") - F.when(same, 1).otherwise(0))
        path = _name(F.col("l1"), F.col("e1"), F.col("lu"), F.col("e2"), F.col("l2"))
        return _sum_paths(both.select("g", path.alias("path"), ways.alias("w")))
    middle = typed.select(
        "g", F.col("u").alias("b"), F.col("v").alias("c"), F.col("lu").alias("lb"),
        F.col("e").alias("ebc"), F.col("lv").alias("lc"),
    )
    # Without the other end of the middle edge itself.
    is_c = (F.col("e1") == F.col("ebc")) & (F.col("l1") == F.col("lc"))
    is_b = (F.col("e2") == F.col("ebc")) & (F.col("l2") == F.col("lb"))
    walks = (
        middle.transform(meet, side("1", "b"), ["g", "b"])
        .transform(meet, side("2", "c"), ["g", "c"])
        .withColumn(
            "w",
            (F.col("c1") - F.when(is_c, 1).otherwise(0)) * (F.col("c2") - F.when(is_b, 1).otherwise(0)),
        )
        .filter(F.col("w") > 0)
    )
    path = _name(*[F.col(c) for c in ("l1", "e1", "lb", "ebc", "lc", "e2", "l2")])
    # In a triangle both outer ends can be the same node: no path.
    closed = _triangles(typed).transform(meet, middle, ["g", "b", "c"]).select(
        "g",
        _name(*[F.col(c) for c in ("la", "eab", "lb", "ebc", "lc", "eac", "la")]).alias("path"),
        F.lit(-1).cast("bigint").alias("w"),
    )
    return _sum_paths(walks.select("g", path.alias("path"), "w").unionByName(closed))


def _sum_paths(rows: DataFrame) -> DataFrame:
    n = (F.sum("w") / 2).cast("bigint")
    return rows.groupBy("g", "path").agg(n.alias("n")).filter(F.col("n") > 0)


@by_size
def path_bits(nodes: DataFrame, edges: DataFrame, length: int = 3, n_bits: int = 2048) -> DataFrame:
    """Path fingerprint: bits ``(g, bit)`` of all simple paths of up to ``length`` edges."""
    _check_length(length)
    typed = stored(_typed_edges(nodes, edges), "typed")
    out = nodes.select("g", F.col("label").alias("path"))
    for i in range(1, min(length, 3) + 1):
        out = out.unionByName(_count_paths(nodes, typed, i).select("g", "path"))
    if length > 3:
        for walks in _walks(stored(_few_twins(nodes, typed, length), "few"), length):
            out = out.unionByName(walks.select("g", _walk_name().alias("path")))
    return out.select("g", fold(F.col("path"), n_bits).alias("bit")).distinct()


@by_size
def torsion_counts(nodes: DataFrame, edges: DataFrame, n_bits: int = 2048) -> DataFrame:
    """Paths of four nodes counted per bit: ``(g, bit, n)``."""
    paths = path_counts(nodes, edges, 3)
    return paths.groupBy("g", fold(F.col("path"), n_bits).alias("bit")).agg(F.sum("n").alias("n"))


def node_distances(nodes: DataFrame, edges: DataFrame, reach: int) -> DataFrame:
    """Shortest distances 1..reach between nodes of a graph: (g, u, v, d), both directions.

    Breadth-first from every node at once: each round moves the outermost pairs on by one
    edge and keeps those not met before. Rounds are kept in the shared folder, so the plan
    grows by one scan a round.
    """
    steps = stored(edges.select("g", "u", "v").distinct(), "steps")
    known = steps.filter(F.col("u") != F.col("v")).withColumn("d", F.lit(1))
    outer = known
    for d in range(2, reach + 1):
        moved = (
            outer.select("g", "u", F.col("v").alias("m"))
            .transform(meet, steps.select("g", F.col("u").alias("m"), "v"), ["g", "m"])
            .filter(F.col("u") != F.col("v"))
            .select("g", "u", "v")
            .distinct()
        )
        outer = moved.transform(meet, known, ["g", "u", "v"], "left_anti").withColumn("d", F.lit(d))
        outer = stored(outer, "distances")
        known = known.unionByName(outer)
    return known


def _without_twins(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold nodes of one label with exactly the same neighbours into one.

    Twins are two steps apart and equally far from everything else, so one of them stands
    for all: the million leaves around a hub are one node per label. Returns the folded
    nodes and edges, and the labels ``(g, label)`` of nodes that have a twin.
    """
    around = edges.groupBy("g", F.col("u").alias("n")).agg(
        multiset_digest(F.col("v").cast("string")).alias("around")
    )
    known = nodes.transform(meet, around, ["g", "n"])
    sets = known.groupBy("g", "label", "around").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c"))
    kept = stored(sets.select("g", "n", "label", "c"), "twins")
    ends = kept.select("g", "n")
    folded = edges.transform(meet, ends.withColumnRenamed("n", "u"), ["g", "u"], "left_semi").transform(meet, 
        ends.withColumnRenamed("n", "v"), ["g", "v"], "left_semi"
    )
    return kept.drop("c"), folded, kept.filter("c > 1").select("g", "label")


@by_size
def pair_bits(nodes: DataFrame, edges: DataFrame, reach: int = 3, n_bits: int = 2048) -> DataFrame:
    """Node-pair fingerprint: bits ``(g, bit)`` of (label, distance, label)."""
    nodes, edges, doubled = _without_twins(nodes, edges)
    edges = stored(edges, "folded")
    at = lambda name, label: nodes.select("g", F.col("n").alias(name), F.col("label").alias(label))
    pairs = (
        node_distances(nodes, edges, reach)
        .transform(meet, at("u", "lu"), ["g", "u"])
        .transform(meet, at("v", "lv"), ["g", "v"])
        .select("g", "lu", "d", "lv")
    )
    if reach > 1:
        pairs = pairs.unionByName(
            doubled.select("g", F.col("label").alias("lu"), F.lit(2).alias("d"), F.col("label").alias("lv"))
        )
    feature = F.concat_ws("-", F.least("lu", "lv"), F.col("d").cast("string"), F.greatest("lu", "lv"))
    return pairs.select("g", fold(feature, n_bits).alias("bit")).distinct()


def pack(bits: DataFrame) -> DataFrame:
    """Long bits to one sorted array per graph, of at most ``n_bits`` entries."""
    return bits.groupBy("g").agg(F.array_sort(F.collect_set("bit")).alias("fp"))


def pack_counts(counts: DataFrame) -> DataFrame:
    """Long counts to one map per graph, of at most ``n_bits`` entries."""
    entries = F.array_sort(F.collect_list(F.struct("bit", "n")))
    return counts.groupBy("g").agg(F.map_from_entries(entries).alias("fp"))
