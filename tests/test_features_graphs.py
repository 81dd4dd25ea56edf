import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import features as ft
from sievework.functions.hashing import stable_hash
from sievework.operators import dedup, graph, similarity
from sievework.operators import keys as keys_of
from sievework.operators import reduce as rd


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_exact_weight(spark):
    # Formulas of small organic compounds with known exact masses.
    known = {
        "InChI=1S/C11H9N3/c12-10-6/h1-6H": 183.0796,
        "InChI=1S/C2H4O/c1-2-3/h2H,1H3": 44.0262,
        "InChI=1S/C4H8N2O/c1-3-5-6(2)4-7/h3-4H,1-2H3/b5-3+": 100.0637,
    }
    for text, mass in known.items():
        assert one(spark, ft.exact_weight(F.lit(text))) == pytest.approx(mass, abs=1e-4)
    for bad in ("CCO", "InChI=1S/C2H4O.ClH/c1", "InChI=1S/C2H4O/q+1", "InChI=1S/Xx2/c1", None):
        assert one(spark, ft.exact_weight(F.lit(bad).cast("string"))) is None


def test_null_and_junk_text_have_no_fingerprint(spark):
    for text in (None, "", "123 !!"):
        assert one(spark, ft.text_fingerprint(F.lit(text).cast("string"))) is None
    assert one(spark, F.size(ft.shingles(F.lit("one two")))) == 1
    assert one(spark, ft.shingles(F.lit("A b c d"))) == ["a b c", "b c d"]


def test_bit_text_round_trip(spark):
    text = "0110010"
    assert one(spark, ft.to_bit_text(ft.from_bit_text(F.lit(text)))) == text
    assert one(spark, ft.to_sparse(ft.from_bit_text(F.lit(text)))) == [1, 2, 5]
    assert one(spark, ft.to_bit_text(ft.to_dense(F.lit([1, 2, 5]), 7))) == text
    assert one(spark, ft.from_bit_text(F.lit("01x"))) is None


def test_tanimoto_is_symmetric_and_bounded(spark):
    a, b = F.lit([1, 2, 3]), F.lit([2, 3, 4, 5])
    assert one(spark, ft.tanimoto(a, b)) == one(spark, ft.tanimoto(b, a)) == pytest.approx(0.4)
    empty = F.array().cast("array<int>")
    assert one(spark, ft.tanimoto(empty, empty)) == 1.0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_against_brute_force(spark, least):
    r = random.Random(11)
    base = [sorted(r.sample(range(60), r.randint(1, 15))) for _ in range(60)]
    near = [sorted(set(s) ^ {r.randrange(60)}) or [1] for s in base]
    sets = base + near + [base[0]] * 70  # a third are copies of one
    df = spark.createDataFrame(list(enumerate(sets)), "id bigint, fp array<int>")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {
        (min(i, j), max(i, j))
        for (a, i), (b, j) in itertools.combinations(first.items(), 2)
        if jaccard(a, b) >= least
    }
    got = similarity.similar_pairs(df, "id", "fp", least).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    copies = similarity.distinct_fingerprints(df, "id", "fp").filter("id = 0").first()["copies"]
    assert copies == sum(s == sets[0] for s in sets)


def random_sets(seed=5):
    """Families of near copies with shared common bits, and one set a third of the rows hold."""
    r = random.Random(seed)
    sets = []
    for _ in range(60):
        base = r.sample(range(100, 2**31 - 1), 60) + r.sample(range(100), 20)
        for _ in range(4):
            sets.append(sorted({t for t in base if r.random() < 0.9} | {r.randrange(100, 2**31 - 1)}))
    return sets + [sets[0]] * (len(sets) // 2)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_sampled_pairs_are_exact_and_nearly_all(spark, least):
    """Found pairs are pairs of the exact join with the same similarity, nearly all of them."""
    df = spark.createDataFrame(list(enumerate(random_sets())), "id bigint, fp array<int>")
    exact = similarity.similar_pairs(df, "id", "fp", least)
    found = similarity.similar_pairs_sampled(df, "id", "fp", least, recall=0.99)
    want = {(r["a"], r["b"]): r["tanimoto"] for r in exact.collect()}
    got = {(r["a"], r["b"]): r["tanimoto"] for r in found.collect()}
    assert got.items() <= want.items()
    assert len(got) >= 0.95 * len(want)
    if want:
        total = similarity.recall_by_similarity(exact, found, least).filter("tenth is null").first()
        assert (total["pairs"], total["found"]) == (len(want), len(got))


def test_sets_of_a_family_are_sent_once(spark, monkeypatch):
    """Checked pairs carry no sets: a set goes to each tile of its family once, whatever the tiles."""
    r = random.Random(4)
    base = [r.sample(range(2**31 - 1), 40) for _ in range(3)]
    sets = [sorted(set(s[: 40 - i % 9]) | {r.randrange(2**31 - 1)}) for s in base for i in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id bigint, fp array<int>")
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j): jaccard(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if jaccard(a, b) >= 0.5}
    assert len(want) > 5000
    for pairs_a_tile in (similarity.TILE_PAIRS, 300):
        monkeypatch.setattr(similarity, "TILE_PAIRS", pairs_a_tile)
        for join in (similarity.similar_pairs, similarity.similar_pairs_sampled):
            out = join(df, "id", "fp", 0.5)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "array_intersect" not in plan and "a_bits" not in plan
            got = {(x["a"], x["b"]): x["tanimoto"] for x in out.collect()}
            assert got == want if join is similarity.similar_pairs else got.items() <= want.items() and len(got) > 0.98 * len(want)


def test_pairs_of_few_common_bits_are_not_checked(spark, monkeypatch):
    """Sets that share just three first bits are no candidates; a pair that needs few bits still is."""
    r = random.Random(8)
    # Bits lie in their own order, as where more than these are common.
    monkeypatch.setattr(similarity, "COMMON_BITS", 0)
    sets = [sorted({1, 2, 3, *r.sample(range(100, 2**31 - 1), 60)}) for _ in range(40)]
    sets += [sorted({*sets[0][:50], 17, 18}), [11, 12, 13], [11, 12, 14], [21], [22, 23, 24, 25], [22, 23, 24, 26]]
    df = spark.createDataFrame(list(enumerate(sets)), "id bigint, fp array<int>")
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j): jaccard(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if jaccard(a, b) >= 0.5}
    asked, checked = [], similarity._checked
    monkeypatch.setattr(similarity, "_checked", lambda met, *more: asked.append(met.count()) or checked(met, *more))
    got = {(x["a"], x["b"]): x["tanimoto"] for x in similarity.similar_pairs(df, "id", "fp", 0.5).collect()}
    assert got == want and len(want) == 3
    assert asked[0] < 10


@pytest.mark.parametrize("least", [0.1, 0.5, 0.8])
def test_first_bits_meet_in_rounds(spark, monkeypatch, least):
    """Cut into rounds or not, the exact join finds the pairs of all pairs; shuffles are given back."""
    sets = random_sets(9)[:150]
    df = spark.createDataFrame(list(enumerate(sets)), "id bigint, fp array<int>")
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j): jaccard(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if jaccard(a, b) >= least}
    stored, names = similarity.materialize, []

    def noted(frame, name="table"):
        out = stored(frame, name)
        names.append(name)
        return out

    monkeypatch.setattr(similarity, "materialize", noted)
    for bits in (similarity.ROUND_BITS, 1):
        monkeypatch.setattr(similarity, "ROUND_BITS", bits)
        got = {(x["a"], x["b"]): x["tanimoto"] for x in similarity.similar_pairs(df, "id", "fp", least).collect()}
        assert got == want
    assert names.count("meetings") == similarity.ROUNDS


def test_sets_are_folded_once_for_both_joins(spark):
    df = spark.createDataFrame(list(enumerate(random_sets(3))), "id bigint, fp array<int>")
    sets = similarity.fold_sets(df, "id", "fp")
    for join in (similarity.similar_pairs, similarity.similar_pairs_sampled):
        rows = lambda out: sorted((x["a"], x["b"], x["tanimoto"]) for x in out.collect())
        assert rows(join(df, "id", "fp", 0.5)) == rows(join(df, "id", "fp", 0.5, sets=sets))


def test_sampled_index_has_a_row_per_table(spark):
    """Rows follow the sets, not their bits; the same set gets the same buckets anywhere."""
    sets = spark.createDataFrame([(1, [5, 9]), (2, list(range(400))), (3, [5, 9])], "k bigint, fp array<int>")
    tables = similarity.table_count(0.5, 0.99, 3)
    index = similarity.sampled_index(sets, "fp", tables, 3)
    assert tables == 35 and index.count() == 3 * tables
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    # The same remainders as by plain division, whatever is worked out at once.
    split = similarity.sampled_index(sets.repartition(1), "fp", 1, 1).collect()
    (a, b), values = similarity.orders(1)[0], {1: [5, 9], 2: range(400), 3: [5, 9]}
    least = {k: min((t * a + b) % similarity.PRIME for t in v) for k, v in values.items()}
    for x, y in itertools.combinations(split, 2):
        assert (x["bucket"] == y["bucket"]) == (least[x["k"]] == least[y["k"]])
    assert {r["k"]: r["size"] for r in split} == {1: 2, 2: 400, 3: 2}
    places = {k: [r["bucket"] for r in index.collect() if r["k"] == k] for k in (1, 2, 3)}
    assert places[1] == places[3] != places[2]


def test_sampled_pairs_without_sets(spark):
    """Null and empty sets are in no pair, an empty table has none; bad parameters are refused."""
    kind = "id bigint, fp array<int>"
    df = spark.createDataFrame([(1, None), (2, []), (3, [7]), (4, None), (5, []), (6, [7]), (7, [None])], kind)
    assert similarity.similar_pairs_sampled(df, "id", "fp", 0.5).count() == 0
    assert similarity.similar_pairs_sampled(df.limit(0), "id", "fp", 0.5).count() == 0
    for least, recall, per_table in [(0.0, 0.9, 2), (0.5, 1.0, 2), (0.5, 0.9, 0)]:
        with pytest.raises(ValueError):
            similarity.table_count(least, recall, per_table)


def test_duplicates_keep_the_first_row(spark):
    rows = [(3, "a", 1), (1, "a", 1), (2, "a", 0), (5, None, 1), (4, None, 1), (6, "b", None)]
    df = spark.createDataFrame(rows, "id bigint, f string, y int")
    got = dedup.remove_duplicates(df, "id", ["f", "y"]).collect()
    assert {r["id"] for r in got} == {1, 2, 4, 6}
    assert {r["id"] for r in dedup.prepare_task(df, "id", ["f"], "y").collect()} == {1, 2, 4}


def test_projection_and_compression_keep_nulls(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, -i / 2]) for i in range(20)] + [(99, None)], "id bigint, v array<double>")
    projected = df.select("id", rd.sign_projection(3, 2)(F.col("v")).alias("c")).toPandas().set_index("id")["c"]
    assert projected[99] is None and len(projected[3]) == 2
    out = rd.compress(df, rd.fit_compressor(df, "v", 2), "v").toPandas().set_index("id")["fpcompressed"]
    assert out[99] is None and len(out[3]) == 2


# Graphs


def random_graphs(seed=2):
    r = random.Random(seed)
    graphs = {}
    for g in range(12):
        n = r.randint(2, 8)
        nodes = {i: r.choice("CNO") for i in range(n)}
        pairs = [p for p in itertools.combinations(range(n), 2) if r.random() < 0.4]
        graphs[g] = (nodes, {p: r.choice("12") for p in pairs})
    # A hub with many leaves.
    graphs[100] = ({i: "C" if i else "N" for i in range(40)}, {(0, i): "1" for i in range(1, 40)})
    return graphs


def tables(spark, graphs):
    nodes = [(g, n, lab) for g, (ns, _) in graphs.items() for n, lab in ns.items()]
    edges = [(g, a, b, e) for g, (_, es) in graphs.items() for (x, y), e in es.items() for a, b in ((x, y), (y, x))]
    return (
        spark.createDataFrame(nodes, "g bigint, n int, label string"),
        spark.createDataFrame(edges, "g bigint, u int, v int, label string"),
    )


def neighbours(es):
    out = {}
    for (a, b), e in es.items():
        out.setdefault(a, {})[b] = e
        out.setdefault(b, {})[a] = e
    return out


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
def test_path_counts_against_enumeration(spark, length):
    graphs, want = random_graphs(), {}
    for g, (ns, es) in graphs.items():
        near = neighbours(es)
        paths = [[n] for n in near]
        for _ in range(length):
            paths = [p + [m] for p in paths for m in near[p[-1]] if m not in p]
        for p in paths:
            parts = [ns[p[0]]]
            for a, b in zip(p, p[1:]):
                parts += [near[a][b], ns[b]]
            name = min("-".join(parts), "-".join(reversed(parts)))
            want[g, name] = want.get((g, name), 0) + 0.5
    got = {(r["g"], r["path"]): r["n"] for r in graph.path_counts(*tables(spark, graphs), length).collect()}
    assert got == want


def test_pair_bits_against_search(spark):
    graphs, want = random_graphs(), set()
    for g, (ns, es) in graphs.items():
        near = neighbours(es)
        for s in near:
            far, ring = {s: 0}, [s]
            while ring:
                nxt = [m for x in ring for m in near[x] if m not in far]
                for m in nxt:
                    far.setdefault(m, max(far[x] for x in ring) + 1)
                ring = list(dict.fromkeys(nxt))
            for t, d in far.items():
                if 1 <= d <= 3:
                    a, b = sorted((ns[s], ns[t]))
                    want.add((g, f"{a}-{d}-{b}"))
    names = spark.createDataFrame(sorted(want), "g bigint, f string")
    bits = names.select("g", F.pmod(stable_hash(F.col("f")), F.lit(2**20)).cast("int").alias("bit"))
    got = graph.pair_bits(*tables(spark, graphs), reach=3, n_bits=2**20)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in bits.collect()}


def test_keys_do_not_depend_on_node_numbers(spark):
    graphs = random_graphs()
    turned = {}
    for g, (ns, es) in graphs.items():
        new = {n: 1000 - 3 * n for n in ns}
        turned[g] = (
            {new[n]: lab for n, lab in ns.items()},
            {(new[b], new[a]): e for (a, b), e in es.items()},
        )
    key = lambda gs: {r["g"]: r["key"] for r in keys_of.graph_key(*tables(spark, gs)).collect()}
    assert key(graphs) == key(turned)
    bits = lambda gs: {tuple(r) for r in graph.circular_bits(*tables(spark, gs)).collect()}
    assert bits(graphs) == bits(turned)


def test_core_is_the_part_without_loose_ends(spark):
    graphs, want = random_graphs(), set()
    for g, (ns, es) in graphs.items():
        near = {a: set(b) for a, b in neighbours(es).items()}
        while loose := [n for n, m in near.items() if len(m) <= 1]:
            for n in loose:
                for m in near.pop(n, ()):
                    near.get(m, set()).discard(n)
        want |= {(g, n) for n in near}
    nodes, edges = tables(spark, graphs)
    core, _ = keys_of.core_nodes(nodes, edges)
    assert {(r["g"], r["n"]) for r in core.collect()} == want
    keys = {r["g"]: r["key"] for r in keys_of.core_keys(nodes, edges).collect()}
    assert {g for g, k in keys.items() if k == ""} == set(graphs) - {g for g, _ in want}
    own = [r["key"] for r in keys_of.core_keys(nodes, edges, own_key=True).collect()]
    assert "" not in own


def test_key_tells_marks_far_apart(spark):
    """Two chains that differ only in places many edges from each other."""
    chain = lambda marks: ({n: "x" if n in marks else "o" for n in range(24)}, {(n, n + 1): "1" for n in range(23)})
    graphs = {1: chain({6, 14}), 2: chain({6, 15}), 3: chain({9, 17}), 4: ({0: "o"}, {})}
    keys = {r["g"]: r["key"] for r in keys_of.graph_key(*tables(spark, graphs)).collect()}
    # The third is the first read from its other end.
    assert keys[1] == keys[3] and len(set(keys.values())) == 3
    none = keys_of.graph_key(*(t.limit(0) for t in tables(spark, graphs)))
    assert none.columns == ["g", "key"] and none.count() == 0


def test_long_paths_through_twins(spark):
    """A hub with equal leaves, on a tail: twins that no path needs are left out."""
    leaves = {n: "c" for n in range(10, 40)}
    graphs = {1: ({0: "h", 1: "a", 2: "b", 3: "d", **leaves}, {(0, 1): "1", (1, 2): "2", (2, 3): "1", **{(0, n): "1" for n in leaves}})}
    nodes, edges = tables(spark, graphs)
    want = {r["path"] for i in range(1, 6) for r in graph.path_counts(nodes, edges, i).collect()} | {"h", "a", "b", "c", "d"}
    names = spark.createDataFrame([(p,) for p in want], "f string")
    bits = names.select(F.pmod(stable_hash(F.col("f")), F.lit(2**20)).cast("int"))
    got = graph.path_bits(nodes, edges, length=5, n_bits=2**20).select("bit")
    assert {r[0] for r in got.collect()} == {r[0] for r in bits.collect()}
    with pytest.raises(ValueError):
        graph.path_bits(nodes, edges, length=0)


def same_graph(a, b):
    """Whether some renumbering takes one graph to the other."""
    (na, ea), (nb, eb) = a, b
    if sorted(na.values()) != sorted(nb.values()) or len(ea) != len(eb):
        return False
    there = {frozenset(e): x for e, x in eb.items()}
    names = list(na)
    for image in itertools.permutations(nb):
        to = dict(zip(names, image))
        if all(na[n] == nb[to[n]] for n in names) and all(there.get(frozenset((to[u], to[v]))) == x for (u, v), x in ea.items()):
            return True
    return False


def ring_graph(n, *more, label="x", first=0):
    edges = {(first + i, first + (i + 1) % n): "1" for i in range(n)} | {(first + a, first + b): "1" for a, b in more}
    return {first + i: label for i in range(n)}, edges


def joined(*graphs):
    return {n: x for g in graphs for n, x in g[0].items()}, {e: x for g in graphs for e, x in g[1].items()}


@pytest.mark.parametrize("many", [0, 8])
def test_key_tells_regular_graphs_apart(spark, monkeypatch, many):
    monkeypatch.setattr(keys_of, "MANY", many)
    cubic = [
        ring_graph(8, (0, 4), (1, 5), (2, 6), (3, 7)),
        ring_graph(8, (0, 2), (1, 3), (4, 6), (5, 7)),
        ring_graph(8, (0, 3), (1, 6), (2, 5), (4, 7)),
        ring_graph(8, (0, 4), (1, 3), (2, 6), (5, 7)),
        ring_graph(8, (0, 5), (1, 4), (2, 7), (3, 6)),
    ]
    rings = [ring_graph(6), joined(ring_graph(3), ring_graph(3, first=3)), joined(ring_graph(3), ring_graph(4, first=3)), ring_graph(7), ring_graph(3), joined(ring_graph(3), ({9: "x"}, {}))]
    small = []
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randint(4, 7)
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        small.append(({i: "x" for i in range(n)}, {p: rng.choice("11112") for p in pairs}))
    first = [*cubic, *rings, *small]
    graphs = dict(enumerate(first))
    for k, (ns, es) in enumerate(first):
        order = list(ns)
        rng.shuffle(order)
        to = {n: 50 + order.index(n) for n in ns}
        graphs[1000 + k] = {to[n]: x for n, x in ns.items()}, {(to[v], to[u]): x for (u, v), x in es.items()}
    got = {r["g"]: r["key"] for r in keys_of.graph_key(*tables(spark, graphs)).collect()}
    for k in range(len(first)):
        assert got[k] == got[1000 + k], k
    for a, b in itertools.combinations(range(len(first)), 2):
        assert (got[a] == got[b]) == same_graph(first[a], first[b]), (a, b)


def test_keys_of_small_graphs_send_no_table_to_the_driver(spark, monkeypatch):
    """However few bytes tables of graphs take in files, none of their joins is by broadcast."""
    ring = {(i, (i + 1) % 6): "1" for i in range(6)}
    cube = {(a, b): "1" for a in range(8) for b in range(8) if a < b and bin(a ^ b).count("1") == 1}
    path = {(0, 1): "1", (1, 2): "1", (2, 3): "1"}
    shapes = [ring, cube, path, {**ring, (0, 6): "1"}, {**path, (3, 1): "1"}]
    graphs = {g: ({n: "x" for e in es for n in e}, es) for g, es in enumerate(shapes * 3)}
    plans, whole = [], graph.materialize
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "materialize", lambda df, *more: plans.append(plan_of(df)) or whole(df, *more))
    keys = keys_of.graph_key(*tables(spark, graphs))
    plans.append(plan_of(keys))
    got = {r["g"]: r["key"] for r in keys.collect()}
    assert all(got[g] == got[g % 5] for g in got) and len(set(got.values())) == 5
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]


def test_core_of_long_chains(spark, monkeypatch):
    """A chain of 10,000 nodes, alone, on a ring, and between two rings, takes few rounds."""
    n = 10_000
    chain = lambda a, b: {(i, i + 1): "1" for i in range(a, b)}
    ring = lambda at: {(at, at + 1): "1", (at + 1, at + 2): "1", (at + 2, at): "1"}
    edges = {1: chain(0, n), 2: chain(0, n) | {(n, n + 1): "1", (n + 1, n + 2): "1", (n + 2, n): "1"}, 3: ring(0) | chain(2, n) | ring(n), 4: {(i, (i + 1) % n): "1" for i in range(n)}}
    rounds = []
    whole = keys_of.materialize
    monkeypatch.setattr(keys_of, "materialize", lambda df, name="table": rounds.append(name) or whole(df, name))
    nodes, bonds = tables(spark, {g: ({i: "x" for e in es for i in e}, es) for g, es in edges.items()})
    core = {}
    for r in keys_of.core_nodes(nodes, bonds)[0].collect():
        core.setdefault(r["g"], set()).add(r["n"])
    assert core == {2: {n, n + 1, n + 2}, 3: set(range(n + 3)), 4: set(range(n))}
    assert rounds.count("arrows") < 20 and rounds.count("core") < 4


def test_core_keeps_double_edges(spark):
    edges = {(0, 1): "1", (1, 2): "1", (2, 0): "1", (0, 3): "2", (1, 4): "1", (4, 5): "2", (2, 6): "2", (6, 7): "2"}
    nodes, bonds = tables(spark, {1: ({i: "x" for i in range(8)}, edges), 2: ({0: "x", 1: "x"}, {(0, 1): "2"})})
    kept, inside = keys_of.core_nodes(nodes, bonds, keep=["2"])
    assert {(r["g"], r["n"]) for r in kept.collect()} == {(1, n) for n in (0, 1, 2, 3, 6)}
    assert {(r["u"], r["v"]) for r in inside.collect()} == {(a, b) for e in [(0, 1), (1, 2), (2, 0), (0, 3), (2, 6)] for a, b in (e, e[::-1])}
    keys = {r["g"]: r["key"] for r in keys_of.core_keys(nodes, bonds, keep=["2"]).collect()}
    assert keys[2] == "" and keys[1] != keys_of.core_keys(nodes, bonds).filter("g = 1").first()["key"]


def test_dense_bits_are_computed_once(spark):
    """An expression for the bits is evaluated once a row, not once a position."""
    drawn = spark.range(200).select(ft.to_dense(F.array((F.rand(7) * 64).cast("int")), 64).alias("x"))
    assert {sum(r.x) for r in drawn.collect()} == {1}
