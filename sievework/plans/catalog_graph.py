"""Queries over graph fingerprints: one small graph per order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions.hashing import stable_hash
from sievework.operators import graph, keys, patterns
from sievework.operators.patterns import Pattern, chain, ring, star
from sievework.plans.registry import hash32, query, table
from sievework.session import materialize


def order_graphs(spark, d):
    """Nodes are line numbers, edges a path over them; even orders get a closing edge from
    the first to the third node. At most seven nodes per graph."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
    )
    # All rows of a graph meet once, and stay together from here on.
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = lines.repartition(pieces, "g").groupBy("g", "n").agg(F.min("label").alias("label"))
    nodes = materialize(nodes, "nodes", "g")
    by_number = Window.partitionBy("g").orderBy("n")
    placed = nodes.select(
        "g", F.col("n").alias("u"), F.lead("n").over(by_number).alias("v"),
        F.lead("n", 2).over(by_number).alias("w"), F.row_number().over(by_number).alias("i"),
    )
    follows = F.col("v").isNotNull()
    closes = (F.col("i") == 1) & (F.col("g") % 2 == 0) & F.col("w").isNotNull()
    way = lambda cond, a, b: F.when(cond, F.struct(F.col(a).alias("u"), F.col(b).alias("v")))
    ways = F.array_compact(
        F.array(
            way(follows, "u", "v"), way(follows, "v", "u"), way(closes, "u", "w"), way(closes, "w", "u")
        )
    )
    edges = placed.select("g", F.explode(ways).alias("e")).select("g", "e.u", "e.v", F.lit("1").alias("label"))
    return nodes, materialize(edges, "edges", "g")


GRAPHS = """nodes as materialized (select l_orderkey as g, l_linenumber as n, min(l_returnflag || l_linestatus) as label
    from lineitem group by 1, 2),
  placed as (select g, n, row_number() over (partition by g order by n) as i from nodes),
  one_way as (select a.g, a.n as u, b.n as v from placed a join placed b on a.g = b.g and b.i = a.i + 1
    union all select a.g, a.n, b.n from placed a join placed b on a.g = b.g where a.i = 1 and b.i = 3 and a.g % 2 = 0),
  edges as materialized (select g, u, v, '1' as label from one_way union all select g, v, u, '1' from one_way)"""


def rounds_sql(rounds: int, nodes: str = "nodes", edges: str = "edges", name: str = "ids") -> str:
    """CTEs ids0..idsN of node identifiers."""
    start = f"{name}0 as materialized (select g, n, md5(label) as id from {nodes})"
    return ",\n".join([start, *refine_sql(rounds, edges, name)])


def refine_sql(rounds: int, edges: str, name: str) -> list[str]:
    """CTEs ids1..idsN from ids0."""
    return [
        f"""{name}a{i} as (select g, n, {digest_sql('x')} as around from (
              select e.g, e.u as n, e.label || '~' || i.id as x from {edges} e
              join {name}{i - 1} i on i.g = e.g and i.n = e.v) group by g, n),
            {name}{i} as materialized (select i.g, i.n, md5(i.id || '~' || coalesce(a.around, '')) as id
              from {name}{i - 1} i left join {name}a{i} a on a.g = i.g and a.n = i.n)"""
        for i in range(1, rounds + 1)
    ]


def digest_sql(x: str) -> str:
    sums = " || '|' || ".join(f"sum({hash32(x, start)})::varchar" for start in (1, 9, 17, 25))
    return f"md5(count({x})::varchar || '|' || {sums})"


def stable_sql(name: str, rounds: int) -> str:
    """CTE {name}s (g, n, id): the first round that tells no more nodes apart than the one before."""
    union = lambda what: " union all ".join(what(i) for i in range(rounds + 1))
    counts = union(lambda i: f"select g, {i} as r, count(distinct id) as c from {name}{i} group by g")
    levels = union(lambda i: f"select g, n, id, {i} as r from {name}{i}")
    return f"""{name}n as materialized ({counts}),
      {name}r as (select a.g, min(b.r) as r from {name}n a join {name}n b on b.g = a.g and b.r = a.r + 1 and b.c = a.c group by a.g),
      {name}s as materialized (select l.g, l.n, l.id from ({levels}) l join {name}r s on s.g = l.g and s.r = l.r)"""


def branch_sql(above: str, name: str, bonds: str) -> str:
    """One level of the search for the least certificate: every node of the smallest class of
    {above}p (g, n, id) is marked in a branch of its own. CTEs {name}c (graph, cert) of branches
    in which all nodes differ and {name}p, {name}m of the others."""
    return f"""{name}cell as (select g, id from (select g, id, row_number() over (partition by g order by count(*), id) as r
        from {above}p group by g, id having count(*) > 1) where r = 1),
      {name}b as materialized (select m.graph, p.g as parent, p.n as marked, p.g || '/' || p.n as g
        from {above}p p join {name}cell using (g, id) join {above}m m on m.g = p.g),
      {name}0 as materialized (select b.g, p.n, case when p.n = b.marked then md5(p.id || '*') else p.id end as id
        from {above}p p join {name}b b on b.parent = p.g),
      {name}e as materialized (select b.g, e.u, e.v, e.label from {bonds} e join {name}b b on b.graph = e.g),
      {",".join(refine_sql(3, f"{name}e", name))}, {stable_sql(name, 3)},
      {name}d as (select g, count(distinct id) = count(*) as done, {digest_sql('id')} as digest from {name}s group by g),
      {name}k as materialized (select * from (select b.*, d.done, rank() over (partition by parent order by digest) as r
        from {name}b b join {name}d d on d.g = b.g) where r = 1),
      {name}c as (select graph, cert from (select e.g, {digest_sql("iu.id || '~' || e.label || '~' || iv.id")} as cert
          from {name}e e join {name}s iu on iu.g = e.g and iu.n = e.u join {name}s iv on iv.g = e.g and iv.n = e.v group by e.g) c
        join {name}k k on k.g = c.g where done),
      {name}m as (select graph, g from {name}k where not done),
      {name}p as materialized (select s.g, s.n, s.id from {name}s s join {name}m m on m.g = s.g)"""


def key_sql(name: str = "ids", bonds: str = "e7") -> str:
    """CTE keys (g, key). Seven nodes are all told apart after six rounds, so seven are enough;
    rings have three nodes, so two levels of the search and three rounds in each are enough."""
    return f"""{stable_sql(name, 7)},
      z1p as materialized (select s.g::varchar as g, s.n, s.id from {name}s s join (select distinct g, u from {bonds}) b on b.g = s.g and b.u = s.n
        where s.g in (select x.g from {name}s x join (select distinct g, u from {bonds}) y on y.g = x.g and y.u = x.n
          group by x.g having count(distinct x.id) < count(*))),
      z1m as (select distinct g as graph, g from z1p), z1bonds as (select g::varchar as g, u, v, label from {bonds}),
      {branch_sql('z1', 'z2', 'z1bonds')}, {branch_sql('z2', 'z3', 'z1bonds')},
      certs as (select graph, min(cert) as cert from (select * from z2c union all select * from z3c) group by graph),
      keys as (select p.g, case when cert is null then p.key else md5(p.key || '~' || cert) end as key
        from (select g, {digest_sql('id')} as key from {name}s group by g) p left join certs on certs.graph = p.g::varchar)"""


@query(
    "f1_circular_fingerprint",
    f"""with {GRAPHS}, {rounds_sql(2)}
        select distinct g, ({hash32('id')} % 2048)::INTEGER as bit
        from (select * from ids0 union all select * from ids1 union all select * from ids2)""",
)
def f1(spark, d):
    return graph.circular_bits(*order_graphs(spark, d), radius=2, n_bits=2048)


def path_sql(nodes: list[str]) -> str:
    """Smaller of both readings of a path over node aliases; edge labels follow their node."""
    there, back = [], []
    for i, a in enumerate(nodes):
        there.append(f"{a}.label")
        back.append(f"{a}.label")
        if i + 1 < len(nodes):
            there.append(f"e{i}.label")
            back.append(f"e{i}.label")
    return f"least({" || '-' || ".join(there)}, {" || '-' || ".join(reversed(back))})"


# Every simple path written out node by node.
PATHS = {
    1: f"""select a.g, {path_sql(['a', 'b'])} as path, count(*) // 2 as n from nodes a
           join edges e0 on e0.g = a.g and e0.u = a.n join nodes b on b.g = a.g and b.n = e0.v group by 1, 2""",
    2: f"""select a.g, {path_sql(['a', 'b', 'c'])} as path, count(*) // 2 as n from nodes a
           join edges e0 on e0.g = a.g and e0.u = a.n join nodes b on b.g = a.g and b.n = e0.v
           join edges e1 on e1.g = a.g and e1.u = b.n and e1.v <> a.n join nodes c on c.g = a.g and c.n = e1.v
           group by 1, 2""",
    3: f"""select a.g, {path_sql(['a', 'b', 'c', 'd'])} as path, count(*) // 2 as n from nodes a
           join edges e0 on e0.g = a.g and e0.u = a.n join nodes b on b.g = a.g and b.n = e0.v
           join edges e1 on e1.g = a.g and e1.u = b.n and e1.v <> a.n join nodes c on c.g = a.g and c.n = e1.v
           join edges e2 on e2.g = a.g and e2.u = c.n and e2.v <> b.n and e2.v <> a.n
           join nodes d on d.g = a.g and d.n = e2.v group by 1, 2""",
}


@query(
    "f2_path_fingerprint",
    f"""with {GRAPHS} select distinct g, ({hash32('path')} % 2048)::INTEGER as bit from (
          select g, label as path from nodes union all select g, path from ({PATHS[1]})
          union all select g, path from ({PATHS[2]}) union all select g, path from ({PATHS[3]}))""",
)
def f2(spark, d):
    return graph.path_bits(*order_graphs(spark, d), length=3, n_bits=2048)


def long_path_sql(length: int) -> str:
    """The same for any number of edges."""
    names = [f"p{i}" for i in range(length + 1)]
    joins = "".join(
        f""" join edges e{i} on e{i}.g = p0.g and e{i}.u = p{i}.n
             {" ".join(f"and e{i}.v <> p{j}.n" for j in range(i))}
             join nodes p{i + 1} on p{i + 1}.g = p0.g and p{i + 1}.n = e{i}.v"""
        for i in range(length)
    )
    return f"select p0.g, {path_sql(names)} as path from nodes p0{joins}"


@query(
    "f2_long_path_fingerprint",
    f"""with {GRAPHS} select distinct g, ({hash32('path')} % 2048)::INTEGER as bit from (
          select g, label as path from nodes
          union all {" union all ".join(long_path_sql(i) for i in range(1, 7))})""",
)
def f2_long(spark, d):
    return graph.path_bits(*order_graphs(spark, d), length=6, n_bits=2048)


@query(
    "f4_node_pair_fingerprint",
    f"""with {GRAPHS},
       d1 as materialized (select distinct g, u, v, 1 as d from edges),
       d2 as materialized (select distinct a.g, a.u, b.v, 2 as d from d1 a join d1 b on a.g = b.g and a.v = b.u
         where a.u <> b.v and not exists (select 1 from d1 x where x.g = a.g and x.u = a.u and x.v = b.v)),
       d3 as (select distinct a.g, a.u, b.v, 3 as d from d2 a join d1 b on a.g = b.g and a.v = b.u
         where a.u <> b.v and not exists (select 1 from d1 x where x.g = a.g and x.u = a.u and x.v = b.v)
           and not exists (select 1 from d2 x where x.g = a.g and x.u = a.u and x.v = b.v)),
       p as (select * from d1 union all select * from d2 union all select * from d3)
       select distinct p.g, ({hash32("least(a.label, b.label) || '-' || d::varchar || '-' || greatest(a.label, b.label)")} % 2048)::INTEGER as bit
       from p join nodes a on a.g = p.g and a.n = p.u join nodes b on b.g = p.g and b.n = p.v""",
)
def f4(spark, d):
    return graph.pair_bits(*order_graphs(spark, d), reach=3, n_bits=2048)


@query(
    "f5_torsion_counts",
    f"""with {GRAPHS} select g, ({hash32('path')} % 2048)::INTEGER as bit, sum(n)::BIGINT as n
        from ({PATHS[3]}) group by 1, 2""",
)
def f5(spark, d):
    return graph.torsion_counts(*order_graphs(spark, d), n_bits=2048)


def strip_sql(rounds: int) -> str:
    """CTEs e1..eN of edges left after removing nodes of degree one."""
    parts = ["e0 as (select * from edges)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"""k{i} as materialized (select g, u as n from e{i - 1} group by 1, 2 having count(*) > 1),
                e{i} as materialized (select e.* from e{i - 1} e join k{i} a on a.g = e.g and a.n = e.u
                  join k{i} b on b.g = e.g and b.n = e.v)"""
        )
    return ",\n".join(parts)


# A graph has at most seven nodes, so seven rounds always reach the end.
CORE = f"""{strip_sql(7)},
  core as materialized (select n.* from nodes n join (select distinct g, u from e7) k on k.g = n.g and k.u = n.n),
  {rounds_sql(7, 'core', 'e7', 'c')}"""


@query(
    "f11_core_key",
    f"""with {GRAPHS}, {CORE}, {key_sql('c')}
        select a.g, coalesce(k.key, '') as key from (select distinct g from nodes) a left join keys k on k.g = a.g""",
)
def f11(spark, d):
    return keys.core_keys(*order_graphs(spark, d))


def with_double_edges(edges):
    """Every third edge, by its end nodes, gets the label 2."""
    ends = F.concat_ws("|", "g", F.least("u", "v"), F.greatest("u", "v"))
    return edges.withColumn("label", F.when(stable_hash(ends) % 3 == 0, "2").otherwise("1"))


# Edges of label 2 that hang off the core stay, with the node at their other end.
KEPT = f"""{GRAPHS.replace("edges as materialized", "plain as materialized")},
  edges as materialized (select g, u, v, case when {hash32("concat_ws('|', g::varchar, least(u, v)::varchar, greatest(u, v)::varchar)")} % 3 = 0
    then '2' else '1' end as label from plain),
  {strip_sql(7)},
  inside as materialized (select distinct g, u as n from e7),
  hanging as materialized (select e.* from edges e join inside i on i.g = e.g and i.n = e.u
    left join inside o on o.g = e.g and o.n = e.v where o.n is null and e.label = '2'),
  bonds as materialized (select * from e7 union all select * from hanging union all select g, v, u, label from hanging),
  core as materialized (select n.* from nodes n join (select distinct g, u from bonds) k on k.g = n.g and k.u = n.n)"""


@query(
    "f11_core_key_double_edges",
    f"""with {KEPT}, {rounds_sql(7, 'core', 'bonds', 'c')}, {key_sql('c')}
        select a.g, coalesce(k.key, '') as key, coalesce(n, 0) as n from (select distinct g from nodes) a
        left join keys k on k.g = a.g left join (select g, count(*) as n from core group by g) c on c.g = a.g""",
)
def f11_double(spark, d):
    nodes, edges = order_graphs(spark, d)
    edges = materialize(with_double_edges(edges), "edges", "g")
    core = keys.core_nodes(nodes, edges, keep=["2"])
    sizes = core[0].groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = keys.core_keys(nodes, edges, keep=["2"], core=core).join(sizes, "g", "left")
    return out.select("g", "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query(
    "f12_graph_key",
    f"with {GRAPHS}, {strip_sql(7)}, {rounds_sql(7)}, {key_sql()} select g, key from keys",
)
def f12(spark, d):
    return keys.graph_key(*order_graphs(spark, d))


#: Keys of the order graphs: chains, branches, rings and both together, some vertices of any
#: label or of one of several, some keys for repeated matches only.
ORDER_KEYS = (
    chain("AF"),
    Pattern(("NO",), least=3),
    chain("AF", "AF"),
    chain("RF", "NO"),
    chain(("AF", "RF"), "NF"),
    chain("AF", None, "AF"),
    chain("NO", "NO", "NO"),
    chain("RF", "AF", "RF"),
    Pattern(("AF", None, "RF"), ((0, 1, "1"), (1, 2, "1")), least=2),
    chain("AF", ("AF", "RF"), ("AF", "RF"), "RF"),
    chain(None, None, None, None, None),
    chain("NO", "NO", "NO", "NO", "NO", "NO"),
    star(None, None, None, None),
    star("NO", "NO", "NO", "NO"),
    star(("AF", "RF"), "AF", "AF", "RF"),
    ring(None, None, None),
    ring("NO", "NO", "NO"),
    ring("AF", ("AF", "RF"), "RF", edge="1"),
    Pattern((None,) * 4, ((0, 1, None), (1, 2, None), (2, 0, None), (2, 3, None))),
    Pattern(("NO", "NO", "NO", None, None), ((0, 1, None), (1, 2, None), (2, 0, None), (2, 3, None), (3, 4, "1"))),
)


def pattern_sql(at: int, pattern: Pattern) -> str:
    """All maps of a pattern into a graph, divided by its maps onto itself."""

    def allowed(column: str, labels) -> list[str]:
        if labels is None:
            return []
        return [f"{column} in ({', '.join(repr(x) for x in ([labels] if isinstance(labels, str) else labels))})"]

    known, joins, where = {0}, [], allowed("n0.label", pattern.vertices[0])
    for k, (a, b, labels) in enumerate(sorted(pattern.edges, key=lambda e: max(e[:2]))):
        a, b = (a, b) if a in known else (b, a)
        joins.append(f"join edges e{k} on e{k}.g = n0.g and e{k}.u = n{a}.n" + (f" and e{k}.v = n{b}.n" if b in known else ""))
        where += allowed(f"e{k}.label", labels)
        if b not in known:
            others = "".join(f" and n{b}.n <> n{c}.n" for c in sorted(known))
            joins.append(f"join nodes n{b} on n{b}.g = n0.g and n{b}.n = e{k}.v{others}")
            where += allowed(f"n{b}.label", pattern.vertices[b])
            known.add(b)
    same = len(patterns.symmetries(pattern))
    return f"""select n0.g, {at} as pattern, count(*) // {same} as n, count(*) // {same} >= {pattern.least} as has_key
      from nodes n0 {" ".join(joins)} {"where " + " and ".join(where) if where else ""} group by n0.g"""


@query(
    "f3_graph_patterns",
    f"with {GRAPHS} {' union all '.join(pattern_sql(k, p) for k, p in enumerate(ORDER_KEYS))}",
)
def f3_graphs(spark, d):
    found = patterns.pattern_counts(*order_graphs(spark, d), ORDER_KEYS)
    least = F.get(F.array(*[F.lit(p.least) for p in ORDER_KEYS]), F.col("pattern"))
    return found.withColumn("has_key", F.col("n") >= least)
