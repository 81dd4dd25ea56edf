"""Queries over splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import frame, splits
from sievework.plans.registry import query, table


@query(
    "w5_reindex",
    """select o_orderkey, o_orderstatus, row_number() over (order by o_orderkey) - 1 as "index"
       from orders where o_orderstatus <> 'F'""",
)
def w5(spark, d):
    kept = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").filter("o_orderstatus <> 'F'")
    return frame.reindex(kept, "o_orderkey")


@query(
    "x1_random_split",
    """select o_orderkey, case when row_number() over (order by md5('42|' || o_orderkey::varchar), o_orderkey)
         <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split from orders""",
)
def x1(spark, d):
    return splits.random_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@query(
    "x2_stratified_split",
    """select doc_id, quality, case when
         row_number() over (partition by quality order by md5('42|' || doc_id::varchar), doc_id)
         <= ceil(0.2 * count(*) over (partition by quality)) then 'test' else 'train' end as split
       from labels where quality is not null""",
)
def x2(spark, d):
    return splits.stratified_split(table(spark, d, "labels").drop("toxic"), "doc_id", "quality", 0.2)


@query(
    "x2_split_of_many_strata",
    """select l_orderkey, k, case when row_number() over (partition by l_orderkey order by md5('42|' || k), k)
         <= ceil(0.2 * count(*) over (partition by l_orderkey)) then 'test' else 'train' end as split
       from (select distinct l_orderkey, l_orderkey::varchar || '-' || l_linenumber::varchar as k from lineitem)""",
)
def x2_many(spark, d):
    # Every order is a stratum.
    k = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = table(spark, d, "lineitem").select("l_orderkey", k.alias("k")).distinct()
    return splits.stratified_split(lines, "k", "l_orderkey", 0.2)


@query(
    "x3_folds_of_many_strata",
    """with sizes as (select o_custkey, count(*) as n, sum(count(*)) over (order by o_custkey) - count(*) as a
                      from orders group by o_custkey),
       places as (select o_custkey, unnest(range(a::BIGINT, (a + n)::BIGINT)) as p from sizes),
       quota as (select o_custkey, p % 3 + 1 as f, count(*) as take from places group by all),
       ends as (select o_custkey, f, sum(take) over (partition by o_custkey order by f) as upto from quota),
       ranked as (select o_orderkey, o_custkey,
                    row_number() over (partition by o_custkey order by md5('42|' || o_orderkey::varchar), o_orderkey) as r
                  from orders)
       select o_orderkey, r.o_custkey, min(f)::INTEGER as fold from ranked r join ends e
         on e.o_custkey = r.o_custkey and r.r <= e.upto group by o_orderkey, r.o_custkey""",
)
def x3_many(spark, d):
    # Every customer is a stratum.
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return splits.stratified_k_fold(orders, "o_orderkey", "o_custkey", 3)


@query(
    "x3_stratified_k_fold",
    """with sizes as (select toxic, count(*) as n, sum(count(*)) over (order by toxic) - count(*) as a
                      from labels where toxic is not null group by toxic),
       places as (select toxic, unnest(range(a::BIGINT, (a + n)::BIGINT)) as p from sizes),
       quota as (select toxic, p % 5 + 1 as f, count(*) as take from places group by all),
       ends as (select toxic, f, sum(take) over (partition by toxic order by f) as upto from quota),
       ranked as (select doc_id, toxic,
                    row_number() over (partition by toxic order by md5('42|' || doc_id::varchar), doc_id) as r
                  from labels where toxic is not null)
       select doc_id, r.toxic, min(f)::INTEGER as fold from ranked r join ends e
         on e.toxic = r.toxic and r.r <= e.upto group by doc_id, r.toxic""",
)
def x3(spark, d):
    return splits.stratified_k_fold(table(spark, d, "labels").drop("quality"), "doc_id", "toxic", 5)


@query(
    "x4_k_fold",
    """select o_orderkey, (case when r <= (n // 4 + 1) * (n % 4) then (r - 1) // (n // 4 + 1)
         else (n % 4) + (r - 1 - (n // 4 + 1) * (n % 4)) // (n // 4) end + 1)::INTEGER as fold
       from (select o_orderkey, count(*) over () as n,
               row_number() over (order by md5('42|' || o_orderkey::varchar), o_orderkey) as r from orders)""",
)
def x4(spark, d):
    return splits.k_fold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4)


@query(
    "x5_group_split",
    """with recursive groups as (
         select l_partkey, count(*) as size, min(l_orderkey) as first from lineitem group by l_partkey),
       hist as (select size, count(*) as m, row_number() over (order by size desc) as i from groups group by size),
       total as (select sum(size)::DOUBLE as n from groups),
       fill as (
         select 0::BIGINT as i, 0::BIGINT as size, 0::BIGINT as t, 0::BIGINT as r,
           0.2 * n + 1e-9 as test_room, 0.8 * n + 1e-9 as train_room from total
         union all
         select i, size, t, r, test_room - t * size, train_room - r * size from (
           select *, least(m - t, floor(train_room / size))::BIGINT as r from (
             select h.i, h.size, h.m, least(h.m, floor(f.test_room / h.size))::BIGINT as t,
               f.test_room, f.train_room
             from fill f join hist h on h.i = f.i + 1))),
       placed as (
         select l_partkey, case when g.r <= f.t then 'test' when g.r <= f.t + f.r then 'train' else 'val' end as split
         from (select *, row_number() over (partition by size order by first, l_partkey) as r from groups) g
         join fill f on f.size = g.size)
       select l_orderkey, l_linenumber, l.l_partkey, split from lineitem l join placed p on l.l_partkey = p.l_partkey""",
)
def x5(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return splits.group_split(rows, "l_partkey", "l_orderkey", (0.8, 0.0, 0.2))


def _greedy(source: str, group: str, seeds: list[int], test: float, train: float) -> str:
    """Group after group in random order: into test if it fits, else train, else val."""
    return f"""with recursive groups as (select {group} as grp, count(*) as size from {source} group by 1),
       seeds as (select unnest({seeds}) as seed),
       total as (select sum(size)::DOUBLE as n from groups),
       ordered as materialized (select seed, grp, size, row_number() over (
           partition by seed order by md5(seed::varchar || '|' || grp::varchar)) as i from groups, seeds),
       fill as (
         select seed, 0::BIGINT as i, null::BIGINT as grp, '' as split,
           {test} * n + 1e-9 as test_room, {train} * n + 1e-9 as train_room from seeds, total
         union all
         select o.seed, o.i, o.grp,
           case when o.size <= test_room then 'test' when o.size <= train_room then 'train' else 'val' end,
           test_room - case when o.size <= test_room then o.size else 0 end,
           train_room - case when o.size > test_room and o.size <= train_room then o.size else 0 end
         from fill f join ordered o on o.seed = f.seed and o.i = f.i + 1)"""


@query(
    "x6_balanced_group_split",
    _greedy("lineitem", "l_partkey", [0], 0.2, 0.8)
    + """ select l_orderkey, l_linenumber, l_partkey, split from lineitem join fill on grp = l_partkey""",
)
def x6(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return splits.balanced_group_split(rows, "l_partkey", "l_orderkey", (0.8, 0.0, 0.2), seed=0)


@query(
    "x7_repeated_group_folds",
    _greedy("orders", "o_custkey", [1, 2, 3], 0.25, 0.75)
    + """ select o_orderkey, o_custkey, seed, split from orders join fill on grp = o_custkey""",
)
def x7(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return splits.repeated_group_folds(rows, "o_custkey", "o_orderkey", [1, 2, 3], (0.75, 0.0, 0.25))


@query(
    "x8_weight_split",
    """select p_partkey, p_retailprice, case when r <= floor(0.7 * n) then 'train'
         when r <= floor(0.85 * n) then 'val' else 'test' end as split
       from (select p_partkey, p_retailprice, count(*) over () as n,
               row_number() over (order by p_retailprice, p_partkey) as r from part)""",
)
def x8(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return splits.weight_split(rows, "p_partkey", "p_retailprice", (0.7, 0.15, 0.15), "small")


@query(
    "x9_down_sample",
    """select doc_id, quality from (
         select doc_id, quality, row_number() over (partition by quality order by md5('42|' || doc_id::varchar), doc_id) as r,
           count(*) filter (quality = 1) over () as n1 from labels where quality in (0, 1))
       where quality = 1 or r <= floor(n1 / 8.0)""",
)
def x9(spark, d):
    return splits.down_sample(table(spark, d, "labels").drop("toxic"), "doc_id", "quality", 8.0)


@query(
    "x9_prepare_imbalanced_target",
    """select doc_id, toxic from (
         select doc_id, toxic, row_number() over (partition by toxic order by md5('42|' || doc_id::varchar), doc_id) as r,
           count(*) filter (toxic = 1) over () as n1, count(*) filter (toxic = 0) over () as n0
         from labels where toxic in (0, 1))
       where toxic = 1 or r <= floor(n1 / case when least(n0, n1) < 0.1 * greatest(n0, n1) then 0.1 else 0.5 end)""",
)
def x9b(spark, d):
    return splits.prepare_target(table(spark, d, "labels").drop("quality"), "doc_id", "toxic", 0.5)


@query(
    "x10_proportional_sample",
    """select o_orderkey, "set" from (
         select o_orderkey, "set", row_number() over (partition by "set" order by md5('42|' || o_orderkey::varchar), o_orderkey) as r,
           floor(1000 * (count(*) filter ("set" = 'train') over ()) / (count(*) over ())) as q
         from (select o_orderkey, case when o_orderstatus = 'F' then 'test' else 'train' end as "set" from orders))
       where r <= case when "set" = 'train' then q else 1000 - q end""",
)
def x10(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "test").otherwise("train").alias("set")
    )
    return splits.proportional_sample(rows, "o_orderkey", "set", 1000)


@query(
    "x11_class_weights",
    """select doc_id, quality, round(count(*) over () / (2.0 * count(*) over (partition by quality)), 6)::DOUBLE as weight
       from labels where quality is not null""",
)
def x11(spark, d):
    weighted = splits.class_weights(table(spark, d, "labels").drop("toxic"), "quality")
    return weighted.withColumn("weight", F.round("weight", 6))
