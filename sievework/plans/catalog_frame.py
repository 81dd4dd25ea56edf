"""Queries over projections, filters, joins, reshaping and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.features import sign_bits
from sievework.operators import frame, joins, similarity
from sievework.operators.metrics import evaluation
from sievework.operators.ranking import running_totals
from sievework.plans.registry import (
    DOCUMENTS_WITH_TARGETS,
    SCORED,
    documents_with_targets,
    query,
    scored_labels,
    table,
)
from sievework.plans.training import summarize_settings


@query("p1_projection_by_exclusion", "select vec_id, label from embeddings")
def p1(spark, d):
    return frame.drop_columns(table(spark, d, "embeddings"), ["embedding"])


@query("p2_target_discovery", "select quality, toxic from labels")
def p2(spark, d):
    df = table(spark, d, "labels")
    return df.select(*frame.target_columns(df, exclude=["doc_id"]))


@query(
    "p3_valid_rows",
    f"""select doc_id, quality from {DOCUMENTS_WITH_TARGETS}
        where quality is not null and text is not null""",
)
def p3(spark, d):
    return frame.valid_rows(documents_with_targets(spark, d), "quality", "text").select("doc_id", "quality")


@query(
    "p4_complete_cases",
    f"""select doc_id, quality, toxic from {DOCUMENTS_WITH_TARGETS}
        where quality is not null and toxic is not null""",
)
def p4(spark, d):
    df = documents_with_targets(spark, d)
    return frame.complete_cases(df, ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query(
    "p5_feature_choice",
    """select vec_id, unnest(embedding)::DOUBLE as x, generate_subscripts(embedding, 1)::INTEGER - 1 as pos
       from embeddings""",
)
def p5(spark, d):
    df = table(spark, d, "embeddings").withColumn("small", F.slice("embedding", 1, 8))
    chosen = frame.choose_feature(df, "vec_id", "embedding", "small", use_compressed=False)
    return chosen.select("vec_id", F.posexplode("feature").alias("pos", "x")).select(
        "vec_id", F.col("x").cast("double").alias("x"), "pos"
    )


@query(
    "p6_task_projection",
    f"select doc_id, n_chars, toxic from {DOCUMENTS_WITH_TARGETS} where toxic is not null",
)
def p6(spark, d):
    return frame.task_rows(documents_with_targets(spark, d), "doc_id", "n_chars", "toxic")


@query(
    "p7_null_audit",
    f"""select count(*) as n_rows, count(*) - count(quality) as null_quality,
          count(*) - count(toxic) as null_toxic from {DOCUMENTS_WITH_TARGETS}""",
)
def p7(spark, d):
    return frame.null_audit(documents_with_targets(spark, d), ["quality", "toxic"])


@query(
    "p8_membership_filter",
    """select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')
       and c_custkey in (select o_custkey from orders)""",
)
def p8(spark, d):
    some = frame.keep_members(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    buyers = table(spark, d, "orders").select("o_custkey")
    return frame.keep_members(some, "c_custkey", buyers).select("c_custkey", "c_mktsegment")


@query(
    "p9_text_to_boolean",
    """select l_returnflag, l_linestatus, count(*) as n,
         case when lower(l_returnflag) in ('yes','true','t','y','1') then true
              when lower(l_returnflag) in ('no','false','f','n','0') then false end as flag,
         case when lower(l_linestatus) in ('yes','true','t','y','1') then true
              when lower(l_linestatus) in ('no','false','f','n','0') then false end as status
       from lineitem group by all""",
)
def p9(spark, d):
    flags = table(spark, d, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        frame.to_boolean(F.col("l_returnflag")).alias("flag"),
        frame.to_boolean(F.col("l_linestatus")).alias("status"),
    )
    return flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("n"))


@query("p10_column_choice", "select p_partkey, p_name, p_size, p_retailprice from part")
def p10(spark, d):
    return frame.select_columns(table(spark, d, "part"), ignore=["p_brand", "p_type"])


@query(
    "p11_features_and_labels",
    """select vec_id, pos, x, label from (
         select vec_id, label, unnest(embedding)::DOUBLE as x,
           generate_subscripts(embedding, 1)::INTEGER - 1 as pos from embeddings)""",
)
def p11(spark, d):
    x, y = frame.split_xy(table(spark, d, "embeddings"), "vec_id", "embedding")
    return x.join(y, "vec_id").select("vec_id", "pos", F.col("x").cast("double").alias("x"), "label")


# Reshaping


@query(
    "r1_gather",
    """select doc_id, target, association from
       (unpivot labels on quality, toxic into name target value association)
       union all select doc_id, 'quality', null from labels where quality is null
       union all select doc_id, 'toxic', null from labels where toxic is null""",
)
def r1(spark, d):
    return frame.gather(table(spark, d, "labels"), "target", "association", ["quality", "toxic"])


@query(
    "r2_row_concatenation",
    """select doc_id, quality, null::INTEGER as toxic, 'positives' as "set" from labels where quality = 1
       union all select doc_id, quality, toxic, 'negatives' from labels where quality = 0""",
)
def r2(spark, d):
    labels = table(spark, d, "labels")
    return frame.stack_tagged(
        {
            "positives": labels.filter("quality = 1").drop("toxic"),
            "negatives": labels.filter("quality = 0"),
        }
    )


@query(
    "r3_distinct_counts",
    "select label as value, count(*) as n from embeddings group by label",
)
def r3(spark, d):
    return frame.distinct_counts(table(spark, d, "embeddings"), "label")


# Order


@query("o1_sort_by_value", "select p_partkey, p_retailprice from part order by 2 desc, 1")
def o1(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return frame.sort_by_value(parts, "p_retailprice", "p_partkey", "big")


@query(
    "o2_largest_groups",
    """select source, count(*) as size from documents group by source
       order by size desc, source limit 10""",
)
def o2(spark, d):
    return frame.largest_groups(table(spark, d, "documents"), "source", 10)


CONFUSION = f"""(
  select target, fold,
    count(*) filter (y_true = 0 and score < 0.5) as tn, count(*) filter (y_true = 0 and score >= 0.5) as fp,
    count(*) filter (y_true = 1 and score < 0.5) as fn, count(*) filter (y_true = 1 and score >= 0.5) as tp
  from {SCORED} group by target, fold)"""
CLASS_SCORES = f"""(
  select target, fold, tn, fp, fn, tp,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) as p_1, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) as r_1,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) as f1_1,
    coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) as p_0, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) as r_0,
    coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0) as f1_0,
    (tp / (tp + fn + 1e-10::DOUBLE) + tn / (tn + fp + 1e-10::DOUBLE)) / 2 as balanced_accuracy,
    (tp + tn) / (tp + tn + fp + fn)::DOUBLE as accuracy,
    coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt(tp::DOUBLE + fp) * sqrt(tp::DOUBLE + fn)
      * sqrt(tn::DOUBLE + fp) * sqrt(tn::DOUBLE + fn), 0), 0) as mcc
  from {CONFUSION})"""


@query(
    "o3_best_fold",
    f"""select target, fold as best_fold, round(p_1, 6) as p_1, round(r_1, 6) as r_1, round(mcc, 6) as mcc
        from {CLASS_SCORES}
        qualify row_number() over (partition by target order by p_1 desc, r_1 desc, mcc desc, fold) = 1""",
)
def o3(spark, d):
    best = frame.best_fold(evaluation(scored_labels(spark, d)), ["p_1", "r_1", "mcc"], ["target"])
    return best.select("target", "best_fold", *[F.round(c, 6).alias(c) for c in ("p_1", "r_1", "mcc")])


@query(
    "o4_best_fold_by_one",
    f"""select target, fold as best_fold, round(f1_1, 6) as f1_1 from {CLASS_SCORES}
        qualify row_number() over (partition by target order by f1_1 desc, fold) = 1""",
)
def o4(spark, d):
    best = frame.best_fold(evaluation(scored_labels(spark, d)), ["f1_1"], ["target"])
    return best.withColumn("f1_1", F.round("f1_1", 6))


@query(
    "o5_shuffle_rows",
    "select c_custkey, c_name from customer order by md5('7|' || c_custkey::varchar), c_custkey",
)
def o5(spark, d):
    return frame.shuffle_rows(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 7)


@query(
    "o6_ranked_settings",
    """select setting, round(mean, 6) as mean, round(std, 6) as std,
         rank() over (order by mean desc)::INTEGER as rank
       from (select p_type as setting, avg(p_size) as mean, stddev_pop(p_size) as std from part group by 1)""",
)
def o6(spark, d):
    ranked = summarize_settings(table(spark, d, "part"), "p_type", "p_size")
    return ranked.select("setting", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "rank")


# Joins


@query(
    "j1_inner_join",
    """select c_custkey, c_name, n_name as nation, o_orderkey as order_id from customer
       join (select n_nationkey, n_name from nation) on c_nationkey = n_nationkey
       join orders on o_custkey = c_custkey""",
)
def j1(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    named = joins.merge_renamed(customers, table(spark, d, "nation"), "n_nationkey", {"n_name": "nation"})
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.merge_renamed(named, orders, "c_custkey", {"o_orderkey": "order_id"}).drop("n_nationkey")


@query(
    "j2_semi_and_anti_join",
    """select doc_id, source, doc_id in (select doc_id from labels) as labelled from documents""",
)
def j2(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    inside = joins.keep_listed(docs, labels, "doc_id").withColumn("labelled", F.lit(True))
    outside = joins.keep_unlisted(docs, labels, "doc_id").withColumn("labelled", F.lit(False))
    return inside.unionByName(outside)


# Each vector is compared with the next one of its label.
NEXT_OF_LABEL = """(
  select vec_id, list_transform(embedding, lambda v: v > 0) as a,
    list_transform(lead(embedding) over (partition by label order by vec_id), lambda v: v > 0) as b,
    lead(vec_id) over (partition by label order by vec_id) as other
  from embeddings)"""


def paired_vectors(spark, d):
    """Every vector with the following one of its label, both as sign bits.

    The follower is found among numbers alone; the vectors are attached by key.
    """
    df = table(spark, d, "embeddings")
    place = running_totals(df.select("vec_id", "label"), {"i": F.lit(1)}, "vec_id", partition=["label"])
    after = place.select("label", (F.col("i") - 1).alias("i"), F.col("vec_id").alias("other"))
    bits = df.select("vec_id", sign_bits(F.col("embedding")).alias("fp"))
    return (
        place.join(after, ["label", "i"])
        .join(bits.withColumnRenamed("fp", "a"), "vec_id")
        .join(bits.select(F.col("vec_id").alias("other"), F.col("fp").alias("b")), "other")
    )


@query(
    "j3_vector_equality",
    f"select vec_id, other, a = b as all_equal from {NEXT_OF_LABEL} where other is not null",
)
def j3(spark, d):
    return similarity.compare_pairs(paired_vectors(spark, d), "a", "b").select("vec_id", "other", "all_equal")


@query(
    "j4_tanimoto",
    f"""select vec_id, other, round(
          list_sum(list_transform(list_zip(a, b), lambda p: (p[1] and p[2])::INTEGER))::DOUBLE
          / nullif(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] or p[2])::INTEGER)), 0), 6) as tanimoto
        from {NEXT_OF_LABEL} where other is not null""",
)
def j4(spark, d):
    pairs = similarity.compare_pairs(paired_vectors(spark, d), "a", "b")
    return pairs.select("vec_id", "other", F.round("tanimoto", 6).alias("tanimoto"))


@query(
    "j6_align_by_key",
    """select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id""",
)
def j6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return joins.align(docs, table(spark, d, "labels"), "doc_id")


@query(
    "j7_predetermined_split",
    """select d.doc_id, d.lang, l.quality as fold,
         case when l.quality = 0 then 'test' else 'train' end as split
       from documents d join labels l on d.doc_id = l.doc_id""",
)
def j7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    folds = table(spark, d, "labels").withColumnRenamed("quality", "fold")
    return joins.predetermined_split(docs, folds, "doc_id", test_fold=0)
