"""Queries over label counts, metrics, curves and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import dedup, history, metrics
from sievework.operators.splits import random_split
from sievework.plans.catalog_frame import CLASS_SCORES, CONFUSION
from sievework.plans.registry import (
    DOCUMENTS_WITH_TARGETS,
    SCORED,
    documents_with_targets,
    hash32,
    query,
    scored_labels,
    table,
)


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("a1_class_counts", f"select target, y_true, count(*) as n from {SCORED} group by target, y_true")
def a1(spark, d):
    return metrics.class_counts(scored_labels(spark, d), ["target"])


@query(
    "a2_imbalance",
    f"""select target, n0, n1, least(n0, n1) < 0.1 * greatest(n0, n1) as imbalanced from (
          select target, count(*) filter (y_true = 0) as n0, count(*) filter (y_true = 1) as n1
          from {SCORED} group by target)""",
)
def a2(spark, d):
    return metrics.imbalance(scored_labels(spark, d), ["target"])


@query(
    "a3_share_report",
    """with rows as (
         select vec_id, (label < 3)::INTEGER as y, list_transform(embedding, lambda v: v > 0) as bits,
           row_number() over (order by md5('42|' || vec_id::varchar), vec_id) <= ceil(0.2 * count(*) over ()) as is_test
         from embeddings)
       select round(100.0 * count(*) filter (y = 1) / count(*))::BIGINT as pct_all,
         round(100.0 * count(*) filter (y = 1 and not is_test) / count(*) filter (not is_test))::BIGINT as pct_train,
         round(100.0 * count(*) filter (y = 1 and is_test) / count(*) filter (is_test))::BIGINT as pct_test,
         round(sum(list_count(list_filter(bits, lambda b: not b)))::DOUBLE / sum(len(bits)), 4) as zero_share
       from rows""",
)
def a3(spark, d):
    df = table(spark, d, "embeddings").select(
        "vec_id",
        (F.col("label") < 3).cast("int").alias("y"),
        F.transform("embedding", lambda v: v > 0).alias("bits"),
    )
    return metrics.share_report(random_split(df, "vec_id", 0.2), "y", "split", F.col("bits"))


@query(
    "a4_group_label_stats",
    f"""select source, count(*) as size, round(avg(quality), 6) as mean_quality, round(avg(toxic), 6) as mean_toxic,
          count(quality) as n_quality, count(toxic) as n_toxic from {DOCUMENTS_WITH_TARGETS}
        group by source order by size desc, source limit 10""",
)
def a4(spark, d):
    df = documents_with_targets(spark, d)
    return rounded(
        metrics.group_label_stats(df, "source", ["quality", "toxic"]), "mean_quality", "mean_toxic"
    )


@query("a5_group_members", "select distinct l_partkey, l_orderkey from lineitem")
def a5(spark, d):
    return metrics.group_members(table(spark, d, "lineitem"), "l_partkey", "l_orderkey")


@query("a6_confusion", f"select * from {CONFUSION}")
def a6(spark, d):
    return metrics.confusion(scored_labels(spark, d))


@query(
    "a7_per_class_report",
    f"""select target, fold, 0 as "class", round(p_0, 6) as precision, round(r_0, 6) as recall,
          round(f1_0, 6) as f1, tn + fp as support from {CLASS_SCORES}
        union all select target, fold, 1, round(p_1, 6), round(r_1, 6), round(f1_1, 6), fn + tp from {CLASS_SCORES}""",
)
def a7(spark, d):
    return rounded(metrics.per_class_report(scored_labels(spark, d)), "precision", "recall", "f1")


@query(
    "a8_balanced_accuracy",
    f"select target, fold, round(balanced_accuracy, 6) as balanced_accuracy from {CLASS_SCORES}",
)
def a8(spark, d):
    c = metrics.confusion(scored_labels(spark, d))
    return c.select("target", "fold", F.round(metrics.balanced_accuracy(), 6).alias("balanced_accuracy"))


@query("a9_mcc", f"select target, fold, round(mcc, 6) as mcc from {CLASS_SCORES}")
def a9(spark, d):
    c = metrics.confusion(scored_labels(spark, d))
    return c.select("target", "fold", F.round(metrics.mcc(), 6).alias("mcc"))


@query(
    "a10_threshold_scores",
    f"""select target, fold, round(accuracy, 6) as accuracy, round(p_1, 6) as precision, round(r_1, 6) as recall,
          round(balanced_accuracy, 6) as balanced_accuracy, round(mcc, 6) as mcc from {CLASS_SCORES}""",
)
def a10(spark, d):
    names = ["accuracy", "precision", "recall", "balanced_accuracy", "mcc"]
    return rounded(metrics.threshold_scores(scored_labels(spark, d)), *names)


CLIPPED = f"(select *, greatest(least(score, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) as p from {SCORED})"


@query(
    "a11_losses",
    f"""select target, fold, round(avg(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))), 6) as bce,
          round(avg((y_true - score) * (y_true - score)), 6) as mse,
          round(avg(-pow(1 - (y_true * p + (1 - y_true) * (1 - p)), 2) * ln(y_true * p + (1 - y_true) * (1 - p))), 6) as focal
        from {CLIPPED} group by target, fold""",
)
def a11(spark, d):
    return rounded(metrics.losses(scored_labels(spark, d)), "bce", "mse", "focal")


CURVE = f"""(
  select target, fold, score, pos, neg,
    sum(pos) over w as tp, sum(neg) over w as fp,
    sum(pos) over (partition by target, fold) as p, sum(neg) over (partition by target, fold) as n
  from (select target, fold, score, count(*) filter (y_true = 1) as pos, count(*) filter (y_true = 0) as neg
        from {SCORED} group by target, fold, score)
  window w as (partition by target, fold order by score desc rows unbounded preceding))"""
# By comparing every positive with every negative.
PAIR_AUC = f"""(
  select a.target, a.fold, avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end::DOUBLE) as auc
  from {SCORED} a join {SCORED} b on a.target = b.target and a.fold = b.fold and a.y_true = 1 and b.y_true = 0
  group by a.target, a.fold)"""


@query(
    "a12_roc_curve",
    f"""select target, fold, round(score, 9) as score, round(fp / n::DOUBLE, 6) as fpr,
          round(tp / p::DOUBLE, 6) as tpr from {CURVE}""",
)
def a12(spark, d):
    points = rounded(metrics.roc_curve(scored_labels(spark, d)), "fpr", "tpr")
    return points.withColumn("score", F.round("score", 9))


@query("a13_auc", f"select target, fold, round(auc, 6) as auc from {PAIR_AUC}")
def a13(spark, d):
    return rounded(metrics.auc(scored_labels(spark, d)), "auc")


@query(
    "a13_binned_auc",
    f"""with b as (select target, fold, y_true, least(floor(score * 200), 199) as score from {SCORED})
        select a.target, a.fold, round(avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5
          else 0.0 end::DOUBLE), 6) as auc
        from b a join b on a.target = b.target and a.fold = b.fold and a.y_true = 1 and b.y_true = 0
        group by a.target, a.fold""",
)
def a13b(spark, d):
    return rounded(metrics.binned_auc(scored_labels(spark, d)), "auc")


def weighted_f1_sql(score: str) -> str:
    return f"""(
  select fold, coalesce(sum(f1 * support) / nullif(sum(support), 0), 0) as f1 from (
    select fold, target, tp + fn as support, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) as f1 from (
      select fold, target,
        count(*) filter (y_true = 1 and s >= 0.5) as tp, count(*) filter (y_true = 0 and s >= 0.5) as fp,
        count(*) filter (y_true = 1 and s < 0.5) as fn
      from (select *, round_even({score}, 0) as s from {SCORED}) group by fold, target)) group by fold)"""


@query("a14_weighted_f1", f"select fold, round(f1, 6) as f1 from {weighted_f1_sql('score')}")
def a14(spark, d):
    return rounded(metrics.weighted_f1(scored_labels(spark, d), ["fold"]), "f1")


BASELINE = hash32("'0|' || target || '|' || id::varchar") + " / 4294967296.0::DOUBLE"


@query(
    "a15_against_baseline",
    f"""select a.fold, round(a.f1, 6) as f1_trained, round(b.f1, 6) as f1_random
        from {weighted_f1_sql('score')} a join {weighted_f1_sql(BASELINE)} b on a.fold = b.fold""",
)
def a15(spark, d):
    both = metrics.against_baseline(scored_labels(spark, d), "id", ["fold"])
    return rounded(both, "f1_trained", "f1_random")


@query(
    "a16_remove_duplicates",
    "select min(doc_id) as doc_id, lang from documents group by text, lang",
)
def a16(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return dedup.remove_duplicates(docs, "doc_id", ["text", "lang"]).select("doc_id", "lang")


@query(
    "a17_prepare_task",
    f"""select min(doc_id) as doc_id, quality from {DOCUMENTS_WITH_TARGETS}
        where quality is not null group by text, quality""",
)
def a17(spark, d):
    df = documents_with_targets(spark, d).select("doc_id", "text", "quality")
    return dedup.prepare_task(df, "doc_id", ["text"], "quality").select("doc_id", "quality")


@query(
    "a18_fold_summary",
    f"""select target, round(avg(accuracy), 6) as accuracy_mean, round(stddev_pop(accuracy), 6) as accuracy_std,
          round(avg(mcc), 6) as mcc_mean, round(stddev_pop(mcc), 6) as mcc_std from {CLASS_SCORES} group by target""",
)
def a18(spark, d):
    per_fold = metrics.evaluation(scored_labels(spark, d))
    out = metrics.fold_summary(per_fold, ["target"], ["accuracy", "mcc"])
    return rounded(out, *[c for c in out.columns if c != "target"])


@query(
    "a19_regression_scores",
    """with r as (select l_returnflag, l_extendedprice / 1000 as t, l_quantity * 1.4 as p from lineitem)
       select l_returnflag, round(sqrt(avg((t - p) * (t - p))), 6) as rmse, round(avg(abs(t - p)), 6) as mae,
         round(avg((t - p) * (t - p)), 6) as mse, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(t)), 6) as r2
       from r group by l_returnflag""",
)
def a19(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_returnflag",
        (F.col("l_extendedprice") / 1000).alias("t"),
        (F.col("l_quantity") * 1.4).alias("p"),
    )
    return rounded(metrics.regression_scores(rows, "t", "p", ["l_returnflag"]), "rmse", "mae", "mse", "r2")


@query(
    "a19_average_precision",
    f"""select target, fold, round(sum(pos * tp / (tp + fp)::DOUBLE) / max(p), 6) as prc_auc
        from {CURVE} group by target, fold""",
)
def a19b(spark, d):
    return rounded(metrics.average_precision(scored_labels(spark, d)), "prc_auc")


@query(
    "a20_evaluation",
    f"""select s.target, s.fold, round(p_0, 6) as p_0, round(r_0, 6) as r_0, round(f1_0, 6) as f1_0,
          round(p_1, 6) as p_1, round(r_1, 6) as r_1, round(f1_1, 6) as f1_1, round(loss, 6) as loss,
          round(accuracy, 6) as accuracy, round(balanced_accuracy, 6) as balanced_accuracy,
          round(mcc, 6) as mcc, round(auc, 6) as auc
        from {CLASS_SCORES} s
        join (select target, fold, avg(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))) as loss
              from {CLIPPED} group by target, fold) l on l.target = s.target and l.fold = s.fold
        join {PAIR_AUC} a on a.target = s.target and a.fold = s.fold""",
)
def a20(spark, d):
    out = metrics.evaluation(scored_labels(spark, d))
    return rounded(out, *[c for c in out.columns if c not in ("target", "fold")])


# Histories: one run per user.

RUNS = """(select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as epoch,
  value as val_loss from events)"""


def runs(spark, d):
    events = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("val_loss")
    )
    numbered = history.number_epochs(events, "run_id", "ts", "event_id")
    return numbered.select("run_id", "epoch", "val_loss")


# Every epoch is found by its place; recursion joins on run and epoch.
SMOOTHED = f"""with recursive h as materialized (select * from {RUNS}),
  s as (select run_id, epoch, val_loss as s from h where epoch = 0
        union all select h.run_id, h.epoch, s.s * 0.8::DOUBLE + h.val_loss * 0.2::DOUBLE
        from s join h on h.run_id = s.run_id and h.epoch = s.epoch + 1)"""


@query("w1_smooth", SMOOTHED + " select run_id, epoch, round(s, 5) as smoothed from s")
def w1(spark, d):
    out = history.smooth(runs(spark, d), "run_id", "epoch", "val_loss", 0.8)
    return out.select("run_id", "epoch", F.round("smoothed", 5).alias("smoothed"))


@query(
    "w1_smooth_with_gaps",
    f"""with recursive h as materialized (
    select run_id, epoch, val_loss, row_number() over (partition by run_id order by epoch) - 1 as i
    from {RUNS} where epoch % 7 <> 3 and epoch % 5 <> 0),
  s as (select run_id, epoch, i, val_loss as s from h where i = 0
        union all select h.run_id, h.epoch, h.i, s.s * 0.8::DOUBLE + h.val_loss * 0.2::DOUBLE
        from s join h on h.run_id = s.run_id and h.i = s.i + 1)
  select r.run_id, r.epoch, round(s.s, 5) as smoothed from {RUNS} r
    left join s on s.run_id = r.run_id and s.epoch = r.epoch where r.epoch % 7 <> 3""",
)
def w1_gaps(spark, d):
    # Some epochs are missing, others have no value.
    holes = runs(spark, d).filter("epoch % 7 <> 3").withColumn(
        "val_loss", F.when(F.col("epoch") % 5 != 0, F.col("val_loss"))
    )
    out = history.smooth(holes, "run_id", "epoch", "val_loss", 0.8)
    return out.select("run_id", "epoch", F.round("smoothed", 5).alias("smoothed"))


@query("w2_best_smoothed", SMOOTHED + " select run_id, round(max(s), 5) as best from s group by run_id")
def w2(spark, d):
    return rounded(history.best_smoothed(runs(spark, d), "run_id", "epoch", "val_loss"), "best", digits=5)


@query(
    "w3_best_epoch",
    f"""select run_id, epoch, val_loss from {RUNS}
        qualify row_number() over (partition by run_id order by val_loss, epoch) = 1""",
)
def w3(spark, d):
    return history.best_epoch(runs(spark, d), "run_id", "epoch", "val_loss")


@query(
    "w4_early_stop",
    f"""with recursive h as materialized (select * from {RUNS}),
  s as (select run_id, epoch, val_loss as best, epoch as best_epoch, 0::BIGINT as wait from h where epoch = 0
        union all
        select h.run_id, h.epoch, case when h.val_loss < s.best - 0.0001::DOUBLE then h.val_loss else s.best end,
          case when h.val_loss < s.best - 0.0001::DOUBLE then h.epoch else s.best_epoch end,
          case when h.val_loss < s.best - 0.0001::DOUBLE then 0 else s.wait + 1 end
        from s join h on h.run_id = s.run_id and h.epoch = s.epoch + 1 where s.wait < 20)
  select run_id, best, best_epoch, case when wait >= 20 then epoch end as stop_epoch
  from s qualify row_number() over (partition by run_id order by epoch desc) = 1""",
)
def w4(spark, d):
    return history.early_stop(runs(spark, d), "run_id", "epoch", "val_loss", patience=20, min_delta=0.0001)


@query(
    "w4_checkpoints",
    f"""select run_id, epoch as saved_epoch, val_loss as saved_value from {RUNS} where (epoch + 1) % 10 = 0
        qualify row_number() over (partition by run_id order by val_loss, epoch) = 1""",
)
def w4b(spark, d):
    return history.checkpoints(runs(spark, d), "run_id", "epoch", "val_loss", period=10)


@query(
    "w6_history_table",
    f"""select run_id, epoch, 'val_loss' as metric, val_loss as value from {RUNS}
        union all select run_id, epoch, 'val_half', val_loss / 2 from {RUNS}""",
)
def w6(spark, d):
    wide = runs(spark, d).withColumn("val_half", F.col("val_loss") / 2)
    long = history.history_long(wide, "run_id", "epoch", ["val_loss", "val_half"])
    again = history.history_wide(long, "run_id", "epoch", ["val_loss", "val_half"])
    return history.history_long(again, "run_id", "epoch", ["val_loss", "val_half"])
