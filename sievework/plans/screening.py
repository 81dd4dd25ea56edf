"""The work from raw tables to an evaluation table, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.hashing import uniform
from sievework.operators.frame import valid_rows
from sievework.operators.metrics import evaluation
from sievework.operators.splits import stratified_split
from sievework.plans.registry import DOCUMENTS_WITH_TARGETS, documents_with_targets, query


SCREENING = f"""with rows as (
     select doc_id, quality as y_true, n_chars from {DOCUMENTS_WITH_TARGETS}
     where quality is not null and text is not null),
   split as (select *, row_number() over (partition by y_true order by md5('42|' || doc_id::varchar), doc_id)
       <= ceil(0.3 * count(*) over (partition by y_true)) as is_test from rows),
   scored as (select y_true, ('0x' || substr(md5('1|' || doc_id::varchar), 1, 8))::BIGINT / 4294967296.0::DOUBLE as score
     from split where is_test),
   c as (select count(*) filter (y_true = 0 and score < 0.5) as tn, count(*) filter (y_true = 0 and score >= 0.5) as fp,
     count(*) filter (y_true = 1 and score < 0.5) as fn, count(*) filter (y_true = 1 and score >= 0.5) as tp from scored),
   pairs as (select sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end)::DOUBLE as wins
     from scored a join scored b on a.y_true = 1 and b.y_true = 0)
   select 'quality' as target, 0 as fold, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) as accuracy,
     round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) as p_1, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) as r_1,
     round(wins / ((tp + fn)::DOUBLE * (tn + fp)), 6) as auc from c, pairs"""


@query("screening_report", SCREENING)
def screening_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join labels, drop gaps, hold out a stratified test part, score it and evaluate."""
    rows = valid_rows(documents_with_targets(spark, sf_dir), "quality", "text")
    placed = stratified_split(rows.select("doc_id", "quality"), "doc_id", "quality", 0.3)
    scored = placed.filter(F.col("split") == "test").select(
        F.lit("quality").alias("target"),
        F.lit(0).alias("fold"),
        F.col("quality").alias("y_true"),
        uniform(F.col("doc_id"), 1).alias("score"),
    )
    report = evaluation(scored)
    return report.select(
        "target", "fold", *[F.round(c, 6).alias(c) for c in ("accuracy", "p_1", "r_1", "auc")]
    )
