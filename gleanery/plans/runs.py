"""Queries of whole runs, judged metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import evaluation as E
from gleanery.operators import judging, pipelines, reports, serving
from gleanery.plans.evaluate import LEXICAL_SQL, bm25_scores, long_sql
from gleanery.plans.registry import ANSWERS_SQL, answers, filings, query, questions


@query(f"with {LEXICAL_SQL}, {long_sql('lf', 'sc')} select question_type, round(avg(val) filter (where metric = 'ndcg@10'), 4) as \"ndcg@10\", round(avg(val) filter (where metric = 'recall@10'), 4) as \"recall@10\" from (select question_type, metric, val from lf join questions using (question_id) union all select '(all)', metric, val from lf) group by question_type")
def report_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by metrics."""
    return reports.slice_table(E.aggregates(E.long_form(bm25_scores(spark, sf_dir)), questions(spark, sf_dir)), ["ndcg@10", "recall@10"])


@query(
    "select t.question_type, cast(coalesce(n, 0) as bigint) as n, cast(target as bigint) as target, cast(coalesce(n, 0) - target as bigint) as gap from (values ('single_hop', 55), ('numeric_table', 40), ('multi_hop', 35), ('comparative_temporal', 25), ('unanswerable', 30), ('ambiguous', 20), ('adversarial', 15)) t(question_type, target) left join (select question_type, count(*) as n from questions group by 1) c using (question_type)"
)
def report_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set against the targets of a full one."""
    return reports.composition(questions(spark, sf_dir).groupBy("question_type").agg(F.count("*").alias("n")))


@query()
def run_retrieval_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung of the retrieval ladder over all filings and questions, every metric held against the rung before."""
    out = None
    for step, run in enumerate(pipelines.sweep(pipelines.RETRIEVAL_LADDER, filings(spark, sf_dir), questions(spark, sf_dir))):
        rows = run.scores.select(F.lit(step).alias("step"), F.lit(run.label).alias("label"), "question_id", "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return reports.ladder_paired(out)


@query()
def run_generation_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of the full pipeline, with the judge that needs no model."""
    config = pipelines.GENERATION_LADDER[-1]
    run = pipelines.evaluate(config, pipelines.Indexes(filings(spark, sf_dir)), questions(spark, sf_dir), judging.lexical_judge)
    return run.aggregates.select(F.lit(run.run_id).alias("run_id"), "metric", "question_type", F.round("mean", 4).alias("mean"), "n", "n_undefined")


@query(
    f"""select trace_id, case when "error" is null and answer is not null then answer else '(unavailable)' end as shown, not ("error" is null and answer is not null) as degraded from {ANSWERS_SQL}"""
)
def serve_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, or a fallback where the stage failed."""
    value, degraded = serving.degrade(F.col("answer"), F.lit("(unavailable)"), F.col("error").isNull())
    return answers(spark, sf_dir).select("trace_id", value.alias("shown"), degraded.alias("degraded"))
