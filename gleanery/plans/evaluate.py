"""Queries of evaluation: labels, metrics, intervals, agreement, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import evaluation as E
from gleanery.operators import retrieval as R
from gleanery.plans.registry import ANSWERS_SQL, CHUNKS_SQL, answers, chunks, query, questions
from gleanery.plans.search import BM25_SQL, HYBRID_SQL, bucket_hits, hits, ranked_sql
from gleanery.session import checkpointed

SPAN_QRELS_SQL = f"""spans as (select question_id, g.doc_id as doc_id, g.char_start as g_start, g.char_end as g_end, g.weight as weight from (select question_id, unnest(gold_spans) as g from questions)),
span_qrels as (select question_id, chunk_id, max(case when share >= 0.9 then case when weight >= 1.0 then 2 else 1 end when share >= 0.25 then 1 else 0 end) as relevance from (
 select s.question_id, c.chunk_id, s.weight, case when g_end = g_start then 1.0 else (least(c.char_end, g_end) - greatest(c.char_start, g_start)) / (g_end - g_start) end as share
 from spans s join {CHUNKS_SQL} c on c.doc_id = s.doc_id and ((c.char_start < g_end and g_start < c.char_end) or (g_start = g_end and c.char_start <= g_start and g_start < c.char_end))) group by all having relevance > 0)"""
QRELS_SQL = f"""{SPAN_QRELS_SQL},
qrels as (select * from span_qrels union all select question_id, g.chunk_id, g.relevance from (select question_id, unnest(gold_chunks) as g from questions where coalesce(len(gold_spans), 0) = 0) where g.relevance > 0)"""


@query(f"with {QRELS_SQL} select question_id, chunk_id, cast(relevance as integer) as relevance from qrels")
def eval_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded labels of every question for the stored chunks."""
    return E.relevance(questions(spark, sf_dir), chunks(spark, sf_dir))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(E.relevance(questions(spark, sf_dir), chunks(spark, sf_dir)))


@query(
    f"""with {QRELS_SQL} select q.question_id, cast(count(r.chunk_id) as bigint) as n_relevant, count(r.chunk_id) = 0 as lost, count(r.chunk_id) > 0 and any_value(len(list_filter(q.gold_spans, lambda g: g.weight >= 1.0)) > 0) and max(r.relevance) < 2 as degraded
 from questions q left join qrels r using (question_id) where len(q.gold_spans) > 0 group by q.question_id"""
)
def eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(questions(spark, sf_dir), qrels(spark, sf_dir))


@query(
    f"""select question_id, array_to_string(list_sort(list(distinct chunk_id)), ' ') as missing from (select question_id, g.chunk_id from (select question_id, unnest(gold_chunks) as g from questions)) l
 where not exists (select 1 from chunks c where c.chunk_id = l.chunk_id and c.metadata.form_type = '10-K') group by question_id"""
)
def eval_stale_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold chunks that a corpus of annual reports alone does not have."""
    labels = questions(spark, sf_dir).select("question_id", F.explode("gold_chunks").alias("g")).select("question_id", "g.chunk_id")
    stale = labels.join(chunks(spark, sf_dir).filter("form_type = '10-K'").select("chunk_id"), "chunk_id", "left_anti")
    return stale.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), " ").alias("missing"))


def scores_sql(name: str, source: str) -> str:
    return f"""{name}_g as (select h.query_id as question_id, h.chunk_id, h.rank, coalesce(r.relevance, 0) as rel from {source} h left join qrels r on r.question_id = h.query_id and r.chunk_id = h.chunk_id),
{name}_gold as (select question_id, count(*) as n_gold, count(*) filter (where relevance >= 2) as n_answer from qrels group by question_id),
{name}_ideal as (select question_id, row_number() over (partition by question_id order by relevance desc, chunk_id) as place, relevance from qrels),
{name} as (select q.question_id, k, case when n_gold > 0 then count(distinct case when g.rank <= k and rel >= 1 then g.chunk_id end) / n_gold end as recall,
 case when n_answer > 0 then count(distinct case when g.rank <= k and rel >= 2 then g.chunk_id end) / n_answer end as answer_recall,
 case when n_gold > 0 then case when count(g.rank) filter (where g.rank <= k) = 0 then 0.0 else count(*) filter (where g.rank <= k and rel >= 1) / count(*) filter (where g.rank <= k) end end as "precision",
 case when n_gold > 0 then case when count(*) filter (where g.rank <= k and rel >= 1) > 0 then 1.0 else 0.0 end end as hit_rate,
 case when n_gold > 0 then coalesce(1 / min(g.rank) filter (where g.rank <= k and rel >= 1), 0.0) end as mrr,
 case when n_gold > 0 then coalesce(sum((pow(2, rel) - 1) / log2(g.rank + 1)) filter (where g.rank <= k), 0.0) / (select sum((pow(2, relevance) - 1) / log2(place + 1)) from {name}_ideal i where i.question_id = q.question_id and i.place <= k) end as ndcg
 from questions q cross join (values (1), (5), (10), (20)) ks(k) left join {name}_g g on g.question_id = q.question_id left join {name}_gold o on o.question_id = q.question_id group by q.question_id, k, n_gold, n_answer)"""


LEXICAL_SQL = f"{BM25_SQL}, {QRELS_SQL}, {ranked_sql('bm', 'scored', 20)}, {scores_sql('sc', 'bm')}"


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(E.retrieval_metrics(hits(spark, sf_dir, 20), qrels(spark, sf_dir), questions(spark, sf_dir)))


def both_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores of lexical and of hybrid retrieval; the corpus is searched once for both, and read once by each."""
    lexical, labels, asked = hits(spark, sf_dir, R.FETCH_DEPTH), qrels(spark, sf_dir), questions(spark, sf_dir)
    fused = R.top_k(R.reciprocal_rank_fusion(lexical, bucket_hits(spark, sf_dir, R.FETCH_DEPTH)), 20)
    return tuple(checkpointed(E.retrieval_metrics(found, labels, asked)) for found in (lexical.filter("rank <= 20"), fused))


@query(f"with {LEXICAL_SQL} select question_id, cast(k as integer) as k, round(recall, 6) as recall, round(answer_recall, 6) as answer_recall, round(\"precision\", 6) as \"precision\", cast(hit_rate as double) as hit_rate, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg from sc")
def eval_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics at four depths for every question."""
    s = bm25_scores(spark, sf_dir)
    return s.select("question_id", "k", *[F.round(m, 6).alias(m) if m != "hit_rate" else F.col(m) for m in E.METRICS])


def long_sql(name: str, source: str) -> str:
    return f"""{name} as (select question_id, m || '@' || k as metric, case m when 'recall' then recall when 'answer_recall' then answer_recall when 'precision' then "precision" when 'hit_rate' then hit_rate when 'mrr' then mrr else ndcg end as val
 from {source} cross join (values ('recall'), ('answer_recall'), ('precision'), ('hit_rate'), ('mrr'), ('ndcg')) ms(m))"""


@query(
    f"""with {LEXICAL_SQL}, {long_sql('lf', 'sc')} select metric, case when grouping(question_type) = 1 then '(all)' else question_type end as question_type, round(avg(val), 4) as mean, cast(count(val) as bigint) as n, cast(count(*) filter (where val is null) as bigint) as n_undefined
 from lf join questions using (question_id) group by grouping sets ((metric), (metric, question_type))"""
)
def eval_slice_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all questions and by slice, in one aggregate with grouping sets."""
    a = E.aggregates(E.long_form(bm25_scores(spark, sf_dir)), questions(spark, sf_dir))
    return a.select("metric", "question_type", F.round("mean", 4).alias("mean"), "n", "n_undefined")


def boot_sql(name: str, source: str, resamples: int) -> str:
    return f"""{name}_n as (select metric, question_id, val, row_number() over (partition by metric order by substr(md5(question_id), 1, 2), question_id) - 1 as place, count(*) over (partition by metric) as n from {source} where val is not null),
{name}_d as (select metric, r, cast('0x' || substr(md5('20260906:' || r || ':' || place), 1, 8) as bigint) % n as place from {name}_n, range({resamples}) t(r)),
{name}_m as (select d.metric, d.r, avg(v.val) as mean from {name}_d d join {name}_n v on v.metric = d.metric and v.place = d.place group by d.metric, d.r),
{name} as (select metric, quantile_cont(mean, 0.025) as ci_low, quantile_cont(mean, 0.975) as ci_high from {name}_m group by metric)"""


@query(
    f"""with {LEXICAL_SQL}, {long_sql('lf', 'sc')}, ten as (select * from lf where metric like '%@10'), {boot_sql('bt', 'ten', 10000)}
select t.metric, round(avg(val), 4) as mean, round(any_value(ci_low), 4) as ci_low, round(any_value(ci_high), 4) as ci_high, cast(count(val) as bigint) as n from ten t left join bt using (metric) group by t.metric"""
)
def eval_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of the means at depth ten."""
    ten = E.long_form(bm25_scores(spark, sf_dir)).filter("metric like '%@10'")
    return E.bootstrap_interval(ten).select("metric", *[F.round(c, 4).alias(c) for c in ("mean", "ci_low", "ci_high")], "n")


PAIRED_SQL = f"""{HYBRID_SQL}, {QRELS_SQL}, {ranked_sql('bm', 'scored', 20)}, {scores_sql('sc', 'bm')}, {ranked_sql('hy', 'fused', 20)}, {scores_sql('sh', 'hy')}, {long_sql('la', 'sc')}, {long_sql('lb', 'sh')},
both_ as (select la.metric, la.question_id, la.val as a, lb.val as b from la full join lb using (metric, question_id)), diffs as (select metric, question_id, b - a as val from both_ where a is not null and b is not null)"""


@query(
    f"""with {PAIRED_SQL}, {boot_sql('bt', 'diffs', 10000)}, acc as (select metric, count(*) filter (where a is not null and b is not null) as n_pairs, count(*) filter (where a is null or b is null) as n_dropped from both_ group by metric)
select acc.metric, round(avg(val), 4) as delta, round(any_value(ci_low), 4) as ci_low, round(any_value(ci_high), 4) as ci_high, cast(any_value(n_pairs) as bigint) as n_pairs, cast(any_value(n_dropped) as bigint) as n_dropped, any_value(ci_low) > 0 or any_value(ci_high) < 0 as significant
 from acc left join diffs using (metric) left join bt using (metric) group by acc.metric"""
)
def eval_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid against lexical retrieval, question by question."""
    p = E.paired_bootstrap(*map(E.long_form, both_scores(spark, sf_dir)))
    return p.select("metric", *[F.round(c, 4).alias(c) for c in ("delta", "ci_low", "ci_high")], "n_pairs", "n_dropped", "significant")


@query(
    f"""with {PAIRED_SQL} select metric, cast(count(*) as bigint) as n, round(stddev_samp(val), 4) as sd, round(1.96 * stddev_samp(val) / sqrt(count(*)), 4) as detectable, cast(case when stddev_samp(val) = 0 then 2 else floor(pow(1.96 * stddev_samp(val) / 0.02, 2)) + 1 end as bigint) as required_n from diffs group by metric having count(*) >= 2"""
)
def eval_paired_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.paired_power(*map(E.long_form, both_scores(spark, sf_dir)))
    return p.select("metric", "n", F.round("sd", 4).alias("sd"), F.round("detectable", 4).alias("detectable"), "required_n")


@query(
    f"""with {PAIRED_SQL}, base as (select metric, avg(val) as mean from la group by metric), cand as (select metric, avg(val) as mean from lb group by metric),
limits as (select * from (values ('ndcg@10', -0.02), ('recall@10', -0.02), ('groundedness', -0.03), ('answer_correctness', -0.03), ('context_sufficiency', -0.03), ('false_refusal', 0.05), ('answered_unanswerable', 0.05), ('latency_ms', 500.0), ('citation_fabrication_rate', 0.0)) l(metric, lim))
select l.metric, round(b.mean, 4) as before, round(c.mean, 4) as after, case when l.metric = 'citation_fabrication_rate' then case when c.mean is null then 'SKIP' when c.mean > lim then 'FAIL' else 'PASS' end when c.mean - b.mean is null then 'SKIP'
 when lim < 0 and c.mean - b.mean < lim then 'FAIL' when lim >= 0 and c.mean - b.mean > lim then 'FAIL' else 'PASS' end as verdict from limits l left join base b using (metric) left join cand c using (metric) union all select 'judge_errors', null, 0.0, 'PASS'"""
)
def eval_regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = lambda s: E.long_form(s).groupBy("metric").agg(F.avg("value").alias("mean"))
    g = E.gate(*map(means, both_scores(spark, sf_dir)))
    return g.select("metric", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), "verdict")


LABELS_SQL = f"""{SPAN_QRELS_SQL}, labels as (select 'relevance' as metric, coalesce(s.relevance, 0) as human, c.relevance as judge from (select question_id, g.chunk_id as chunk_id, g.relevance as relevance from (select question_id, unnest(gold_chunks) as g from questions where len(gold_spans) > 0)) c left join span_qrels s using (question_id, chunk_id)),
cell as (select metric, human as i, judge as j, count(*) as n from labels group by all), tot as (select metric, sum(n) as t from cell group by metric), rw as (select metric, i, sum(n) as r from cell group by all), cl as (select metric, j, sum(n) as c from cell group by all)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by span overlap against the stored chunk label, as two raters."""
    q = questions(spark, sf_dir)
    stored = q.filter(F.size("gold_spans") > 0).select("question_id", F.explode("gold_chunks").alias("g")).select("question_id", "g.chunk_id", F.col("g.relevance").alias("judge"))
    spans = q.select("question_id", F.explode("gold_spans").alias("g")).select("question_id", "g.doc_id", "g.char_start", "g.char_end", "g.weight")
    derived = E.resolve_spans(spans, chunks(spark, sf_dir))
    return stored.join(derived, ["question_id", "chunk_id"], "left").select(F.lit("relevance").alias("metric"), F.coalesce("relevance", F.lit(0)).alias("human"), "judge")


def _kappa_query(weighting: str, weight: str):
    @query(
        f"""with {LABELS_SQL}, ob as (select metric, sum({weight} * n) as o, sum(case when i = j then n else 0 end) as agree from cell group by metric), ex as (select metric, sum({weight} * r * c) as e from rw join cl using (metric) group by metric)
select metric, round(1 - (o / t) / nullif(e / (t * t), 0), 4) as kappa, round(agree / t, 4) as raw_agreement, cast(t as bigint) as n from ob join ex using (metric) join tot using (metric)"""
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = E.kappa(labels(spark, sf_dir), (0, 1, 2), weighting)
        return k.select("metric", F.round("kappa", 4).alias("kappa"), F.round("raw_agreement", 4).alias("raw_agreement"), "n")

    return run


for _weighting, _weight in (("unweighted", "(case when i = j then 0.0 else 1.0 end)"), ("linear", "(abs(i - j) / 2.0)"), ("quadratic", "(pow(abs(i - j) / 2.0, 2))")):
    # registered under a name of its own
    from gleanery.plans.registry import ORACLES, QUERIES

    _kappa_query(_weighting, _weight)
    QUERIES[f"eval_kappa_{_weighting}"], ORACLES[f"eval_kappa_{_weighting}"] = QUERIES.pop("run"), ORACLES.pop("run")


@query(
    """select question_type, cast(count(*) as bigint) as n, cast(count(*) filter (where verified_by is not null and verified_at is not null) as bigint) as n_verified, cast(count(*) filter (where provenance = 'llm_generated') as bigint) as n_generated,
 cast(count(*) filter (where len(gold_chunks) > 0 or len(gold_spans) > 0) as bigint) as n_answerable, cast(count(*) filter (where len(history) > 0) as bigint) as n_multi_turn, round(avg(coalesce(len(gold_chunks), 0) + coalesce(len(gold_spans), 0)) filter (where len(gold_chunks) > 0 or len(gold_spans) > 0), 4) as mean_evidence from questions group by question_type"""
)
def eval_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    answerable = (size("gold_chunks") > 0) | (size("gold_spans") > 0)
    return questions(spark, sf_dir).groupBy("question_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("verified_by").isNotNull() & F.col("verified_at").isNotNull()).alias("n_verified"),
        F.count_if(F.col("provenance") == "llm_generated").alias("n_generated"),
        F.count_if(answerable).alias("n_answerable"),
        F.count_if(size("history") > 0).alias("n_multi_turn"),
        F.round(F.avg(F.when(answerable, size("gold_chunks") + size("gold_spans"))), 4).alias("mean_evidence"),
    )


@query(
    """with p as (select question_id, question_type, md5('0:' || question_id) as code, row_number() over (partition by question_type order by md5('0:' || question_id), question_id) as place, (select count(distinct question_type) from questions) as types from questions)
select question_id, question_type from (select *, row_number() over (order by case when place > greatest(1, 21 // types) then 1 else 0 end, code, question_id) as r from p) where r <= 21"""
)
def eval_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-one questions for hand labelling, an equal share of each type."""
    return E.stratified_sample(questions(spark, sf_dir).select("question_id", "question_type"), 21)


_RULES_SQL = {
    "no id": "coalesce(trim(question_id), '') = ''",
    "no question": "coalesce(trim(question), '') = ''",
    "repeated gold chunk": "len(list_distinct(list_transform(coalesce(gold_chunks, []), lambda g: g.chunk_id))) < nc",
    "unanswerable with evidence": "question_type = 'unanswerable' and (nc > 0 or ns > 0)",
    "unanswerable with answer": "question_type = 'unanswerable' and not na",
    "no sufficient span": "question_type <> 'unanswerable' and ns > 0 and len(list_filter(gold_spans, lambda g: g.weight >= 1.0)) = 0",
    "spans without answer": "question_type <> 'unanswerable' and ns > 0 and na",
    "no sufficient chunk": "question_type <> 'unanswerable' and ns = 0 and nc > 0 and len(list_filter(gold_chunks, lambda g: g.relevance >= 2)) = 0",
    "chunks without answer": "question_type <> 'unanswerable' and ns = 0 and nc > 0 and na",
    "no evidence": "question_type not in ('unanswerable', 'ambiguous') and ns = 0 and nc = 0",
    "ambiguous with answer": "question_type = 'ambiguous' and ns = 0 and nc = 0 and not na",
}


@query(
    "with q as (select *, coalesce(len(gold_chunks), 0) as nc, coalesce(len(gold_spans), 0) as ns, coalesce(trim(gold_answer), '') = '' as na from questions) select question_id, problems from (select question_id, array_to_string(list_filter(["
    + ", ".join(f"case when {rule} then '{name}' end" for name, rule in _RULES_SQL.items())
    + "], lambda x: x is not null), ', ') as problems from q) where problems <> ''"
)
def eval_dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that break a rule of the data set, with the rules."""
    return E.problems(questions(spark, sf_dir)).withColumn("problems", F.array_join("problems", ", "))


@query(
    f"""select trace_id, cast(n as bigint) as n_citations, cast(known as bigint) as n_resolvable, cast(fab as bigint) as n_fabricated, round(case when n > 0 then (n - known) / n end, 6) as fabrication_rate, trim(coalesce(answer, '')) <> '' and not coalesce(refused, false) and n = 0 as uncited from (
 select a.trace_id, any_value(a.answer) as answer, any_value(a.refused) as refused, count(e.cid) as n, count(c.chunk_id) as known, count(distinct case when c.chunk_id is null then e.cid end) as fab from {ANSWERS_SQL} a
 left join (select trace_id, unnest(flatten(list_transform(citations, lambda c: c.chunk_ids))) as cid from {ANSWERS_SQL}) e using (trace_id) left join {CHUNKS_SQL} c on c.chunk_id = e.cid group by a.trace_id)"""
)
def eval_citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every answer that resolve, and those made up."""
    c = E.citation_validity(answers(spark, sf_dir), "trace_id", chunks(spark, sf_dir))
    return c.withColumn("fabrication_rate", F.round("fabrication_rate", 6))


@query(
    f"""select model_name, round(avg(case when not an then cast(refused as integer) end), 6) as correct_refusal, round(avg(case when not an then 1 - cast(refused as integer) end), 6) as answered_unanswerable, round(avg(case when an then cast(refused as integer) end), 6) as false_refusal, cast(count(*) as bigint) as n
 from (select a.model_name, a.refused, len(q.gold_chunks) > 0 or len(q.gold_spans) > 0 as an from {ANSWERS_SQL} a join questions q using (question_id)) group by model_name"""
)
def eval_refusal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of answers to known questions, by model."""
    q = questions(spark, sf_dir).select("question_id", ((F.size("gold_chunks") > 0) | (F.size("gold_spans") > 0)).alias("answerable"))
    joined = answers(spark, sf_dir).join(q, "question_id")
    scored = joined.select("model_name", *E.refusal_scores(F.col("answerable"), F.col("refused")))
    return scored.groupBy("model_name").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("correct_refusal", "answered_unanswerable", "false_refusal")], F.count("*").alias("n"))
