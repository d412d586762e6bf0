"""Queries of operators that work beside retrieval: data sets, spans, stores, requests, judges, reports, attacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import answering, chunking, judging, parsing, plugins, refusal, reports, security, serving, tracing
from gleanery.operators import evaluation as E
from gleanery.operators import retrieval as R
from gleanery.plans.evaluate import LEXICAL_SQL, bm25_scores, long_sql
from gleanery.plans.registry import ANSWERS_SQL, CHUNKS_SQL, FILINGS_SQL, ORACLES, answers, chunks, filings, query, questions
from gleanery.plans.search import BM25_SQL, TOP5_SQL, asked, hits, ranked_sql
from gleanery.plans.serve import PRINCIPALS, ROLES_SQL, roles
from gleanery.plans.texts import strip_sql
from gleanery.session import checkpointed, shared_folder, table
from gleanery.sources import filings_index

# ---- data sets and spans


@query("select question_id, question_type from questions where question_type in ('numeric_table', 'multi_hop') and verified_by is not null and verified_at is not null order by question_id limit 50")
def eval_selected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty verified questions of two types."""
    return E.select_questions(questions(spark, sf_dir), types=["numeric_table", "multi_hop"], verified=True, limit=50).select("question_id", "question_type")


@query(f"""select question_id, cast(place - 1 as integer) as place, substr(d."text", g.char_start + 1, g.char_end - g.char_start) as evidence from (select question_id, unnest(gold_spans) as g, generate_subscripts(gold_spans, 1) as place from questions) join {FILINGS_SQL} d on d.doc_id = g.doc_id""")
def parse_gold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every gold span."""
    spans = questions(spark, sf_dir).select("question_id", F.posexplode("gold_spans").alias("place", "g"))
    joined = spans.join(filings(spark, sf_dir).select("doc_id", "text"), F.col("g.doc_id") == F.col("doc_id"))
    return joined.select("question_id", "place", parsing.slice_span(F.col("text"), F.col("doc_id"), F.col("g.doc_id"), F.col("g.char_start"), F.col("g.char_end")).alias("evidence"))


@query(
    f"""with w as ({ORACLES["chunk_fixed"]}), d as (select doc_id, metadata['company'] as company, try_cast(metadata['fiscal_year'] as integer) as fiscal_year, metadata['form_type'] as form_type, sections, doc_tables from {FILINGS_SQL})
select w.chunk_id, company, fiscal_year, form_type, list_filter(sections, lambda s: s.char_start <= w.char_start and w.char_start < s.char_end)[1].section_name as section, 'fixed' as chunker,
 coalesce(len(list_filter(doc_tables, lambda t: least(t.char_end, w.char_end) > greatest(t.char_start, w.char_start))) > 0, false) as contains_table from w join d using (doc_id)"""
)
def chunk_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows with the metadata of their filing, their section and whether they hold a table."""
    documents = filings(spark, sf_dir)
    return chunking.described(chunking.fixed(documents), documents, "fixed").select("chunk_id", "company", "fiscal_year", "form_type", "section", "chunker", "contains_table")


# ---- stores


@query(f"select source_url, substr(sha256(source_url), 1, 24) as store_key from {FILINGS_SQL} where source_url is not null")
def source_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).filter("source_url is not null").select("source_url", filings_index.url_key(F.col("source_url")).alias("store_key"))


@query(f"select doc_id, cast(length(\"text\") as integer) as n_chars, cast(coalesce(len(sections), -1) as integer) as n_sections, source_url from {FILINGS_SQL}")
def source_documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings written as JSON records and read again."""
    documents, folder = filings(spark, sf_dir), shared_folder(spark, "documents")
    filings_index.write_documents(documents, folder)
    again = filings_index.read_documents(spark, folder, documents.schema)
    return again.select("doc_id", F.length("text").alias("n_chars"), F.coalesce(F.size("sections"), F.lit(-1)).alias("n_sections"), "source_url")


@query("select vec_id, label, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total from embeddings")
def source_index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written with the identity of its embedder and read by the same one."""
    folder, embedder = shared_folder(spark, "index"), {"name": "stored", "dim": 64}
    filings_index.write_index(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"), folder, embedder)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return filings_index.read_index(spark, folder, embedder).select("vec_id", "label", F.round(total, 4).alias("total"))


@query("select question_id, question, question_type from questions")
def source_dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as JSON lines between comments and blank lines, and read back as records."""
    folder = shared_folder(spark, "dataset")
    lines = filings_index.dataset_lines(questions(spark, sf_dir).select("question_id", "question", "question_type"), "question_id").select("line")
    notes = spark.createDataFrame([("// a comment",), ("",), ("   ",)], "line string")
    lines.unionByName(notes).write.text(folder)
    return filings_index.require_records(filings_index.read_dataset(spark, folder, "question_id string, question string, question_type string")).drop("line_no")


@query("""select trace_id, arg_max(model_name, answered_at) as model_name from answers where substr(trace_id, 1, 1) <> 'a' group by trace_id""")
def source_purged_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last payload of every key of a response store, after one namespace is purged."""
    puts = table(spark, sf_dir, "answers").select(F.concat(F.substring("trace_id", 1, 1), F.lit(":"), "trace_id").alias("key"), "model_name", "answered_at")
    kept = filings_index.purge(filings_index.latest_wins(puts, "key", "model_name", "answered_at"), "a")
    return kept.select(F.substring("key", 3, 1000).alias("trace_id"), "model_name")


@query("select metric, cast(count(*) as bigint) as n from quantile_marks group by metric")
def source_promoted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run made the baseline and loaded as such; before that there is none."""
    folder = shared_folder(spark, "baseline")
    if filings_index.baseline(spark, folder) is not None:
        raise RuntimeError("a baseline before any was promoted")
    filings_index.promote(table(spark, sf_dir, "quantile_marks"), folder)
    return filings_index.baseline(spark, folder).groupBy("metric").agg(F.count("*").alias("n"))


# ---- requests


@query(
    """select question_id, md5(concat_ws(chr(0), question, array_to_string(list_transform(coalesce(history, []), lambda h: concat_ws(chr(0), h.question, h.answer)), chr(0)), array_to_string(list_sort(list_distinct([question_type, 'public'])), chr(0)))) as request_key from questions where question_type is not null"""
)
def serve_request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must be equal for two requests to share an answer, as a digest."""
    asked = questions(spark, sf_dir).filter("question_type is not null")
    return asked.select("question_id", F.md5(serving.cache_key(F.col("question"), F.col("history"), F.array("question_type", F.lit("public")))).alias("request_key"))


@query(f"""select trace_id from (select trace_id, coalesce(token_usage.input_tokens % 5, 0) as hits, answered_at, "error" from {ANSWERS_SQL}) where "error" is null and trace_id is not null order by hits desc, answered_at desc, trace_id limit 300""")
def serve_cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of 300 entries holds after all answers came: few hits, then age, make room."""
    made = answers(spark, sf_dir).filter("trace_id is not null").select("trace_id", F.coalesce(F.col("token_usage.input_tokens") % 5, F.lit(0)).alias("hits"), F.col("answered_at").alias("created_at"), "error")
    return serving.cache_put(made.drop("error").limit(0), made, 300).select("trace_id")


@query(
    """with r as (select question_id, question, coalesce(len(history), 0) as h, row_number() over (partition by question order by question_id) as nth, length(question_id) % 2 = 0 as known from questions where question is not null)
select question_id as request_id, bool_or(known) over (partition by question) as cache_hit, case when bool_or(known) over (partition by question) then 'kept: ' else 'made: ' end || question as answer, cast(null as varchar) as "error" from r where h = 0"""
)
def serve_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of requests against a cache that knows some of them."""
    requests = questions(spark, sf_dir).filter("question is not null and coalesce(size(history), 0) <= 0").select(F.col("question_id").alias("request_id"), "question", "history", F.lit(None).cast("array<string>").alias("roles"))
    key = serving.cache_key(F.col("question"), F.col("history"), F.col("roles"))
    entries = requests.filter(F.length("request_id") % 2 == 0).select(key.alias("key"), F.concat(F.lit("kept: "), "question").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(1000.0).alias("created_at"))
    make = lambda missing: missing.select("key", F.concat(F.lit("made: "), "question").alias("answer"), F.lit(None).cast("string").alias("error"))
    return serving.serve(requests, entries, make, now=1500.0)[0]


@query("select question_id as request_id, 'question length' as problems from questions where not coalesce(length(question), 0) between 1 and 2000 union all select question_id, 'top_k' from questions where coalesce(length(question), 0) between 1 and 2000 and length(question) % 7 = 0")
def serve_invalid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    top_k = (F.length("question") % 7).cast("int")
    made = questions(spark, sf_dir).select(F.col("question_id").alias("request_id"), "question", F.lit(None).cast("array<string>").alias("history"), F.when(F.coalesce(F.length("question"), F.lit(0)).between(1, 2000), top_k).otherwise(5).alias("top_k"), F.lit(None).cast("array<string>").alias("roles"))
    return serving.invalid_requests(made).withColumn("problems", F.array_join("problems", " "))


@query(f"select 'ok' as status, (select cast(count(*) as bigint) from {CHUNKS_SQL}) as n_chunks, (select cast(count(*) as bigint) from {ANSWERS_SQL}) as n_cached, 90.0::double as uptime_s")
def serve_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.health(chunks(spark, sf_dir), answers(spark, sf_dir), 10.0, 100.0)


@query("select * from (values ('answer', cast(1 as integer), cast(null as varchar)), ('generate', 1, 'ValueError: no passage'), ('question', 0, null), ('retrieve', 1, null)) t(span_name, depth, \"error\")")
def serve_traced_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of one request over the smallest table: nested, with the error of a stage that another one replaced."""

    def refuse(_: tracing.Span) -> None:
        raise OSError("the exporter is gone")

    tracer = tracing.Tracer(refuse)
    with tracer.span("question", rows=table(spark, sf_dir, "region").count()):
        with tracer.span("retrieve"):
            table(spark, sf_dir, "region").limit(1).collect()
        try:
            with tracer.span("generate"):
                raise ValueError("no passage")
        except ValueError:
            pass
        with tracer.span("answer"):
            pass
    return tracer.rows(spark).select("span_name", "depth", "error")


# ---- refusal and contexts


@query(f"with {TOP5_SQL}, s as (select query_id, max(score) as top from top5 group by query_id) select question_id as query_id, coalesce(round(top, 6) < 12.0, true) as refused from questions left join s on query_id = question_id")
def refusal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions are refused: those without hits, or whose best score is below twelve."""
    signals = asked(spark, sf_dir).join(refusal.confidence(hits(spark, sf_dir, 5)), "query_id", "left")
    return refusal.refused(signals.withColumn("top_score", F.round("top_score", 6)), "top_score", 12.0).select("query_id", "refused")


_OF_DOCUMENT_SQL = f"(select doc_id, list(chunk_id order by char_start, chunk_id) as ids, list(\"text\" order by char_start, chunk_id) as texts from {CHUNKS_SQL} where \"text\" is not null group by doc_id)"


def _of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every filing in their order; a filing bounds them."""
    each = F.array_sort(F.collect_list(F.struct("char_start", "chunk_id", "text")))
    made = chunks(spark, sf_dir).filter("text is not null").groupBy("doc_id").agg(each.alias("c"))
    return made.select("doc_id", F.transform("c", lambda c: c["chunk_id"]).alias("ids"), F.transform("c", lambda c: c["text"]).alias("texts"))


@query(f"""select doc_id, md5(array_to_string(list_transform(ids, lambda i, k: '<passage index="' || (k - 1) || '" id="' || i || '">' || chr(10) || texts[k] || chr(10) || '</passage>'), chr(10) || chr(10))) as envelope from {_OF_DOCUMENT_SQL}""")
def context_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of the chunks of every filing, as a digest."""
    return _of_document(spark, sf_dir).select("doc_id", F.md5(T.passages(F.col("ids"), F.col("texts"))).alias("envelope"))


@query(
    f"""select doc_id, md5(array_to_string(list_transform(texts[1:20], lambda t, k: '[' || k || '] ' || case when length({strip_sql('t')}) > 4000 then substr({strip_sql('t')}, 1, 4000) || ' (cut)' else {strip_sql('t')} end), chr(10) || chr(10))
 || case when len(texts) > 20 then chr(10) || chr(10) || '(' || (len(texts) - 20) || ' passages omitted)' else '' end) as shown from {_OF_DOCUMENT_SQL}"""
)
def judge_shown_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is shown of the chunks of every filing, as a digest."""
    return _of_document(spark, sf_dir).select("doc_id", F.md5(judging.shown_context(F.col("texts"))).alias("shown"))


@query(
    f"""with a as (select trace_id, list_distinct(flatten(list_transform(citations, lambda c: c.chunk_ids))) as u, list_transform(citations, lambda c: c.claim_index) as i from {ANSWERS_SQL} where len(citations) > 0),
b as (select trace_id, i, list_sort(u) as ids from a) select trace_id, array_to_string(list_filter(list_transform(i, lambda k: case when k >= 1 and k <= len(ids) then ids[k] end), lambda x: x is not null), ' ') as cited from b"""
)
def generate_cited_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim numbers read as passage numbers: those that were shown, as chunk ids."""
    cited = answers(spark, sf_dir).filter("size(citations) > 0")
    ids = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("citations", lambda c: c["chunk_ids"])), lambda x: x.isNotNull())))
    return cited.select("trace_id", F.array_join(plugins.cited_chunks(F.transform("citations", lambda c: c["claim_index"]), ids), " ").alias("cited"))


@query("select question_id as query_id, question as query from questions where coalesce(len(history), 0) = 0 and question is not null")
def rewrite_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without a history stay as they are."""
    alone = questions(spark, sf_dir).filter("coalesce(size(history), 0) <= 0 and question is not null").select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "history")
    return plugins.rewrite(alone)


# ---- judges and reports

_BAND_SQL = "case when v is null then 'undefined' when v < 0 then 'worse than chance' when v <= 0.2 then 'poor' when v <= 0.4 then 'fair' when v <= 0.6 then 'moderate' when v <= 0.8 then 'substantial' else 'almost perfect' end"


@query(f"select band, cast(count(*) as bigint) as n from (select {_BAND_SQL} as band from (select l_discount * 12 - 0.2 as v from lineitem union all select null)) group by band")
def eval_kappa_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the bands of agreement, over discounts spread from below zero to one."""
    values = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 12 - 0.2).alias("v"))
    values = values.unionByName(spark.createDataFrame([(None,)], "v double"))
    return values.select(E.kappa_band(F.col("v")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


_RATED_SQL = """rated as (select question_id, cast('0x' || substr(md5(question_id), 1, 2) as integer) % 3 as human, case when cast('0x' || substr(md5(question_id), 3, 1) as integer) < 12 then cast('0x' || substr(md5(question_id), 1, 2) as integer) % 3 else cast('0x' || substr(md5(question_id), 4, 2) as integer) % 3 end as judge from questions)"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters of every question: equal for three quarters, else by chance; no labels are in the tables."""
    digits = lambda at, n: F.conv(F.substring(F.md5("question_id"), at, n), 16, 10).cast("int")
    human = digits(1, 2) % 3
    return questions(spark, sf_dir).select("question_id", human.alias("human"), F.when(digits(3, 1) < 12, human).otherwise(digits(4, 2) % 3).alias("judge"))


@query(
    f"""with {_RATED_SQL}, labels as (select 'answer_correctness' as metric, human as i, judge as j from rated union all select 'context_sufficiency', human // 2, judge // 2 from rated), cell as (select metric, i, j, count(*) as n from labels group by all),
wcell as (select *, case when metric = 'answer_correctness' then pow(abs(i - j) / 2.0, 2) else case when i = j then 0.0 else 1.0 end end as w from cell), tot as (select metric, sum(n) as t, sum(w * n) as o, sum(case when i = j then n else 0 end) as agree from wcell group by metric),
rw as (select metric, i, sum(n) as r from cell group by all), cl as (select metric, j, sum(n) as c from cell group by all), ex as (select metric, sum(case when metric = 'answer_correctness' then pow(abs(i - j) / 2.0, 2) else case when i = j then 0.0 else 1.0 end end * r * c) as e from rw join cl using (metric) group by metric),
k as (select metric, 1 - (o / t) / nullif(e / (t * t), 0) as v, agree / t as raw, t from tot join ex using (metric))
select metric, round(v, 4) as kappa, round(raw, 4) as raw_agreement, cast(t as bigint) as n, {_BAND_SQL} as band, coalesce(v >= 0.6, false) as passes from k"""
)
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of a judge with human labels, by metric; two categories are unweighted."""
    scores = lambda c: F.create_map(F.lit("answer_correctness"), F.col(c), F.lit("context_sufficiency"), F.floor(F.col(c) / 2).cast("int"))
    samples = _rated(spark, sf_dir).select("question_id", scores("human").alias("human_scores"), scores("judge").alias("judge_scores"))
    a = judging.agreement(samples)
    return a.select("metric", F.round("kappa", 4).alias("kappa"), F.round("raw_agreement", 4).alias("raw_agreement"), "n", "band", "passes")


@query(f"with {_RATED_SQL} select question_id, 'answer_correctness' as metric, judge / 2.0 as value from rated union all select question_id, 'context_sufficiency', cast(judge // 2 as double) from rated")
def judge_normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged scores on their scales mapped to 0..1."""
    rated = _rated(spark, sf_dir)
    both = rated.select("question_id", F.lit("answer_correctness").alias("metric"), F.col("judge").alias("score")).unionByName(rated.select("question_id", F.lit("context_sufficiency").alias("metric"), F.floor(F.col("judge") / 2).cast("int").alias("score")))
    return both.select("question_id", "metric", judging.normalise(F.col("metric"), F.col("score")).alias("value"))


@query(
    f"""with {_RATED_SQL}, labelled as (select question_id, question_type from questions join rated using (question_id)), p as (select question_id, question_type, md5('0:' || question_id) as code, row_number() over (partition by question_type order by md5('0:' || question_id), question_id) as place, (select count(distinct question_type) from labelled) as types from labelled)
select question_id, question_type from (select *, row_number() over (order by case when place > greatest(1, 30 // types) then 1 else 0 end, code, question_id) as r from p) where r <= 30"""
)
def judge_calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty judged questions for hand labelling."""
    judged = _rated(spark, sf_dir).select("question_id", F.lit("answer_correctness").alias("metric"), F.col("judge").alias("score"), F.lit(None).cast("string").alias("error"))
    return judging.calibration_sample(questions(spark, sf_dir).select("question_id", "question_type"), judged, 30).select("question_id", "question_type")


@query(
    f"""with {LEXICAL_SQL}, {long_sql('lf', 'sc')} select metric, rpad(metric, 24, ' ') || lpad(coalesce(format('{{:,.4f}}', round(avg(val), 9)), '-'), 10, ' ') || '  n=' || count(val) || '  undefined=' || count(*) filter (where val is null) as line from lf group by metric"""
)
def report_run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each metric of a run."""
    made = E.aggregates(E.long_form(bm25_scores(spark, sf_dir)), questions(spark, sf_dir))
    return reports.run_lines(made.withColumn("mean", F.round("mean", 9)))


@query("select metric || '/' || group_name || '/' || quantile_pct as name, mark_value as stated, mark_value * (case when quantile_pct >= 95 then 1.5 else 1.0 end) as actual, quantile_pct < 95 as ok from quantile_marks")
def report_stated_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures derived again against the stated ones: the upper ones are half as high again and fail."""
    marks = table(spark, sf_dir, "quantile_marks").select(F.concat_ws("/", "metric", "group_name", F.col("quantile_pct").cast("string")).alias("name"), "mark_value", "quantile_pct")
    stated = marks.select("name", F.col("mark_value").alias("stated"), (F.col("mark_value") * 0.01).alias("tolerance"))
    return reports.expected(marks.select("name", (F.col("mark_value") * F.when(F.col("quantile_pct") >= 95, 1.5).otherwise(1.0)).alias("actual")), stated)


@query()
def report_refusal_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refusal curve of the best scores as lines."""
    q = questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), ((F.size("gold_chunks") > 0) | (F.size("gold_spans") > 0)).alias("answerable"))
    seen = q.join(refusal.confidence(hits(spark, sf_dir, 5)), "query_id", "left").select(F.coalesce(F.round("top_score", 6), F.lit(0.0)).alias("confidence"), F.coalesce("answerable", F.lit(False)).alias("answerable"))
    return reports.curve_lines(refusal.curve(seen)).select(F.round("threshold", 8).alias("threshold"), "line")


# ---- attacks and leaks


@query()
def security_attack_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attack in the best passage of every question: delivered to the extractive generator, and obeyed by it."""
    corpus = chunks(spark, sf_dir)
    return security.attack_runs(hits(spark, sf_dir, 1), asked(spark, sf_dir), corpus, answering.extractive)


_SECRET_SQL = "'SECRET-' || substr(md5(chunk_id), 1, 16)"
_PROBED_SQL = f"(select min(chunk_id) as chunk_id from {CHUNKS_SQL} where coalesce(not list_contains({ROLES_SQL}, 'public'), true) group by coalesce(company, ''), coalesce(form_type, ''))"


@query(
    f"""with p as {_PROBED_SQL}, r as (select chunk_id, {ROLES_SQL} as roles from {CHUNKS_SQL} join p using (chunk_id)), people as (select 'analyst' as principal, ['analyst'] as held union all select 'anonymous', cast([] as varchar[]) union all select 'counsel', ['legal'])
select principal, cast(count(*) filter (where coalesce(len(list_intersect(roles, held)), 0) > 0) as bigint) as n_allowed_found, cast(0 as bigint) as n_leaked from r, people group by principal"""
)
def security_planted_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret planted in a restricted chunk of every company and form, and asked for by every principal.

    Who may see which secret is stated beside the access rules, from the form alone, so a rule that lets a secret
    through is counted as a leak; every secret that a principal may see must be found.
    """
    corpus = chunks(spark, sf_dir).withColumn("secret", F.concat(F.lit("SECRET-"), F.substring(F.md5("chunk_id"), 1, 16)))
    restricted = corpus.filter(F.coalesce(F.col("form_type") != "10-K", F.lit(True)))
    probed = checkpointed(restricted.groupBy(F.coalesce("company", F.lit("")), F.coalesce("form_type", F.lit(""))).agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id"))
    planted = probed.join(corpus.select("chunk_id", "secret", "form_type"), "chunk_id")
    marked = corpus.join(R.small(probed.withColumn("probed", F.lit(True))), "chunk_id", "left").withColumn("text", F.when(F.col("probed"), F.concat("text", F.lit("\n"), F.col("secret"))).otherwise(F.col("text")))
    asked_for = planted.select(F.col("chunk_id").alias("query_id"), F.substring("secret", 8, 16).alias("query"))
    may = {"anonymous": F.lit(False), "analyst": F.coalesce(F.col("form_type").isin("10-Q", "8-K"), F.lit(False)), "counsel": F.coalesce(F.col("form_type") == "8-K", F.lit(False))}
    out = None
    for principal, held in PRINCIPALS:
        held = F.array(*map(F.lit, held)) if held else F.array().cast("array<string>")
        found = R.bm25_search(marked, asked_for, 5, where=security.allowed(roles(), held))
        shown = checkpointed(found.join(marked.select("chunk_id", "text"), "chunk_id").select(F.lit(principal).alias("principal"), "text"))
        own = planted.select(F.lit(principal).alias("principal"), "secret", may[principal].alias("may"))
        n = security.leaks(shown, own.filter("may")).select(F.col("n_planted_seen").alias("n_allowed_found"))
        leaked = security.leaks(shown, own.filter("not may")).select(F.col("n_planted_seen").alias("n_leaked"))
        total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias(c))
        row = total(n, "n_allowed_found").crossJoin(F.broadcast(total(leaked, "n_leaked"))).select(F.lit(principal).alias("principal"), "n_allowed_found", "n_leaked")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {BM25_SQL}, {ranked_sql('best', 'scored', 1)} select query_id, chunk_id, cast(rank as integer) as rank from best")
def rerank_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a reranking model without one: a single hit stays where it is."""
    found = hits(spark, sf_dir, 1)
    return plugins.rerank(found, asked(spark, sf_dir), chunks(spark, sf_dir), 1).select("query_id", "chunk_id", "rank")


@query(f"""select chunk_id, sha256(regexp_replace("text", '</?(passage|system|instructions?)>', '[\\1]', 'gi')) as neutral_hash from {CHUNKS_SQL} where "text" is not null""")
def text_neutralised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with forged boundaries in square brackets, as a digest."""
    return chunks(spark, sf_dir).filter("text is not null").select("chunk_id", F.sha2(T.neutralise_boundaries(F.col("text")), 256).alias("neutral_hash"))


@query("select accession, sha256(html) as text_hash from raw_filings where accession is not null")
def source_primary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through its bytes and back."""
    pages = table(spark, sf_dir, "raw_filings").filter("accession is not null").select(F.col("accession").alias("url"), F.encode("html", "UTF-8").alias("body"))
    return filings_index.primary_documents(pages).select(F.col("url").alias("accession"), F.sha2("text", 256).alias("text_hash"))


@query("select * from (select cast(0 as integer) as line_no, '| metric | group_name | quantile_pct |' as line union all select 1, '|---|---|---|' union all select cast(row_number() over (order by metric || '/' || group_name || '/' || lpad(cast(quantile_pct as varchar), 3, '0')) + 1 as integer), '| ' || metric || ' | ' || group_name || ' | ' || quantile_pct || ' |' from quantile_marks)")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of percentiles as a Markdown table."""
    order = F.concat_ws("/", "metric", "group_name", F.lpad(F.col("quantile_pct").cast("string"), 3, "0"))
    return reports.markdown(table(spark, sf_dir, "quantile_marks").select("metric", "group_name", "quantile_pct"), order)


@query()
def parse_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all pages with sections, tables and metadata, and the pages that failed."""
    made, failures = parsing.parse_filings(table(spark, sf_dir, "raw_filings"))
    good = made.select("doc_id", F.length("text").alias("n_chars"), F.coalesce(F.size("sections"), F.lit(0)).alias("n_sections"), F.size("doc_tables").alias("n_tables"), F.lit(None).cast("string").alias("problem"))
    return good.unionByName(failures.select(F.col("accession").alias("doc_id"), F.lit(0).alias("n_chars"), F.lit(0).alias("n_sections"), F.lit(0).alias("n_tables"), "problem"))
