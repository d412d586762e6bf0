"""Queries of security, serving and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import retrieval as R
from gleanery.operators import security as S
from gleanery.operators import serving as V
from gleanery.plans.registry import ANSWERS_SQL, CHUNKS_SQL, SPANS_SQL, answers, chunks, filings, query, questions, spans
from gleanery.plans.search import BM25_SQL, SHOWN_SQL, asked, hits, ranked_sql, shown
from gleanery.plans.texts import FILINGS_SQL, INVISIBLE_SQL, WS_SQL
from gleanery.sources import filings_index
from gleanery.session import table

# ---- security

#: Access lists read off the form type, as the tables have none.
ROLES_SQL = "case form_type when '10-K' then ['public'] when '10-Q' then ['analyst'] when '8-K' then ['legal', 'analyst'] end"
PRINCIPALS = [("anonymous", []), ("analyst", ["analyst"]), ("counsel", ["legal", "legal"])]
PRINCIPALS_SQL = "(select 'anonymous' as principal, cast([] as varchar[]) as held union all select 'analyst', ['analyst'] union all select 'counsel', ['legal'])"


def roles():
    return F.expr("case form_type when '10-K' then array('public') when '10-Q' then array('analyst') when '8-K' then array('legal', 'analyst') end")


@query(
    f"""select principal, reason, cast(count(*) as bigint) as n from (select principal, case when list_contains(r, 'public') then 'public' when coalesce(len(r), 0) = 0 then 'no access list' when len(list_intersect(r, held)) > 0 then 'role granted' else 'no role in common' end as reason
 from (select chunk_id, {ROLES_SQL} as r from {CHUNKS_SQL}), {PRINCIPALS_SQL}) group by all"""
)
def security_acl_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of three principals over all chunks, by reason."""
    people = spark.createDataFrame(PRINCIPALS, "principal string, held array<string>")
    judged = chunks(spark, sf_dir).select("chunk_id", roles().alias("r")).crossJoin(F.broadcast(people)).select("principal", S.decision(F.col("r"), F.col("held")).alias("reason"))
    return judged.groupBy("principal", "reason").agg(F.count("*").alias("n"))


@query(f"with {BM25_SQL}, kept as (select s.* from scored s join ch using (chunk_id) where list_contains({ROLES_SQL}, 'public') or list_contains({ROLES_SQL}, 'analyst')), {ranked_sql('best', 'kept', 5)} {SHOWN_SQL} best")
def security_acl_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analyst may retrieve: the access list is checked before anything is scored."""
    may = S.allowed(roles(), F.array(F.lit("analyst")))
    return shown(R.bm25_search(chunks(spark, sf_dir), asked(spark, sf_dir), 5, where=may))


@query(
    f"""with {BM25_SQL}, kept as (select s.* from scored s join ch using (chunk_id) where list_contains({ROLES_SQL}, 'public')), {ranked_sql('best', 'kept', 5)}
select 'anonymous' as principal, cast(count(*) as bigint) as n_hits, cast(count(*) filter (where not coalesce(list_contains({ROLES_SQL}, 'public'), false)) as bigint) as n_leaked from best join ch using (chunk_id)"""
)
def security_leak_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted chunks among what a stranger retrieves: none may be."""
    corpus = chunks(spark, sf_dir)
    stranger = F.array().cast("array<string>")
    found = R.bm25_search(corpus, asked(spark, sf_dir), 5, where=S.allowed(roles(), stranger))
    checked = found.join(corpus.select("chunk_id", S.allowed(roles(), stranger).alias("may")), "chunk_id")
    return checked.agg(F.lit("anonymous").alias("principal"), F.count("*").alias("n_hits"), F.count_if(~F.col("may")).alias("n_leaked"))


def detected_sql(text: str) -> str:
    tests = {
        name: (p.replace("'", "''") if name != "invisible_characters" else INVISIBLE_SQL)
        for name, p in T.INJECTIONS.items()
    }
    return "list_filter([" + ", ".join(f"case when regexp_matches({text}, '{p}') then '{name}' end" for name, p in tests.items()) + "], lambda x: x is not null)"


ATTACKS_SQL = "(select * from (values " + ", ".join("('" + i + "', '" + t + "', '" + p.replace("'", "''").replace("\u200b", "' || chr(8203) || '") + "')" for i, t, p in S.ATTACKS) + ") a(attempt_id, technique, payload))"


@query(f"""select chunk_id, array_to_string({detected_sql('"text"')}, ' ') as techniques, substr(trim(regexp_replace("text", '[{WS_SQL}]+', ' ', 'g')), 1, 160) as excerpt from {CHUNKS_SQL} where len({detected_sql('"text"')}) > 0""")
def security_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that show a technique of injection."""
    return S.scan(chunks(spark, sf_dir), "chunk_id", "text").withColumn("techniques", F.array_join("techniques", " "))


@query(
    f"""with {BM25_SQL}, {ranked_sql('best', 'scored', 1)}, poisoned as (select b.query_id, a.attempt_id, a.technique, ch."text" || chr(10) || chr(10) || a.payload as t from best b join ch using (chunk_id), {ATTACKS_SQL} a)
select attempt_id, technique, cast(count(*) as bigint) as n, round(avg(case when len({detected_sql("t")}) > 0 then 1.0 else 0.0 end), 6) as detection_rate, round(avg(case when regexp_matches(t, '(?i)</?(passage|system|instructions?)>') then 1.0 else 0.0 end), 6) as boundary_rate from poisoned group by all"""
)
def security_attack_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attack planted in the best chunk of every question: how often it is noticed."""
    best = hits(spark, sf_dir, 1).join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    planted = best.crossJoin(F.broadcast(S.attacks(spark))).withColumn("t", S.contaminate(F.col("text"), F.col("payload")))
    noticed = (F.size(T.detect_injection(F.col("t"))) > 0).cast("double")
    forged = F.col("t").rlike(r"(?i)</?(passage|system|instructions?)>").cast("double")
    return planted.groupBy("attempt_id", "technique").agg(F.count("*").alias("n"), F.round(F.avg(noticed), 6).alias("detection_rate"), F.round(F.avg(forged), 6).alias("boundary_rate"))


@query()
def security_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", F.sha2(S.sanitise(F.col("text")), 256).alias("clean_hash"))


# ---- serving

VALID_SQL = "duration_ms >= 0 and not isnan(duration_ms)"


@query(
    f"""select span_name, cast(count(*) as bigint) as n, round(avg(duration_ms), 3) as mean_ms, round(quantile_cont(duration_ms, 0.5), 3) as p50, round(quantile_cont(duration_ms, 0.95), 3) as p95, round(quantile_cont(duration_ms, 0.99), 3) as p99, round(max(duration_ms), 3) as max_ms from {SPANS_SQL} where {VALID_SQL} group by span_name"""
)
def serve_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.latency_report(spans(spark, sf_dir), "span_name")
    return r.select("span_name", "n", *[F.round(c, 3).alias(c) for c in ("mean_ms", "p50", "p95", "p99", "max_ms")])


@query(
    f"""select span_name, cast(count(*) as bigint) as n, round(quantile_cont(duration_ms, 0.95), 3) as p95 from (select * from {SPANS_SQL} qualify row_number() over (partition by span_name order by started_at desc, span_id desc) <= 2000) where {VALID_SQL} group by span_name"""
)
def serve_latest_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the last 2,000 spans of each stage."""
    r = V.latency_report(V.latest(spans(spark, sf_dir), "span_name", "started_at", "span_id"), "span_name")
    return r.select("span_name", "n", F.round("p95", 3).alias("p95"))


@query(
    f"""select date_trunc('hour', started_at) as hour, span_name, cast(count(*) as bigint) as n, cast(count("error") as bigint) as n_errors, round(sum(case when {VALID_SQL} then duration_ms end), 3) as total_ms from {SPANS_SQL} group by all"""
)
def serve_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration_ms")
    return spans(spark, sf_dir).groupBy(F.date_trunc("hour", F.col("started_at")).cast("timestamp_ntz").alias("hour"), "span_name").agg(
        F.count("*").alias("n"), F.count("error").alias("n_errors"), F.round(F.sum(F.when(V.valid_duration(d), d)), 3).alias("total_ms")
    )


@query(f"""select trace_id, round(sum(duration_ms), 3) as total_ms, cast(count(distinct span_name) as bigint) as n_stages from {SPANS_SQL} where {VALID_SQL} group by trace_id""")
def serve_stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = spans(spark, sf_dir).filter(V.valid_duration(F.col("duration_ms")))
    return valid.groupBy("trace_id").agg(F.round(F.sum("duration_ms"), 3).alias("total_ms"), F.countDistinct("span_name").alias("n_stages"))


@query(
    f"""with o as (select span_name, case when "error" is null then 0 else 1 end as failed, sum(case when "error" is null then 1 else 0 end) over (partition by span_name order by started_at, span_id) as island from {SPANS_SQL}),
runs as (select span_name, island, sum(failed) as run, count(*) as n from o group by all)
select span_name as component, cast(sum(n) as bigint) as n, cast(sum(run) as bigint) as n_failed, cast(max(run) as bigint) as longest_run, cast(count(*) filter (where run >= 3) as bigint) as n_runs_at_threshold from runs group by span_name"""
)
def serve_breaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures of each stage, and how often a breaker of three would have opened."""
    return V.failure_runs(spans(spark, sf_dir), "span_name", "started_at", "span_id", F.col("error").isNotNull(), threshold=3)


@query(
    f"""select model_name, cast(count(*) as bigint) as n, round(count("error") / count(*), 6) as error_rate, round(count(*) filter (where refused) / count(*), 6) as refusal_rate, round(sum(token_usage.cost_usd) / count(*), 4) as cost_per_query,
 cast(sum(token_usage.input_tokens) as bigint) as input_tokens, cast(sum(token_usage.output_tokens) filter (where token_usage.output_tokens >= 0) as bigint) as output_tokens, round(sum(token_usage.cached_input_tokens) / nullif(sum(token_usage.input_tokens), 0), 6) as cached_share from {ANSWERS_SQL} group by model_name"""
)
def serve_derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, cost and tokens by model."""
    u = F.col("token_usage")
    return answers(spark, sf_dir).groupBy("model_name").agg(
        F.count("*").alias("n"),
        F.round(F.count("error") / F.count("*"), 6).alias("error_rate"),
        F.round(F.count_if("refused") / F.count("*"), 6).alias("refusal_rate"),
        F.round(F.sum(u["cost_usd"]) / F.count("*"), 4).alias("cost_per_query"),
        F.sum(u["input_tokens"]).alias("input_tokens"),
        F.sum(F.when(u["output_tokens"] >= 0, u["output_tokens"])).alias("output_tokens"),
        F.round(F.try_divide(F.sum(u["cached_input_tokens"]), F.sum(u["input_tokens"])), 6).alias("cached_share"),
    )


@query(
    """with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 20 = 0), live as (select vec_id as entry_id, embedding as e from embeddings where vec_id % 20 <> 0 and 5000.0 - vec_id <= 4800.0),
s as (select query_id, entry_id, round(list_sum(list_transform(list_zip(q.e, live.e), lambda z: cast(z[1] as double) * cast(z[2] as double))), 9) as sim from q, live),
b as (select *, row_number() over (partition by query_id order by sim desc, entry_id) as r from s)
select q.query_id, b.entry_id, round(b.sim, 5) as similarity from q left join b on b.query_id = q.query_id and r = 1 and sim >= 0.5"""
)
def serve_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector asks a cache of the others, whose entries expire by age."""
    every = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    entries = every.filter("vec_id % 20 <> 0").select(F.col("vec_id").alias("entry_id"), "vector", F.col("vec_id").cast("double").alias("created_at"), F.lit("v1").alias("corpus_version"))
    found = V.cache_lookup(every.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), entries, now=5000.0, version="v1", threshold=0.5, ttl=4800.0)
    return found.select("query_id", "entry_id", F.round("similarity", 5).alias("similarity"))


@query(
    f"""select trace_id from {ANSWERS_SQL} a where not exists (select 1 from (select trace_id, unnest(flatten(list_transform(citations, lambda c: c.chunk_ids))) as cid from {ANSWERS_SQL}) e join {CHUNKS_SQL} c on c.chunk_id = e.cid and c.form_type like '%/A' where e.trace_id = a.trace_id)"""
)
def serve_cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that stay cached when the chunks of amended filings change."""
    entries = answers(spark, sf_dir).select("trace_id", F.flatten(F.transform("citations", lambda c: c["chunk_ids"])).alias("chunk_ids"))
    return V.cache_invalidate(entries, "trace_id", chunks(spark, sf_dir).filter("form_type like '%/A'")).select("trace_id")


@query(
    f"""with a as (select trace_id, answer, refused, "error" as err, coalesce(len(flatten(list_transform(citations, lambda c: c.chunk_ids))), 0) as n from {ANSWERS_SQL}),
ev as (select trace_id, list_concat([{{'event': 'trace', 'data': trace_id}}, {{'event': 'passages', 'data': cast(n as varchar)}}], case when err is not null then [{{'event': 'error', 'data': err}}] when refused then [{{'event': 'refusal', 'data': ''}}]
 when coalesce(answer, '') = '' then [] else list_transform(generate_series(1, cast(length(answer) as bigint), 48), lambda i: {{'event': 'token', 'data': substr(answer, i, 48)}}) end, [{{'event': 'done', 'data': ''}}]) as e from a),
x as (select trace_id, unnest(e) as e, generate_subscripts(e, 1) as i from ev) select trace_id, cast(i - 1 as integer) as seq, e.event as event, e.data as data from x"""
)
def serve_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.event_stream(answers(spark, sf_dir), "trace_id")


@query(
    f"""with d as (select cast(started_at as date) as day, quantile_cont(duration_ms, 0.95) as p95, count(*) as n from {SPANS_SQL} where {VALID_SQL} group by 1)
select day, cast(n as bigint) as n, round(p95, 3) as p95, p95 > 2 * first_value(p95) over (order by day) as beyond_knee from d"""
)
def serve_load_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile by day against the first day's: where it doubles, the knee is passed."""
    from pyspark.sql import Window

    days = V.latency_report(spans(spark, sf_dir).withColumn("day", F.to_date("started_at")), "day")
    return days.select("day", "n", F.round("p95", 3).alias("p95"), (F.col("p95") > 2 * F.first("p95").over(Window.orderBy("day"))).alias("beyond_knee"))


@query(
    f"""select string_agg(line, chr(10) order by name) || chr(10) as exposition from (select replace('requests.' || span_name, '.', '_') as m, 'requests.' || span_name as name, '# TYPE gleanery_' || replace('requests.' || span_name, '.', '_') || ' counter' || chr(10) || 'gleanery_' || replace('requests.' || span_name, '.', '_') || ' ' || count(*) as line from {SPANS_SQL} group by span_name)"""
)
def serve_prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spans(spark, sf_dir).groupBy("span_name").agg(F.count("*").alias("value"))
    return V.prometheus(counts.select(F.concat(F.lit("requests."), "span_name").alias("name"), F.lit("counter").alias("kind"), "value"))


# ---- sources


@query(
    """select cast(1318605 as bigint) as cik, 'Invented Mills' as company, f.form as form_type, f.acc as accession, f.fdate as filing_date, f.rdate as report_date, f.doc as primary_document, cast(case when f.rdate <> '' then substr(f.rdate, 1, 4) else substr(f.fdate, 1, 4) end as integer) as fiscal_year
 from (values ('10-K', '0001-25-000001', '2025-02-01', '2024-12-31', 'a.htm'), ('10-k', '0001-24-000007', '2024-02-02', '', '')) f(form, acc, fdate, rdate, doc)"""
)
def source_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual reports from the parallel arrays of a submissions record; arrays may end early."""
    raw = '{"name":"Invented Mills","filings":{"recent":{"form":["10-K","8-K","10-k"],"accessionNumber":["0001-25-000001","0001-24-000009","0001-24-000007"],"filingDate":["2025-02-01","2024-05-05","2024-02-02"],"reportDate":["2024-12-31","2024-05-01"],"primaryDocument":["a.htm","b.htm"]}}}'
    return filings_index.list_filings(spark.createDataFrame([(1318605, raw)], "cik long, body string"), ("10-K",))


@query(
    f"""select doc_id, 'https://www.sec.gov/Archives/edgar/data/' || cast(cast(metadata['cik'] as bigint) as varchar) || '/' || replace(metadata['accession'], '-', '') || '/' || 'index.htm' as url from {FILINGS_SQL} where metadata['cik'] is not null and metadata['accession'] is not null"""
)
def source_filing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    known = filings(spark, sf_dir).filter(m["cik"].isNotNull() & m["accession"].isNotNull())
    return known.select("doc_id", filings_index.archive_url(m["cik"].cast("long"), m["accession"], F.lit("index.htm")).alias("url"))


@query("""select doc_id, cast(count(*) as bigint) as n_versions, max(ingested_at) as last_ingested from filings group by doc_id having count(*) > 1""")
def source_reingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings that came in more than once."""
    return table(spark, sf_dir, "filings").groupBy("doc_id").agg(F.count("*").alias("n_versions"), F.max("ingested_at").alias("last_ingested")).filter("n_versions > 1")


@query("""select r.accession from raw_filings r where not exists (select 1 from filings f where f.metadata['accession'] = r.accession and f.source_url is not null)""")
def source_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a stored filing that names its source: what an ingest job would still fetch."""
    pages = table(spark, sf_dir, "raw_filings").select("accession")
    stored = table(spark, sf_dir, "filings").filter("source_url is not null").select(F.col("metadata")["accession"].alias("accession"))
    return pages.join(stored, "accession", "left_anti")


@query("""select trace_id, arg_max(model_name, answered_at) as model_name, cast(count(*) as bigint) as n_puts from answers group by trace_id""")
def source_response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest payload of every key of a response store, and how often it was put."""
    return table(spark, sf_dir, "answers").groupBy("trace_id").agg(F.max_by("model_name", "answered_at").alias("model_name"), F.count("*").alias("n_puts"))


@query()
def source_dataset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as JSON lines with sorted keys, and their digest."""
    return filings_index.dataset_lines(questions(spark, sf_dir), "question_id")
