"""Queries of retrieval, of contexts and refusal, and of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import vectors as V
from gleanery.operators import answering, context, refusal
from gleanery.operators import retrieval as R
from gleanery.plans.registry import ANSWERS_SQL, CHUNKS_SQL, answers, chunks, query, questions
from gleanery.plans.texts import PLAIN_TOKENS_SQL, protect_sql, strip_sql, tokens_sql
from gleanery.session import checkpointed, table

# ---- retrieval

BM25_SQL = f"""ch as (select * from {CHUNKS_SQL}),
toks as (select chunk_id, {tokens_sql('"text"')} as t from ch),
stats as (select count(*) as n, avg(len(t)) as avg_len from toks),
post as (select chunk_id, term, count(*) as tf, any_value(len) as len from (select chunk_id, len(t) as len, unnest(t) as term from toks) group by chunk_id, term),
dfs as (select term, count(*) as df from post group by term),
asked as (select query_id, term, count(*) as qtf from (select question_id as query_id, unnest({tokens_sql("question")}) as term from questions) group by query_id, term),
scored as (select query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * case when avg_len > 0 then len / avg_len else 1.0 end))) as score
 from asked join post using (term) join dfs using (term), stats group by query_id, chunk_id)"""


def ranked_sql(name: str, source: str, k: int) -> str:
    return f"{name} as (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {source} qualify rank <= {k})"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))


def hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Lexical hits; small, and read several times by what builds on them."""
    return checkpointed(R.bm25_search(chunks(spark, sf_dir), asked(spark, sf_dir), k))


def shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


SHOWN_SQL = "select query_id, chunk_id, cast(rank as integer) as rank, round(score, 6) as score from "


@query(f"with {BM25_SQL}, {ranked_sql('best', 'scored', 10)} {SHOWN_SQL} best")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of every question."""
    return shown(R.bm25_search(chunks(spark, sf_dir), asked(spark, sf_dir), 10))


@query(f"with {BM25_SQL}, {ranked_sql('best', 'scored', 3)} {SHOWN_SQL} best")
def bm25_postings_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best, by the join of query terms with postings where these lie: no pair of both is shuffled."""
    return shown(R.bm25_search(chunks(spark, sf_dir), asked(spark, sf_dir), 3))


@query(f"with {BM25_SQL}, kept as (select s.* from scored s join ch using (chunk_id) where form_type = '10-K'), {ranked_sql('best', 'kept', 10)} {SHOWN_SQL} best")
def bm25_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among annual reports only: the filter limits candidates, not statistics."""
    return shown(R.bm25_search(chunks(spark, sf_dir), asked(spark, sf_dir), 10, where=F.col("form_type") == "10-K"))


@query(f"with {BM25_SQL} select term, cast(df as bigint) as df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from dfs, stats")
def bm25_term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, totals = R.bm25_statistics(chunks(spark, sf_dir))
    dfs = postings.groupBy("term").agg(F.count("*").alias("df"))
    return dfs.crossJoin(F.broadcast(totals)).select("term", "df", F.round(F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


ALIASES_SQL = f"""names as (select distinct company from (select {strip_sql("company")} as company from {CHUNKS_SQL}) where company <> ''),
heads as (select company, {strip_sql("replace(regexp_replace(company, '(?i)\\b(inc|corp|corporation|co|ltd|llc|plc|company)\\b\\.?', '', 'g'), ',', ' ')")} as head from names),
every_alias as (select company, 0 as kind, lower(company) as alias from heads union all select company, 1, lower(regexp_split_to_array(head, '\\s+')[1]) from heads where length(regexp_split_to_array(head, '\\s+')[1]) > 3
 union all select company, 1, lower(head) from heads where head <> ''),
aliases as (select alias, arg_min(company, [cast(kind as varchar), company]) as company from every_alias where alias <> '' group by alias),
named as (select question_id as query_id, list_distinct(list(company)) as companies from questions join aliases on contains(lower(question), alias) group by question_id),
years as (select question_id as query_id, list_distinct(regexp_extract_all(question, '(?i)\\b(?:fiscal\\s+(?:year\\s+)?|FY\\s*)?((?:19|20)[0-9]{{2}})\\b', 1)) as y from questions),
filters as (select query_id, case when len(companies) = 1 then companies[1] end as company, case when len(y) = 1 then cast(y[1] as integer) end as fiscal_year from years left join named using (query_id))"""


@query(f"with {ALIASES_SQL} select alias, company from aliases")
def metadata_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.company_aliases(chunks(spark, sf_dir))


@query(f"with {ALIASES_SQL} select query_id, company, fiscal_year from filters")
def metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extract_filters(asked(spark, sf_dir), R.company_aliases(chunks(spark, sf_dir)))


@query(
    f"""with {BM25_SQL}, {ALIASES_SQL},
judged as (select s.query_id, s.chunk_id, s.score, (f.company is null or ch.company is null or lower(f.company) = lower(ch.company)) and (f.fiscal_year is null or ch.fiscal_year is null or f.fiscal_year = ch.fiscal_year) as fits
 from scored s join filters f using (query_id) join ch using (chunk_id)),
kept as (select query_id, chunk_id, score from judged qualify fits or not bool_or(fits) over (partition by query_id)), {ranked_sql('best', 'kept', 10)} {SHOWN_SQL} best"""
)
def bm25_metadata_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters read from the question; without a match the unfiltered ranking."""
    corpus = chunks(spark, sf_dir)
    filters = R.extract_filters(asked(spark, sf_dir), R.company_aliases(corpus))
    return shown(R.bm25_search(corpus, asked(spark, sf_dir), 10, filters=filters))


DENSE_SQL = """pairs as (select q.vec_id as query_id, e.vec_id as chunk_id, e.label as label, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: cast(z[1] as double) * cast(z[2] as double))), 9) as score
 from embeddings e, embeddings q where q.vec_id % 20 = 0)"""


@query(f"with {DENSE_SQL}, {ranked_sql('best', 'pairs', 10)} select query_id, chunk_id, cast(rank as integer) as rank, round(score, 5) as score from best")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhaustive cosine search: every twentieth vector against all."""
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))
    stated = index.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return R.dense(index, stated, 10).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query(f"with {DENSE_SQL}, kept as (select * from pairs where label < 5), {ranked_sql('best', 'kept', 5)} select query_id, chunk_id, cast(rank as integer) as rank, round(score, 5) as score from best")
def dense_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    stated = every.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return R.dense(every.filter("label < 5"), stated, 5).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 4) as norm, cast(len(embedding) as integer) as dim from embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(V.dot(v, v)), 4).alias("norm"), F.size(v).alias("dim"))


@query()
def embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed hashing vectors of every chunk."""
    return chunks(spark, sf_dir).select("chunk_id", V.hashing_embedder()(F.col("text")).alias("vector"))


def vectors_sql(name: str, source: str, id_col: str, text: str) -> str:
    return f"""{name}_tf as (select id, term, count(*) as tf from (select {id_col} as id, unnest({PLAIN_TOKENS_SQL.format(text)}) as term from {source}) group by id, term),
{name}_b as (select id, code % 64 as bucket, sum(case when code & 2147483648 <> 0 then 1.0 else -1.0 end * (1 + ln(tf))) as w from (select id, tf, cast('0x' || substr(md5(term), 1, 8) as bigint) as code from {name}_tf) group by id, bucket),
{name} as (select id, bucket, w / sqrt(sum(w * w) over (partition by id)) as weight from {name}_b qualify sum(w * w) over (partition by id) > 0)"""


HYBRID_SQL = f"""{BM25_SQL}, {ranked_sql('lexical', 'scored', 50)},
{vectors_sql('cv', 'ch', 'chunk_id', '"text"')}, {vectors_sql('qv', 'questions', 'question_id', 'question')},
sims as (select q.id as query_id, c.id as chunk_id, sum(q.weight * c.weight) as score from qv q join cv c using (bucket) group by q.id, c.id), {ranked_sql('near', 'sims', 50)},
fused as (select query_id, chunk_id, sum(1.0 / (60 + rank)) as score from (select query_id, chunk_id, rank from lexical union all select query_id, chunk_id, rank from near) group by query_id, chunk_id)"""


def bucket_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index = V.bucket_embedded(chunks(spark, sf_dir), "chunk_id", "text").withColumnRenamed("id", "chunk_id")
    stated = V.bucket_embedded(asked(spark, sf_dir), "query_id", "query").withColumnRenamed("id", "query_id")
    return checkpointed(R.dense(index, checkpointed(stated), k))


@query(f"with {HYBRID_SQL} select query_id, chunk_id, cast(rank as integer) as rank, round(score, 4) as score from near where rank <= 10")
def dense_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_hits(spark, sf_dir, 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query(f"with {HYBRID_SQL}, {ranked_sql('best', 'fused', 10)} {SHOWN_SQL} best")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings to a depth of fifty, fused, cut to ten."""
    return shown(R.top_k(R.reciprocal_rank_fusion(hits(spark, sf_dir, R.FETCH_DEPTH), bucket_hits(spark, sf_dir, R.FETCH_DEPTH)), 10))


RERANK_SQL = f"""{BM25_SQL}, {ranked_sql('wide', 'scored', 50)},
terms as (select question_id as query_id, list_distinct({tokens_sql("question")}) as terms from questions),
cand as (select w.query_id, w.chunk_id, toks.t as tokens, terms.terms, list_intersect(terms.terms, toks.t) as matched, count(*) over (partition by w.query_id) as n from wide w join toks using (chunk_id) join terms using (query_id)),
cdf as (select query_id, term, count(*) as df from (select query_id, unnest(list_distinct(matched)) as term from cand) group by query_id, term),
idf as (select w.query_id, w.term, ln(1 + n.n / (1 + coalesce(df, 0))) as idf from (select query_id, unnest(terms) as term from terms) w join (select distinct query_id, n from cand) n using (query_id) left join cdf using (query_id, term)),
total as (select query_id, sum(idf) as total from idf group by query_id),
covered as (select c.query_id, c.chunk_id, sum(idf) as covered from (select query_id, chunk_id, unnest(list_distinct(matched)) as term from cand) c join idf using (query_id, term) group by c.query_id, c.chunk_id),
spread as (select query_id, chunk_id, count(*) as n_places, max(pos) - min(pos) as spread from (select query_id, chunk_id, matched, unnest(tokens) as tok, generate_subscripts(tokens, 1) as pos from cand) where list_contains(matched, tok) group by query_id, chunk_id),
reranked as (select c.query_id, c.chunk_id, case when covered is null then 0.0 else round(covered / total + case when n_places > 1 then greatest(0.0, 1 - spread / 40) * 0.25 else 0.0 end, 6) end as score
 from cand c left join covered using (query_id, chunk_id) left join total using (query_id) left join spread using (query_id, chunk_id))"""


@query(f"with {RERANK_SQL}, {ranked_sql('best', 'reranked', 10)} select query_id, chunk_id, cast(rank as integer) as rank, score from best")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty candidates, scored again, cut to ten."""
    corpus, queries = chunks(spark, sf_dir), asked(spark, sf_dir)
    return R.top_k(R.lexical_rerank(hits(spark, sf_dir, 50), queries, corpus), 10).select("query_id", "chunk_id", "rank", "score")


@query(f"select c.chunk_id from {CHUNKS_SQL} c where not exists (select 1 from {CHUNKS_SQL} o where o.chunk_id = c.chunk_id and o.form_type = '10-K')")
def index_add_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = chunks(spark, sf_dir)
    return R.add_to_index(corpus.filter("form_type = '10-K'"), corpus).select("chunk_id")


# ---- contexts and refusal

TOP5_SQL = f"{BM25_SQL}, {ranked_sql('top5', 'scored', 5)}"


@query(
    f"""with {TOP5_SQL} select query_id, cast(count(*) as bigint) as n_hits, round(max(score) filter (where rank = 1), 6) as top_score, round(avg(score), 6) as mean_score,
 round(case when count(*) = 1 then max(score) else max(score) filter (where rank = 1) - avg(score) filter (where rank > 1) end, 6) as margin from top5 group by query_id"""
)
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = refusal.confidence(hits(spark, sf_dir, 5))
    return c.select("query_id", "n_hits", *[F.round(x, 6).alias(x) for x in ("top_score", "mean_score", "margin")])


OBSERVED_SQL = f"""{TOP5_SQL}, observed as (select question_id as query_id, coalesce(round(max(score), 6), 0.0) as confidence, any_value(len(gold_chunks) > 0 or len(gold_spans) > 0) as answerable
 from questions left join top5 on query_id = question_id group by question_id),
vals as (select distinct confidence as v from observed), ends as (select min(v) as lo, max(v) as hi, case when max(v) = min(v) then 1.0 else max(v) - min(v) end as width from vals),
marks as (select round((v + lead(v) over (order by v)) / 2, 9) as threshold from vals qualify threshold is not null union select round(lo - 0.01 * width, 9) from ends union select round(hi + 0.01 * width, 9) from ends),
curve as (select threshold, count(*) filter (where not answerable and confidence < threshold) as correct, count(*) filter (where not answerable) as n_un, count(*) filter (where answerable and confidence < threshold) as false_, count(*) filter (where answerable) as n_an
 from marks, observed group by threshold)"""
CURVE_SQL = """select round(threshold, 8) as threshold, cast(correct as bigint) as correct_refusals, cast(false_ as bigint) as false_refusals, round(correct / nullif(n_un, 0), 6) as correct_rate, round(false_ / nullif(n_an, 0), 6) as false_rate,
 round(correct / nullif(n_un, 0) - false_ / nullif(n_an, 0), 6) as youden_j from curve"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = refusal.confidence(hits(spark, sf_dir, 5)).select("query_id", F.round("top_score", 6).alias("confidence"))
    q = questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), ((F.size("gold_chunks") > 0) | (F.size("gold_spans") > 0)).alias("answerable"))
    return q.join(c, "query_id", "left").na.fill(0.0, ["confidence"])


@query(f"with {OBSERVED_SQL} {CURVE_SQL}")
def refusal_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = refusal.curve(observed(spark, sf_dir))
    return c.select(F.round("threshold", 8).alias("threshold"), "correct_refusals", "false_refusals", *[F.round(x, 6).alias(x) for x in ("correct_rate", "false_rate", "youden_j")])


@query(f"with {OBSERVED_SQL}, pts as ({CURVE_SQL}) select threshold, correct_rate, false_rate from pts where false_rate <= 0.05 and correct_refusals > 0 order by correct_rate desc, threshold limit 1")
def refusal_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = refusal.operating_point(refusal.curve(observed(spark, sf_dir)))
    return p.select(F.round("threshold", 8).alias("threshold"), *[F.round(x, 6).alias(x) for x in ("correct_rate", "false_rate")])


@query(f"with {TOP5_SQL}, n as (select *, count(*) over (partition by query_id) as n from top5) select query_id, chunk_id, cast(case when rank % 2 = 1 then (rank + 1) / 2 else n - rank / 2 + 1 end as integer) as position from n")
def context_lost_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.presentation_order(hits(spark, sf_dir, 5)).select("query_id", "chunk_id", "position")


@query(
    f"""with recursive {TOP5_SQL}, sh as (select t.query_id, t.chunk_id, t.rank, case when len(k) = 0 then [] when len(k) < 4 then [array_to_string(k, ' ')] else list_distinct(list_transform(range(1, len(k) - 2), lambda i: array_to_string(k[i:i+3], ' '))) end as s
 from top5 t join (select chunk_id, {PLAIN_TOKENS_SQL.format('"text"')} as k from ch) using (chunk_id)),
pairs as (select a.query_id, a.rank as a_rank, b.rank as b_rank, len(list_intersect(a.s, b.s)) / nullif(len(list_distinct(list_concat(a.s, b.s))), 0) as j from sh a join sh b on a.query_id = b.query_id and a.rank < b.rank),
fold as (select query_id, cast(1 as bigint) as rank, [cast(1 as bigint)] as kept from sh where rank = 1
 union all select f.query_id, f.rank + 1, case when exists (select 1 from pairs p where p.query_id = f.query_id and p.b_rank = f.rank + 1 and list_contains(f.kept, p.a_rank) and coalesce(p.j, 1.0) >= 0.8) then f.kept else list_append(f.kept, f.rank + 1) end
 from fold f join sh s on s.query_id = f.query_id and s.rank = f.rank + 1)
select query_id, array_to_string(arg_max(kept, rank), ',') as kept_ranks from fold group by query_id"""
)
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that stay when every hit is compared with the ones kept before it."""
    made = context.assemble(hits(spark, sf_dir, 5), chunks(spark, sf_dir), max_tokens=10**9)
    return made.select("query_id", F.array_join(F.array_sort(F.transform("kept", lambda k: k["rank"])), ",").alias("kept_ranks"))


@query()
def context_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts after duplicates, a budget of 400 tokens and reordering."""
    made = context.assemble(hits(spark, sf_dir, 10), chunks(spark, sf_dir), max_tokens=400)
    return made.select("query_id", F.transform("kept", lambda k: k["chunk_id"]).alias("chunk_ids"), "tokens_used", F.size("dropped_duplicate").alias("n_duplicates"), F.size("dropped_budget").alias("n_over_budget"))


# ---- answers


@query(
    f"""with {TOP5_SQL}, best as (select t.query_id, t.chunk_id, ch."text", q.question from top5 t join ch using (chunk_id) join questions q on q.question_id = t.query_id where rank = 1),
terms as (select query_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) as terms from best),
sents as (select query_id, unnest(p) as s, generate_subscripts(p, 1) as pos from (select query_id, list_filter(list_transform(string_split(regexp_replace("text", '([.!?])[{{WS}}]+', '\\1' || chr(2), 'g'), chr(2)), lambda x: {strip_sql("x")}), lambda x: x <> '') as p from best)),
ord as (select query_id, s, pos, row_number() over (partition by query_id order by len(list_intersect(terms, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')))) desc, pos) as r from sents join terms using (query_id))
select query_id, string_agg(s, ' ' order by r) as answer from ord where r <= 3 group by query_id""".replace("{WS}", r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
)
def answer_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sentences of the best chunk that share most terms with the question."""
    made = answering.extractive(hits(spark, sf_dir, 5), asked(spark, sf_dir), chunks(spark, sf_dir))
    return made.select("query_id", "answer")


CHECK_STOP_SQL = ", ".join(f"'{w}'" for w in T.CHECK_STOPWORDS)


def content_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.,][0-9]+)*'), lambda x: x not in ({CHECK_STOP_SQL})))"


def numbers_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[$]?[0-9][0-9,]*(?:[.][0-9]+)?%?'), lambda n: regexp_replace(n, '[$%,]', '', 'g')))"


CLAIMS_SQL = f"""a as (select trace_id, answer, list_distinct(flatten(list_transform(citations, lambda c: c.chunk_ids))) as cited from {ANSWERS_SQL} where answer is not null),
ctx as (select a.trace_id, string_agg("text", ' ' order by c.chunk_id) as ctx from (select trace_id, unnest(cited) as chunk_id from a) a join {CHUNKS_SQL} c using (chunk_id) group by a.trace_id),
cl as (select trace_id, unnest(c) as claim, generate_subscripts(c, 1) - 1 as claim_no from (select trace_id, list_filter(list_transform(string_split(regexp_replace({protect_sql("answer")}, '([.!?])[{{WS}}]+([A-Z("''\\[])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda p: {strip_sql("replace(p, chr(1), '.')")}), lambda p: p <> '') as c from a)),
f as (select cl.trace_id, claim_no, claim, {numbers_sql("claim")} as cn, {content_sql("claim")} as ct, coalesce({numbers_sql("ctx")}, []) as xn, coalesce({content_sql("ctx")}, []) as xt from cl left join ctx using (trace_id)),
v as (select trace_id, claim_no, case when len(list_filter(cn, lambda n: not list_contains(xn, n))) > 0 then 0.0 when len(ct) = 0 or regexp_matches(claim, '{answering.DISCOURSE}') then 1.0 else len(list_intersect(ct, xt)) / len(ct) end as score,
 len(list_filter(cn, lambda n: not list_contains(xn, n))) = 0 as figures_known from f)""".replace("{WS}", r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}").replace("here(?:'s", "here(?:''s")


@query(f"with {CLAIMS_SQL} select trace_id, cast(claim_no as integer) as claim_no, round(score, 6) as score, figures_known and score >= 0.6 as supported from v")
def verify_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim of every stored answer against the chunks it cites."""
    return verified(spark, sf_dir).select("trace_id", "claim_no", F.round("score", 6).alias("score"), "supported")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).filter("answer is not null").select("trace_id", "answer", F.array_distinct(F.flatten(F.transform("citations", lambda c: c["chunk_ids"]))).alias("cited"))
    return answering.verify(rows, "trace_id", chunks(spark, sf_dir))


@query(f"with {CLAIMS_SQL} select trace_id, cast(count(*) as bigint) as n_claims, round(avg(case when figures_known and score >= 0.6 then 1.0 else 0.0 end), 6) as groundedness from v group by trace_id")
def verify_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verified(spark, sf_dir).groupBy("trace_id").agg(F.count("*").alias("n_claims"), F.avg(F.col("supported").cast("double")).alias("groundedness"))
    return v.select("trace_id", "n_claims", F.round("groundedness", 6).alias("groundedness"))


@query(
    f"""with {CLAIMS_SQL}, lacking as (select trace_id, string_agg(claim, ' | ' order by claim_no) as l, count(*) as n from v join f using (trace_id, claim_no) where not (figures_known and score >= 0.6) group by trace_id)
select a.trace_id, case when l is null then a.answer else a.answer || chr(10) || chr(10) || 'Not supported by the cited passages: ' || l end as answer, cast(coalesce(n, 0) as integer) as n_unsupported from a left join lacking using (trace_id)"""
)
def verify_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a caveat that names their unsupported claims."""
    rows = answers(spark, sf_dir).filter("answer is not null").select("trace_id", "answer")
    return answering.annotate(rows, verified(spark, sf_dir), "trace_id")


@query()
def rewrite_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "history")
    return q.select("query_id", answering.is_dependent(F.col("query")).alias("dependent"), answering.rewrite(F.col("query"), F.col("history")).alias("rewritten"))


@query(
    r"""select question_id as query_id, case when trim(question) = '' then false when regexp_matches(question, '(?i)^\s*(?:and|but|so|then|also|what about|how about|why|and what|and how)\b') or regexp_matches(question, '(?i)\b(?:the (?:year|quarter|period) (?:before|after|prior)|prior year|same for|too|as well)\b') then true
 when regexp_matches(question, '(?i)\b(?:that|those|these|this|it|its|they|them|their|he|she|him|her|his|there)\b') and not regexp_matches(substr(trim(question), 2), '\b[A-Z][a-zA-Z]{2,}') then true
 else len(regexp_split_to_array(trim(question), '\s+')) <= 6 and not regexp_matches(substr(trim(question), 2), '\b[A-Z][a-zA-Z]{2,}') end as dependent from questions"""
)
def rewrite_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", answering.is_dependent(F.col("query")).alias("dependent"))


@query()
def pipeline_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrite, pre-filter, retrieve, sanitise, assemble, refuse or answer, verify, for every question at once."""
    q = questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "history")
    return answering.grounded(q, chunks(spark, sf_dir))

