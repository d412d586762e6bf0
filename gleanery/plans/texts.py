"""Queries of the text functions, of parsing and of chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import chunking, parsing
from gleanery.plans.registry import ANSWERS_SQL, CHUNKS_SQL, FILINGS_SQL, answers, chunks, filings, query, questions
from gleanery.session import table

WS_SQL = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.][0-9]+)?'), lambda x: x not in ({STOP_SQL}))"


PLAIN_TOKENS_SQL = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.][0-9]+)?')"


def protect_sql(text: str) -> str:
    once = f"regexp_replace({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({T.ABBREVIATIONS})\\.', '\\1\\2' || chr(1), 'g')"
    for _ in range(2):
        once = f"regexp_replace({once}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1' || chr(1) || '\\2', 'g')"
    return once


SENTENCE_PARTS_SQL = f"string_split(replace(regexp_replace({protect_sql('"text"')}, '([.!?])([{WS_SQL}]+)', '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(3), chr(2)), chr(2))"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g')"


@query(
    f"""select doc_id, {strip_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + '"text"' + r", '\x{a0}', ' ', 'g'), '\r\n?', chr(10), 'g'), '[ \t\f\x{0b}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} as normalized from documents"""
)
def text_normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("normalized"))


@query(f"""select chunk_id, cast(len(t) as integer) as n_tokens, array_to_string(t, ' ') as tokens from (select chunk_id, {tokens_sql('"text"')} as t from {CHUNKS_SQL})""")
def text_retrieval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.retrieval_tokens(F.col("text"))
    return chunks(spark, sf_dir).select("chunk_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"""select doc_id, cast(len(regexp_extract_all("text", '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WS_SQL}]')) as integer) as n_tokens from documents""")
def text_budget_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.budget_tokens(F.col("text"))).alias("n_tokens"))


@query(
    f"""with parts as (select chunk_id, unnest(p) as part, generate_subscripts(p, 1) as pos from (select chunk_id, {SENTENCE_PARTS_SQL} as p from {CHUNKS_SQL})),
placed as (select chunk_id, pos, part, coalesce(sum(length(part)) over (partition by chunk_id order by pos rows between unbounded preceding and 1 preceding), 0) as char_start from parts)
select chunk_id, cast(row_number() over (partition by chunk_id order by pos) - 1 as integer) as sentence_no, cast(char_start as integer) as char_start, cast(char_start + length(part) as integer) as char_end
from placed where pos % 2 = 1 and {strip_sql("part")} <> ''"""
)
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentences(chunks(spark, sf_dir), "chunk_id").select("chunk_id", "sentence_no", "char_start", "char_end")


@query(
    f"""select trace_id, cast(pos - 1 as integer) as claim_no, claim from (select trace_id, unnest(c) as claim, generate_subscripts(c, 1) as pos from (
 select trace_id, list_filter(list_transform(string_split(regexp_replace({protect_sql("answer")}, '([.!?])[{WS_SQL}]+([A-Z("''\\[])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda p: {strip_sql("replace(p, chr(1), '.')")}), lambda p: p <> '') as c from {ANSWERS_SQL}))"""
)
def text_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("trace_id", F.posexplode(T.claims(F.col("answer"))).alias("claim_no", "claim"))


@query(f"""select trace_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '[$]?[0-9][0-9,]*(?:[.][0-9]+)?%?'), lambda n: regexp_replace(n, '[$%,]', '', 'g')))), ' ') as numbers from {ANSWERS_SQL}""")
def text_numeric_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("trace_id", F.array_join(F.array_sort(T.numbers(F.col("answer"))), " ").alias("numbers"))


@query(f"""select doc_id, substr(sha256(metadata['cik'] || chr(0) || metadata['accession'] || chr(0) || metadata['form_type']), 1, 16) as derived_id from {FILINGS_SQL} where metadata['cik'] is not null and metadata['accession'] is not null and metadata['form_type'] is not null""")
def text_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col("metadata")[k] for k in ("cik", "accession", "form_type")]
    kept = filings(spark, sf_dir).filter(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull())
    return kept.select("doc_id", T.stable_id(*parts).alias("derived_id"))


@query("select doc_id, sha256(\"text\") as content_hash, cast(count(*) over (partition by sha256(\"text\")) as bigint) as n_copies from documents")
def text_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every text and how many texts share it; counted by aggregate and join, so a hot text is no hot task."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.join(hashed.groupBy("content_hash").agg(F.count("*").alias("n_copies")), "content_hash").select("doc_id", "content_hash", "n_copies")


@query(f"""select chunk_id, cast(case when len(t) = 0 then 0 when len(t) < 4 then 1 else len(list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')))) end as integer) as n_shingles from (select chunk_id, {PLAIN_TOKENS_SQL.format('"text"')} as t from {CHUNKS_SQL})""")
def text_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", F.size(T.shingles(T.plain_tokens(F.col("text")))).alias("n_shingles"))


@query(r"""select question_id, array_to_string(list_sort(list_distinct(regexp_extract_all(question, '(?i)\b(?:fiscal\s+(?:year\s+)?|FY\s*)?((?:19|20)[0-9]{2})\b', 1))), ' ') as years from questions""")
def text_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", F.array_join(F.array_sort(T.years(F.col("question"))), " ").alias("years"))


INVISIBLE_SQL = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"


@query(f"""select doc_id, regexp_replace("text", '{INVISIBLE_SQL}', '', 'g') as visible from documents""")
def text_drop_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_invisible(F.col("text")).alias("visible"))


@query()
def text_strip_invisible_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_invisible(F.col("text")).alias("visible"))


@query(
    f"""with parts as (select trace_id, unnest(generate_series(1, cast(length(answer) as bigint), 48)) as pos, answer from {ANSWERS_SQL} where length(answer) > 0)
select trace_id, cast((pos - 1) // 48 as integer) as part_no, substr(answer, pos, 48) as part from parts"""
)
def text_fixed_width_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("trace_id", F.posexplode(T.fixed_width_parts(F.col("answer"))).alias("part_no", "part"))


# ---- parsing


@query()
def parse_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and tables of every page."""
    pages = table(spark, sf_dir, "raw_filings").withColumn("doc_id", T.stable_id(F.col("cik").cast("string"), F.col("accession"), F.col("form_type")))
    parsed = parsing.parse_pages(pages.select("doc_id", "html"), "doc_id", "html")
    return parsed.select("doc_id", F.length("text").alias("n_chars"), F.size("doc_tables").alias("n_tables"), F.sha2("text", 256).alias("content_hash"))


@query(
    r"""select accession, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head|title)\b[^>]*>.*?</(script|style|head|title)>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as stripped from raw_filings"""
)
def parse_html_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_filings").select("accession", parsing.strip_tags(F.col("html")).alias("stripped"))


def _sections_sql() -> str:
    at = " union all ".join(
        f"""select doc_id, length("text") as n_chars, '{name.replace("'", "''")}' as section_name, {order} as section_order, length(regexp_extract('#' || "text", '(?is)^(.*){pattern}', 1)) - 1 as char_start from docs where regexp_matches("text", '(?is){pattern}')"""
        for order, (name, pattern) in enumerate(parsing.ITEM_PATTERNS)
    )
    return f"""with docs as (select doc_id, "text" from {FILINGS_SQL}), found as ({at}),
ended as (select *, lead(char_start) over (partition by doc_id order by char_start, section_order) as following from found)
select doc_id, section_name, cast(section_order as integer) as section_order, cast(char_start as integer) as char_start, cast(coalesce(following, n_chars) as integer) as char_end from ended where following is null or following - char_start >= 500"""


@query(_sections_sql())
def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.find_sections(filings(spark, sf_dir), "doc_id", "text")


@query(
    f"""select doc_id, cast(coalesce(list_min(list_transform(sections, lambda s: s.char_start)), 0) as integer) as content_start, substr("text", 1, coalesce(list_min(list_transform(sections, lambda s: s.char_start)), 0)) as front_matter from {FILINGS_SQL}"""
)
def parse_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = parsing.content_start(F.col("sections"))
    return filings(spark, sf_dir).select("doc_id", start.alias("content_start"), F.substr("text", F.lit(1), start).alias("front_matter"))


@query(
    f"""select c.chunk_id, s.section_name, cast(coalesce(s.section_order, -1) as integer) as section_order from {CHUNKS_SQL} c left join (
 select doc_id, s.section_name, s.section_order, s.char_start, s.char_end from (select doc_id, unnest(sections) as s from {FILINGS_SQL})) s
 on s.doc_id = c.doc_id and s.char_start <= c.char_start and c.char_start < s.char_end
 qualify row_number() over (partition by c.chunk_id order by s.section_order) = 1"""
)
def parse_section_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks(spark, sf_dir).join(filings(spark, sf_dir).select("doc_id", "sections"), "doc_id", "left")
    s = parsing.section_at(F.col("sections"), F.col("char_start"))
    return found.select("chunk_id", s["section_name"].alias("section_name"), F.coalesce(s["section_order"], F.lit(-1)).alias("section_order"))


@query(
    f"""select c.chunk_id, cast(count(t.char_start) as bigint) as n_tables from {CHUNKS_SQL} c left join (select doc_id, t.char_start, t.char_end from (select doc_id, unnest(doc_tables) as t from {FILINGS_SQL})) t
 on t.doc_id = c.doc_id and least(t.char_end, c.char_end) > greatest(t.char_start, c.char_start) group by c.chunk_id"""
)
def parse_tables_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks(spark, sf_dir).join(filings(spark, sf_dir).select("doc_id", "doc_tables"), "doc_id", "left")
    n = F.size(parsing.tables_overlapping(F.coalesce("doc_tables", F.array()), F.col("char_start"), F.col("char_end")))
    return found.select("chunk_id", F.greatest(n, F.lit(0)).cast("long").alias("n_tables"))


# ---- chunking


@query(
    f"""with docs as (select doc_id, substr("text", coalesce(list_min(list_transform(sections, lambda s: s.char_start)), 0) + 1) as body, coalesce(list_min(list_transform(sections, lambda s: s.char_start)), 0) as base from {FILINGS_SQL}),
parts as (select doc_id, base, unnest(p) as part, generate_subscripts(p, 1) as pos from (select doc_id, base, regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WS_SQL}]|[{WS_SQL}]+') as p from docs)),
placed as (select doc_id, base, pos, part, coalesce(sum(length(part)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) + base as char_start from parts),
lists as (select doc_id, list(char_start order by pos) as starts, list(char_start + length(part) order by pos) as ends from placed where not regexp_full_match(part, '[{WS_SQL}]+') group by doc_id),
windows as (select doc_id, starts, ends, unnest(range(0, len(starts), 462)) as first_token from lists),
w as (select doc_id, first_token, starts[first_token + 1] as a, ends[least(first_token + 512, len(ends))] as b, least(first_token + 512, len(ends)) - first_token as n from windows)
select doc_id, cast(first_token // 462 as integer) as chunk_index, cast(a as integer) as char_start, cast(b as integer) as char_end, cast(n as integer) as n_tokens,
 substr(sha256(doc_id || chr(0) || 'fixed' || chr(0) || '512' || chr(0) || cast(cast(a as bigint) as varchar) || chr(0) || cast(cast(b as bigint) as varchar)), 1, 16) as chunk_id from w"""
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed(filings(spark, sf_dir)).select("doc_id", "chunk_index", "char_start", "char_end", "n_tokens", "chunk_id")


@query(
    f"""with docs as (select doc_id, substr("text", coalesce(list_min(list_transform(sections, lambda s: s.char_start)), 0) + 1) as "text", coalesce(list_min(list_transform(sections, lambda s: s.char_start)), 0) as base from {FILINGS_SQL}),
parts as (select doc_id, base, unnest(p) as part, generate_subscripts(p, 1) as pos from (select doc_id, base, {SENTENCE_PARTS_SQL} as p from docs)),
placed as (select doc_id, pos, part, coalesce(sum(length(part)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) + base as char_start from parts),
sentences as (select doc_id, pos, char_start, char_start + length(part) as char_end from placed where pos % 2 = 1 and {strip_sql("part")} <> '')
select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as integer) as chunk_index, cast(char_start as integer) as focus_start, cast(char_end as integer) as focus_end,
 cast(min(char_start) over w as integer) as char_start, cast(max(char_end) over w as integer) as char_end from sentences window w as (partition by doc_id order by pos rows between 2 preceding and 2 following)"""
)
def chunk_sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_window(filings(spark, sf_dir)).select("doc_id", "chunk_index", "focus_start", "focus_end", "char_start", "char_end")


def _sequential(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunking.build_chunker(name)(filings(spark, sf_dir)).select("doc_id", "chunk_id", "chunk_index", "char_start", "char_end", "n_tokens")

    run.__name__ = f"chunk_{name}"
    return run


for _name in ("recursive", "structure", "parent_document", "semantic"):
    query()(_sequential(_name))


@query(
    f"""with c as (select chunk_id, doc_id, char_start, char_end from {CHUNKS_SQL}) select doc_id, cast(count(*) as bigint) as n_chunks, cast(min(char_start) as integer) as first_start, cast(max(char_end) as integer) as last_end,
 round(avg(char_end - char_start), 4) as mean_chars from c group by doc_id"""
)
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("char_start").alias("first_start"), F.max("char_end").alias("last_end"), F.round(F.avg(F.col("char_end") - F.col("char_start")), 4).alias("mean_chars"))

