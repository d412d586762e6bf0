"""SQL for those llm queries that SQL can express over whole tables."""

_FILINGS = "(select * from (select *, row_number() over (partition by doc_id order by ingested_at desc) as version from filings) where version = 1)"

_MEASURED = """measured as (select 'duration_ms' as metric, span_name as group_name, strftime(started_at, '%Y-%m-%d') as day_utc, duration_ms as v
 from (select *, row_number() over (partition by span_id order by received_at) as version from trace_spans) where version = 1 and duration_ms >= 0 and not isnan(duration_ms)
 union all select 'output_tokens', model_name, strftime(answered_at, '%Y-%m-%d'), cast(token_usage.output_tokens as double)
 from (select *, row_number() over (partition by trace_id order by answered_at) as version from answers) where version = 1 and token_usage.output_tokens >= 0),
placed as (select *, row_number() over (partition by metric, group_name, day_utc order by v) as place, count(*) over (partition by metric, group_name, day_utc) as n from measured where group_name is not null and day_utc is not null)"""

ORACLES: dict[str, str] = {
    "p2_found": f"""select doc_id, 'document' as item_kind, cast(0 as integer) as item_no from {_FILINGS} where length("text") > 2000
union all select doc_id, 'section', s.section_order from (select doc_id, unnest(sections) as s from {_FILINGS}) where s.char_end - s.char_start > 2000
union all select doc_id, 'table', cast(pos - 1 as integer) from (select doc_id, unnest(doc_tables) as t, generate_subscripts(doc_tables, 1) as pos from {_FILINGS}) where t.char_end - t.char_start > 2000""",
    "p6_found": f"""with {_MEASURED} select p.metric, p.group_name, cast(q.quantile_pct as integer) as quantile_pct, p.day_utc from placed p join quantile_marks q on q.metric = p.metric and q.group_name = p.group_name
where p.place = greatest(1, cast(ceil(q.quantile_pct * p.n / 100.0) as bigint)) and p.v > q.mark_value""",
    "p6_day_percentiles": f"""with {_MEASURED} select metric, group_name, day_utc, cast(pct as integer) as quantile_pct, cast(n as bigint) as n, v as value from placed, (values (50), (90), (95), (99)) w(pct)
where place = greatest(1, cast(ceil(pct * n / 100.0) as bigint))""",
}
