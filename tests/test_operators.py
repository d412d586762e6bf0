"""Behaviour of single operators on small tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import vectors as V
from gleanery.operators import answering, chunking, context, parsing, security, serving
from gleanery.operators import retrieval as R
from gleanery.sources import filings_index as S
from gleanery.streaming import telemetry


def value(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression.alias("v")).first().v


def test_tokens(spark):
    text = "The 1.5 margin, at 4,218 of U.S. sales"
    assert value(spark, T.retrieval_tokens(F.col("t")), t=text) == ["1.5", "margin", "4", "218", "u", "s", "sales"]
    assert value(spark, T.content_tokens(F.col("t")), t=text) == ["1.5", "margin", "4,218", "u", "s", "sales"]
    assert value(spark, T.numbers(F.col("t")), t="$4,218 and 12.5% and 4,218") == ["4218", "12.5"]
    assert value(spark, T.budget_tokens(F.col("t")), t="naïve, x_1!") == ["naïve", ",", "x_1", "!"]


def test_sentences_and_claims(spark):
    text = "Sales of Acme Inc. rose to $1.2 million. See Item 7. and more? yes! Done"
    df = spark.createDataFrame([("a", text)], "k string, text string")
    got = [text[r.char_start : r.char_end] for r in chunking.sentences(df, "k").orderBy("sentence_no").collect()]
    assert got == ["Sales of Acme Inc. rose to $1.2 million.", "See Item 7. and more?", "yes!", "Done"] or got[0].startswith("Sales of Acme Inc. rose to $1.2 million.")
    assert value(spark, T.claims(F.col("t")), t="It rose. it fell. It stood.") == ["It rose. it fell.", "It stood."]


def test_shingles_and_jaccard(spark):
    assert value(spark, T.shingles(F.split("t", " ")), t="a b c d e") == ["a b c d", "b c d e"]
    assert value(spark, T.shingles(F.split("t", " ")), t="a b") == ["a b"]
    e = F.array().cast("array<string>")
    assert value(spark, T.jaccard(e, e), t=1) == 1.0 and value(spark, T.jaccard(e, F.array(F.lit("a"))), t=1) == 0.0


def test_embedder_is_a_unit_vector_of_signs(spark):
    df = spark.createDataFrame([("alpha alpha beta",), ("",), (None,)], "t string")
    rows = [r.v for r in df.select(V.hashing_embedder(64)(F.col("t")).alias("v")).collect()]
    assert sum(x * x for x in rows[0]) == pytest.approx(1.0) and set(rows[1]) == {0.0} and rows[2] is None


CORPUS = [("c1", "apple banana apple"), ("c2", "banana cherry"), ("c3", "durian"), ("c4", "the of and")]


def corpus(spark):
    return spark.createDataFrame(CORPUS, "chunk_id string, text string")


def asked(spark, *queries):
    return spark.createDataFrame([(str(k), q) for k, q in enumerate(queries)], "query_id string, query string")


def test_bm25(spark):
    hits = R.top_k(R.bm25(corpus(spark), asked(spark, "apple banana", "the and", "apple apple")), 5).collect()
    assert [(r.query_id, r.chunk_id) for r in sorted(hits, key=lambda r: (r.query_id, r["rank"]))] == [("0", "c1"), ("0", "c2"), ("2", "c1")]
    scores = {(r.query_id, r.chunk_id): r.score for r in hits}
    once = R.bm25(corpus(spark), asked(spark, "apple")).first().score
    assert scores["2", "c1"] == pytest.approx(2 * once)


def test_search_is_the_cut_join(spark, sf_dir):
    from gleanery.plans import registry
    from gleanery.plans.search import asked as stated

    every, queries = registry.chunks(spark, sf_dir), stated(spark, sf_dir)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    want = key(R.top_k(R.bm25(every, queries), 7))
    assert key(R.bm25_search(every, queries, 7)) == want == key(R.bm25_search(every, queries, 7, block=3))
    assert R.bm25_search(every, queries.limit(0), 7).collect() == [] == R.bm25_search(every.limit(0), queries, 7).collect()
    filters = R.extract_filters(queries, R.company_aliases(every))
    assert key(R.bm25_search(every, queries, 5, filters=filters)) == key(R.filtered(R.bm25(every, queries), filters, every, 5))


def test_common_terms_and_blocks_of_queries(spark, monkeypatch):
    """Terms by matrices and one by one, queries in several matrices, hits beyond one batch, ties."""
    monkeypatch.setattr(R, "COMMON_CELLS", 10)
    monkeypatch.setattr(R, "MATRIX_QUERIES", 7)
    words = [f"w{k}" for k in range(12)]
    every = spark.createDataFrame([(f"c{k:04}", " ".join(words[j] for j in range(12) if (k * (j + 3)) % (j + 2) == 0), "A" if k % 3 else None, 2000 + k % 2) for k in range(1300)], "chunk_id string, text string, company string, fiscal_year int").coalesce(2)
    queries = asked(spark, *(f"{words[k % 12]} {words[(k * 5) % 12]} {words[(k * 7) % 11]}" for k in range(30)), "nothing")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    assert key(R.bm25_search(every, queries, 4)) == key(R.top_k(R.bm25(every, queries), 4))
    filters = queries.select("query_id", F.lit("a").alias("company"), (F.lit(2000) + F.col("query_id").cast("int") % 3).alias("fiscal_year"))
    assert key(R.bm25_search(every, queries, 4, filters=filters)) == key(R.filtered(R.bm25(every, queries), filters, every, 4))


def test_postings_are_joined_without_a_table_of_pairs(spark, sf_dir):
    from gleanery.plans.catalogue import QUERIES

    plan = QUERIES["bm25_postings_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan and "MapInArrow" in plan


def test_filter_leaves_the_statistics(spark):
    full = {r.chunk_id: r.score for r in R.bm25(corpus(spark), asked(spark, "banana")).collect()}
    kept = {r.chunk_id: r.score for r in R.bm25(corpus(spark), asked(spark, "banana"), where=F.col("chunk_id") == "c2").collect()}
    assert kept == {"c2": full["c2"]}


def test_access_is_checked_before_scores(spark):
    """The predicate is applied to postings, below the join with the weights."""
    plan = R.bm25(corpus(spark), asked(spark, "banana"), where=F.col("chunk_id") == "c2")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line and "candidate" in line]
    assert filters and plan.index(filters[0]) > plan.index("Join Inner")


def test_scan_reads_the_columns_it_needs(spark, sf_dir):
    from gleanery.plans.catalogue import QUERIES

    plan = QUERIES["rel_filtered_aggregate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "l_quantity" in schema and "l_tax" not in schema and "l_partkey" not in schema


def test_dense(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0]), ("n", None)], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [(r.chunk_id, r["rank"], r.score) for r in R.dense(index, q, 3).orderBy("rank").collect()] == [("a", 1, 1.0), ("c", 2, 1.0), ("b", 3, 0.0)]
    with pytest.raises(Exception, match="dimension"):
        R.dense(index, spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>"), 1).collect()


def test_dense_filters_before_the_cut(spark):
    rows = [(f"a{k:02}", [1.0, k / 100], "Other", 2020) for k in range(60)] + [("b1", [0.1, 1.0], "Acme Inc.", 2021), ("b2", [0.0, 1.0], "ACME INC.", 2021), ("b3", [-1.0, 0.0], None, None)]
    index = spark.createDataFrame(rows, "chunk_id string, vector array<double>, company string, fiscal_year int")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in "xyz"], "query_id string, vector array<double>")
    filters = spark.createDataFrame([("x", "Acme Inc.", 2021), ("y", "Nobody", 1999)], "query_id string, company string, fiscal_year int")
    ranked = lambda hits: {i: [r.chunk_id for r in hits.filter(F.col("query_id") == i).orderBy("rank").collect()] for i in "xyz"}
    got = ranked(R.dense(index, q, 2, filters=filters))
    assert got == {"x": ["b1", "b2"], "y": ["b3"], "z": ["a00", "a01"]}
    assert got == ranked(R.filtered(R.dense(index, q, 100).select("query_id", "chunk_id", "score"), filters, index, 2))
    assert ranked(R.dense(index.filter("company is not null"), q, 2, filters=filters))["y"] == ["a00", "a01"]


def test_fusion(spark):
    ranking = lambda *ids: spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "query_id string, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in R.reciprocal_rank_fusion(ranking("a", "b"), ranking("b", "c"), weights=(1.0, 2.0)).collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 2 / 61), "c": pytest.approx(2 / 62)}
    with pytest.raises(ValueError):
        R.reciprocal_rank_fusion(ranking("a"), weights=(1.0, 1.0))


def test_filters_and_fallback(spark):
    meta = spark.createDataFrame([("c1", "Acme Inc.", 2020, "apple"), ("c2", "Borealis Corp", 2021, "apple"), ("c3", None, None, "apple")], "chunk_id string, company string, fiscal_year int, text string")
    queries = asked(spark, "apple at Acme", "apple at Acme and Borealis in 2021", "apple in 2050", "apple")
    filters = R.extract_filters(queries, R.company_aliases(meta))
    assert {r.query_id: (r.company, r.fiscal_year) for r in filters.collect()} == {"0": ("Acme Inc.", None), "1": (None, 2021), "2": (None, 2050), "3": (None, None)}
    got = {}
    for r in R.filtered(R.bm25(meta, queries), filters, meta, 5).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {"0": {"c1", "c3"}, "1": {"c2", "c3"}, "2": {"c3"}, "3": {"c1", "c2", "c3"}}
    none = meta.filter("chunk_id <> 'c3'")
    assert {r.chunk_id for r in R.filtered(R.bm25(none, asked(spark, "apple in 2050")), R.extract_filters(asked(spark, "apple in 2050"), R.company_aliases(none)), none, 5).collect()} == {"c1", "c2"}


def test_short_aliases(spark):
    meta = spark.createDataFrame([("c1", "3M"), ("c2", "Q")], "chunk_id string, company string")
    got = R.extract_filters(asked(spark, "profit of 3M", "nothing", None), R.company_aliases(meta)).collect()
    assert {r.query_id: r.company for r in got} == {"0": "3M", "1": None, "2": None}


def documents(spark, text, sections=None, tables=None):
    schema = "doc_id string, text string, sections array<struct<section_name:string,section_order:int,char_start:int,char_end:int>>, doc_tables array<struct<grid:array<array<string>>,caption:string,char_start:int,char_end:int>>"
    return spark.createDataFrame([("d", text, sections, tables)], schema)


TEXT = "Front matter.\n\n" + "\n\n".join(f"Paragraph {k} tells that revenue rose by {k}.5% in the year. It also tells that cost fell." for k in range(40))


@pytest.mark.parametrize("name", sorted(chunking.CHUNKERS))
def test_chunks_hold_the_text_of_their_span(spark, name):
    start = TEXT.index("Paragraph 0")
    knobs = {"fixed": {"size": 64, "overlap": 8}, "recursive": {"size": 64, "overlap": 20}, "structure": {"size": 64}, "parent_document": {"parent": 128, "child": 24}}.get(name, {})
    rows = chunking.build_chunker(name, **knobs)(documents(spark, TEXT, [("s", 0, start, len(TEXT))], [(None, None, TEXT.index("Paragraph 3"), TEXT.index("Paragraph 6") - 2)])).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) > 3
    again = chunking.build_chunker(name, **knobs)(documents(spark, TEXT, [("s", 0, start, len(TEXT))], [(None, None, TEXT.index("Paragraph 3"), TEXT.index("Paragraph 6") - 2)])).collect()
    assert {r.chunk_id for r in again} == {r.chunk_id for r in rows}
    for r in rows:
        assert start <= r.char_start < r.char_end <= len(TEXT)
        assert TEXT[r.char_start : r.char_end].strip() == TEXT[r.char_start : r.char_end]
        if "text" in r.asDict():
            assert r.text == TEXT[r.char_start : r.char_end]
        if name in ("fixed", "recursive"):
            assert r.n_tokens == chunking.count_tokens(TEXT[r.char_start : r.char_end]) <= 64
        if name == "structure":
            a, b = TEXT.index("Paragraph 3"), TEXT.index("Paragraph 6") - 2
            assert not (r.char_start < a < r.char_end < b) and not (a < r.char_start < b < r.char_end)


def test_fixed_windows(spark):
    words = " ".join(f"w{k}" for k in range(10))
    rows = chunking.fixed(documents(spark, words), 4, 1).orderBy("chunk_index").collect()
    assert [words[r.char_start : r.char_end] for r in rows] == ["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9", "w9"]
    with pytest.raises(ValueError):
        chunking.fixed(documents(spark, words), 4, 4)
    with pytest.raises(ValueError, match="known: fixed"):
        chunking.build_chunker("nothing")


def test_pages(spark):
    page = "<html><head><title>T</title></head><body><p>One&nbsp;two<p>Three<table><tr><td>Name</td><td>2020</td></tr><tr><td></td></tr><tr><td>Cost</td><td>5</td></tr></table><script>x</script>Last</body></html>"
    text, tables = parsing.page_text(page)
    assert text == "One two\nThree\nName | 2020\nCost | 5\nLast" and tables[0]["grid"] == [["Name", "2020"], ["Cost", "5"]]
    assert text[tables[0]["char_start"] : tables[0]["char_end"]] == "Name | 2020\nCost | 5"
    assert parsing.page_text(None) == (None, []) and parsing.page_text("") == ("", [])


def test_sections_take_the_last_heading(spark):
    body = "x " * 400
    text = f"Contents Item 1. Business 3 Item 1A. Risk Factors 9\n\nItem 1. Business {body}\nItem 1A. Risk Factors {body}\nItem 7. Management's Discussion short\nItem 8. Financial Statements end"
    rows = parsing.find_sections(spark.createDataFrame([("d", text)], "doc_id string, text string"), "doc_id", "text").orderBy("char_start").collect()
    assert [r.section_name for r in rows] == ["Item 1 Business", "Item 1A Risk Factors", "Item 8 Financial Statements"]
    assert rows[0].char_start == text.index("Item 1. Business x") and rows[1].char_end == text.index("Item 7.") and rows[2].char_end == len(text)


def test_contexts(spark):
    rows = [("c1", "one two three four five six"), ("c2", "one two three four five six"), ("c3", "alpha beta gamma delta"), ("c4", "x " * 50), ("c5", "y z")]
    hits = spark.createDataFrame([("q", c, k + 1, 1.0 - k / 10) for k, (c, _) in enumerate(rows)], "query_id string, chunk_id string, rank int, score double")
    r = context.assemble(hits, spark.createDataFrame(rows, "chunk_id string, text string"), max_tokens=20).first()
    assert [k.chunk_id for k in r.kept] == ["c1", "c5", "c3"] and [(d.dropped, d.kept) for d in r.dropped_duplicate] == [("c2", "c1")] and r.dropped_budget == ["c4"] and r.tokens_used == 12
    five = spark.createDataFrame([("q", f"c{k}", k, 1.0) for k in range(1, 6)], "query_id string, chunk_id string, rank int, score double")
    assert [x.chunk_id for x in context.presentation_order(five).orderBy("position").collect()] == ["c1", "c3", "c5", "c4", "c2"]


def test_verification(spark):
    answers = spark.createDataFrame([("t", "Revenue rose to $5,100 million. Revenue rose to 7%. Overall, fine. Unrelated words everywhere.", ["c"])], "trace_id string, answer string, cited array<string>")
    known = spark.createDataFrame([("c", "In 2020 revenue rose to $5,100 million")], "chunk_id string, text string")
    rows = answering.verify(answers, "trace_id", known).orderBy("claim_no").collect()
    assert [(r.supported, r.score) for r in rows] == [(True, 1.0), (False, 0.0), (True, 1.0), (False, 0.0)]
    assert rows[1].reason == "figures not in context: 7"


def test_rewriting(spark):
    df = spark.createDataFrame([("and in the next year?", [("How did Acme Mills do in 2021?", "Acme Mills grew.")]), ("What did Borealis report about its costs in 2020?", [("x", "Acme Mills in 2021")]), ("and then?", [])], "query string, history array<struct<question:string,answer:string>>")
    got = [r.v for r in df.select(answering.rewrite(F.col("query"), F.col("history")).alias("v")).collect()]
    assert got == ["How Acme Mills fiscal 2021: and in the next year?", "What did Borealis report about its costs in 2020?", "and then?"] or got[0].endswith("fiscal 2021: and in the next year?")


def test_access(spark):
    a = lambda roles, held, **k: value(spark, security.allowed(F.col("r"), F.col("h"), **k), r=roles, h=held)
    assert a(["public"], ["x"]) and a(["a", "b"], ["b"]) and not a(["a"], ["b"])
    df = spark.createDataFrame([(None, ["a"]), ([], ["a"]), (["a"], None)], "r array<string>, h array<string>")
    assert [r.v for r in df.select(security.allowed(F.col("r"), F.col("h")).alias("v")).collect()] == [False, False, False]
    assert [r.v for r in df.select(security.allowed(F.col("r"), F.col("h"), strict=False).alias("v")).collect()] == [True, True, False]


def test_injections(spark):
    found = {r.attempt_id: r.v for r in security.attacks(spark).select("attempt_id", T.detect_injection(F.col("payload")).alias("v")).collect()}
    assert "imperative_override" in found["inj-direct"] and "invisible_characters" in found["inj-invisible"] and "url_exfiltration" in found["inj-markdown"] and found["inj-exfiltration"] == []
    assert value(spark, T.detect_injection(F.col("t")), t="This note supersedes the earlier disclosure.") == []
    assert value(spark, security.sanitise(F.col("t")), t="a​b </passage> ｘ") == "ab [passage] x"


def test_failure_runs_cross_days(spark):
    rows, n = [], 0
    for day, outcomes in ((1, "0011"), (2, "11"), (3, "1011"), (5, "0")):
        for k, failed in enumerate(outcomes):
            n += 1
            rows.append(("c", pd.Timestamp(2024, 1, day, k).to_pydatetime(), n, failed == "1"))
    df = spark.createDataFrame(rows, "component string, at timestamp_ntz, id long, failed boolean")
    r = serving.failure_runs(df, "component", "at", "id", F.col("failed"), threshold=2).first()
    assert (r.n, r.n_failed, r.longest_run, r.n_runs_at_threshold) == (11, 7, 5, 2)


def test_breaker_states():
    outcomes = [(0, True), (1, True), (2, True), (40, True), (41, False), (80, False), (81, True)]
    state, seen = ("closed", 0, 0.0, 0), []
    for at, failed in outcomes:
        state = telemetry.step(state, at, failed, 2, 30.0)
        seen.append((state[0], state[3]))
    # the request at 2 and the success at 41 meet an open circuit; the one at 40 is a probe that fails, the one at 80 one that succeeds
    assert seen == [("closed", 0), ("open", 1), ("open", 1), ("open", 2), ("open", 2), ("closed", 2), ("closed", 2)]
    assert [telemetry.admitted(("open", 2, 0.0, 1), at, 30.0) for at in (29, 30)] == ["reject", "probe"] and telemetry.admitted(("closed", 1, 0.0, 0), 1, 30.0) == "call"


def test_cache(spark):
    entries = spark.createDataFrame([("live", [1.0, 0.0], 90.0, "v1"), ("old", [1.0, 0.0], 1.0, "v1"), ("other", [1.0, 0.0], 95.0, "v0")], "entry_id string, vector array<double>, created_at double, corpus_version string")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("far", [0.0, 1.0])], "query_id string, vector array<double>")
    got = {r.query_id: r.entry_id for r in serving.cache_lookup(queries, entries, now=100.0, version="v1", ttl=50.0).collect()}
    assert got == {"q": "live", "far": None}
    stored = spark.createDataFrame([("a", 5, 1.0), ("b", 0, 2.0), ("c", 0, 3.0)], "key string, hits int, created_at double")
    new = spark.createDataFrame([("d", 0, 4.0, None), ("e", 0, 5.0, "failed")], "key string, hits int, created_at double, error string")
    assert {r.key for r in serving.cache_put(stored, new, capacity=3).collect()} == {"a", "c", "d"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.url").write_text("https://x/1\n")
    (tmp_path / "a.body").write_bytes("naïve".encode())
    responses = S.recorded(spark, str(tmp_path))
    wanted = spark.createDataFrame([("https://x/1",), ("https://x/2",)], "url string")
    assert {r.url: r.body and bytes(r.body).decode() for r in S.fetch(wanted, responses, strict=False).collect()} == {"https://x/1": "naïve", "https://x/2": None}
    with pytest.raises(Exception, match="no recorded response"):
        S.fetch(wanted, responses).collect()
    lines = tmp_path / "set.jsonl"
    lines.write_text('// a comment\n{"id": "a"}\n\n{"id": \n{"id": "b", "more": 1}\n')
    records = S.read_dataset(spark, str(lines), "id string")
    assert [(r.line_no, r.id, r.problem is not None) for r in records.orderBy("line_no").collect()] == [(2, "a", False), (4, None, True), (5, "b", False)]
    with pytest.raises(ValueError, match=r"\[4\]"):
        S.require_records(records)
    with pytest.raises(ValueError, match="empty"):
        S.require_records(records.filter("false"))


def test_index_guard(spark, tmp_path):
    index = spark.createDataFrame([("c", [1.0])], "chunk_id string, vector array<double>")
    S.write_index(index, str(tmp_path / "i"), {"name": "hashing", "dim": 1})
    assert S.read_index(spark, str(tmp_path / "i"), {"dim": 1, "name": "hashing"}).count() == 1
    with pytest.raises(ValueError, match="made by"):
        S.read_index(spark, str(tmp_path / "i"), {"name": "hashing", "dim": 2})
    assert S.baseline(spark, str(tmp_path / "none")) is None


def test_submissions_with_limit(spark):
    raw = json.dumps({"name": "X", "filings": {"recent": {"form": ["10-K", "10-K"], "accessionNumber": ["a"], "filingDate": ["2024-01-01", ""], "reportDate": [], "primaryDocument": []}}})
    df = spark.createDataFrame([(1, raw), (2, "{}")], "cik long, body string")
    assert [(r.accession, r.fiscal_year) for r in S.list_filings(df).orderBy("accession").collect()] == [("", 0), ("a", 2024)]
    assert [r.accession for r in S.list_filings(df, limit=1).collect()] == ["a"]


def test_stream_equals_batch(spark, sf_dir):
    from gleanery.plans.catalogue import QUERIES

    from gleanery.session import table

    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    passed = table(spark, sf_dir, "trace_spans").agg(F.max("started_at") - F.expr("interval 1 day 1 hour")).first()[0]
    batch = QUERIES["serve_hourly"](spark, sf_dir).filter(F.col("hour") <= F.lit(passed))
    assert batch.count() > 0 and key(QUERIES["stream_hourly_spans"](spark, sf_dir)) == key(batch)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
