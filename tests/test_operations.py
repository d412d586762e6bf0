import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import answering, chunking, judging, parsing, plugins, reports, security, serving
from gleanery.operators import evaluation as E
from gleanery.operators import retrieval as R
from gleanery.operators.repeats import settled
from gleanery.operators.tracing import Tracer
from gleanery.sources import filings_index


def test_tracer(spark):
    times = iter(range(100))
    gone = []

    def broken(span):
        gone.append(span.span_name)
        raise OSError

    tracer = Tracer(broken, keep=3, clock=lambda: float(next(times)))
    with pytest.raises(KeyError), tracer.span("outer", k=1) as outer:
        with tracer.span("inner"):
            pass
        with tracer.span("failing"):
            raise KeyError("x")
    assert [s.span_name for s in tracer.finished] == ["inner", "failing", "outer"] == gone and tracer.export_failures == 3
    rows = {r.span_name: r for r in tracer.rows(spark).collect()}
    assert rows["inner"].parent_no == outer.span_no and rows["inner"].depth == 1 and rows["outer"].depth == 0
    assert rows["failing"].error == rows["outer"].error == "KeyError: 'x'" and rows["inner"].error is None
    assert rows["inner"].duration_ms == 1000.0 and len({r.trace_id for r in rows.values()}) == 1
    with tracer.span("next"):
        pass
    assert len(tracer.finished) == 3  # the last ones are kept


def test_ramp():
    seen = []

    def answer(q):
        seen.append(q)
        if q == "bad":
            raise ValueError

    levels = serving.ramp(answer, ["a", "b", "bad"], levels=(1, 4), requests=9)
    assert [(x["workers"], x["requests"], x["errors"]) for x in levels] == [(1, 9, 3), (4, 9, 3)] and len(seen) == 18
    assert all(x["p50_ms"] <= x["p95_ms"] <= x["p99_ms"] <= x["max_ms"] for x in levels)
    with pytest.raises(ValueError):
        serving.ramp(answer, [])


def test_percentiles_without_a_buffer(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([0.0, rng.uniform(0, 1e-9), rng.uniform(1, 2), rng.lognormvariate(3, 3)])) for g in ("a", "b", None) for _ in range(rng.randint(1, 400))] + [("one", 7.0), ("same", 3.0), ("same", 3.0), ("none", float("nan")), ("none", None), ("none", -1.0)]
    df = spark.createDataFrame(rows, "g string, duration_ms double")
    got = {r.g: r for r in serving.latency_report(df, "g").collect()}
    assert set(got) == {"a", "b", None, "one", "same"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g]
        want = np.percentile(own, [50, 95, 99])
        assert [r.p50, r.p95, r.p99] == pytest.approx(want.tolist(), rel=1e-12) and r.n == len(own) and r.max_ms == max(own)
    (whole,) = serving.latency_report(df).collect()
    assert whole.n == sum(r.n for r in got.values())
    assert serving.latency_report(df.limit(0)).collect() == [] == serving.latency_report(df.limit(0), "g").collect()


def test_select_questions(spark):
    df = spark.createDataFrame([("a", "x", "me", "now"), ("b", "x", None, "now"), ("c", "y", "me", "now"), ("d", "x", "me", "now")], "question_id string, question_type string, verified_by string, verified_at string")
    ids = lambda **k: [r.question_id for r in E.select_questions(df, **k).orderBy("question_id").collect()]
    assert ids() == ["a", "b", "c", "d"] and ids(types=["x"]) == ["a", "b", "d"] and ids(types=["x"], verified=True, limit=1) == ["a"]
    assert ids(ids=["b", "c"], verified=False) == ["b"] and ids(types=[]) == []


def test_slice_of_another_document_is_an_error(spark):
    df = spark.createDataFrame([("d", "d", "0123456789"), ("d", "e", "0123456789")], "doc_id string, of string, text string")
    part = parsing.slice_span(F.col("text"), F.col("doc_id"), F.col("of"), F.lit(2), F.lit(5)).alias("p")
    assert df.filter("of = doc_id").select(part).first().p == "234"
    with pytest.raises(Exception, match="span of document e"):
        df.select(part).collect()


def test_bootstrap_by_join_and_by_broadcast_agree(spark):
    rng = random.Random(2)
    rows = [(m, f"q{k}", rng.random() if k % 7 else None) for m in ("x", "y") for k in range(40 if m == "x" else 25)]
    df = spark.createDataFrame(rows, "metric string, question_id string, value double")
    means = [{(r.metric, r.replicate): r.mean for r in E.bootstrap_means(df, 60, "s", n).collect()} for n in (10**6, 3)]
    assert means[0].keys() == means[1].keys() and all(means[0][k] == pytest.approx(means[1][k]) for k in means[0])
    assert E.bootstrap_means(df.limit(0), 60, "s").collect() == []
    (lone,) = E.bootstrap_interval(df.filter("question_id = 'q1' and metric = 'x'"), 50).collect()
    assert lone.ci_low == lone.ci_high == lone.mean


def test_metrics_are_drawn_in_groups_before_any_join(spark):
    rng = random.Random(4)
    rows = [(m, f"q{k}", rng.random()) for m in ("x", "y", "z") for k in range(30 if m == "x" else 25)]
    df = spark.createDataFrame(rows, "metric string, question_id string, value double")
    grouped = E.bootstrap_means(df, 60, "s", 50)
    assert "Join" not in grouped._jdf.queryExecution().optimizedPlan().toString()
    means = [{(r.metric, r.replicate): r.mean for r in made.collect()} for made in (grouped, E.bootstrap_means(df, 60, "s", 27), E.bootstrap_means(df, 60, "s"))]
    assert len(means[0]) == 180 and means[0] == means[2] and means[0].keys() == means[1].keys() and all(means[1][k] == pytest.approx(means[0][k]) for k in means[0])


def test_gate_fails_on_judge_errors(spark):
    runs = spark.createDataFrame([("ndcg@10", 0.5)], "metric string, mean double")
    verdict = lambda n: {r.metric: r.verdict for r in E.gate(runs, runs, n).collect()}["judge_errors"]
    assert verdict(0) == "PASS" and verdict(2) == "FAIL"


def test_running_best_against_sorting():
    rng = np.random.default_rng(3)
    for k in (1, 3, 7):
        running, every = R._Running(5, k), [[] for _ in range(5)]
        for batch in range(6):
            n = int(rng.integers(1, 9))
            scores, ids = np.round(rng.random((5, n)), 1), [f"c{batch}-{rng.integers(100)}-{j}" for j in range(n)]
            possible = rng.random((5, n)) < 0.7
            running.add(scores, ids, possible)
            for q in range(5):
                every[q] += [(-scores[q, j], ids[j]) for j in range(n) if possible[q, j]]
        for q in range(5):
            assert [h[:2] for h in running.best[q]] == sorted(every[q])[:k]


def test_repeated_ids_are_settled(spark):
    rows = [("a", 1), ("b", 2), ("b", 2), (None, 3), (None, 3), ("c", 4)]
    df = spark.createDataFrame(rows, "k string, v int")
    once = lambda same: same.dropDuplicates(["k"])
    assert sorted(map(tuple, settled(df, "k", once).collect()), key=str) == sorted({r for r in rows}, key=str)
    assert settled(df.filter("k = 'a'"), "k", once).collect() == [("a", 1)]
    assert settled(df.limit(0), "k", once).collect() == []


def test_attacks_through_a_generator(spark):
    corpus = spark.createDataFrame([("c1", "Revenue rose. Costs fell."), ("c2", "Nothing.")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "Did revenue rise?")], "query_id string, query string")
    found = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 2)], "query_id string, chunk_id string, rank int")
    parrot = lambda h, q, c: h.join(c, "chunk_id").select("query_id", F.col("text").alias("answer"))
    rows = security.attack_runs(found, asked, corpus, parrot).collect()
    assert len(rows) == 14 and all(r.n == r.n_delivered == r.n_succeeded == 1 for r in rows)
    calm = security.attack_runs(found, asked, corpus, lambda h, q, c: h.select("query_id", F.lit("Revenue rose.").alias("answer"))).collect()
    assert all(r.n_succeeded == 0 and r.n_delivered == 1 for r in calm)
    assert security.attack_runs(found, asked, corpus, answering.extractive).count() == 14


def test_leaks_are_seen_without_the_rules(spark):
    shown = spark.createDataFrame([("x", "a SECRET-0123456789abcdef b"), ("x", "plain"), ("y", "plain")], "principal string, text string")
    planted = spark.createDataFrame([("x", "SECRET-0123456789abcdef"), ("y", "SECRET-0123456789abcdef")], "principal string, secret string")
    assert {r.principal: (r.n_shown, r.n_planted_seen) for r in security.leaks(shown, planted).collect()} == {"x": (2, 1), "y": (1, 0)}


def test_described_chunks(spark):
    text = "Front. " + "word " * 30 + "Table | 1"
    df = spark.createDataFrame(
        [("d", text, {"company": "C", "fiscal_year": "2020"}, [("One", 0, 7, 100), ("Two", 1, 100, len(text))], [(len(text) - 9, len(text))]), ("e", text, None, None, None)],
        "doc_id string, text string, metadata map<string,string>, sections array<struct<section_name:string,section_order:int,char_start:int,char_end:int>>, doc_tables array<struct<char_start:int,char_end:int>>",
    )
    made = chunking.described(chunking.fixed(df, size=10, overlap=0), df, "fixed").orderBy("doc_id", "chunk_index").collect()
    own = [r for r in made if r.doc_id == "d"]
    assert {r.section for r in own} == {"One", "Two"} and own[-1].contains_table and not own[0].contains_table and own[0].fiscal_year == 2020
    assert all(r.section is None and r.company is None and not r.contains_table and r.chunker == "fixed" for r in made if r.doc_id == "e")


def test_parsed_filings_and_failures(spark):
    rows = [("<html><body><p>Item 1. Business</p><p>We sell paper.</p></body></html>", "C", 1, "10-K", 2020, "a-1"), (None, "C", 1, "10-K", 2020, "a-2"), ("<p>x</p>", "C", None, None, None, None)]
    made, failures = parsing.parse_filings(spark.createDataFrame(rows, "html string, company string, cik long, form_type string, fiscal_year int, accession string"))
    (doc,) = made.collect()
    assert "We sell paper." in doc.text and doc.metadata["accession"] == "a-1" and len(doc.content_hash) == 64
    assert {(r.accession, r.problem) for r in failures.collect()} == {("a-2", "lacks html"), (None, "lacks cik, accession, form_type")}


def test_bodies_that_are_no_text(spark):
    df = spark.createDataFrame([("u", bytearray(b"caf\xc3\xa9 \xff end")), ("v", None)], "url string, body binary")
    assert {r.url: r.text for r in filings_index.primary_documents(df).collect()} == {"u": "caf\u00e9 \ufffd end", "v": None}


def test_factories(spark, tmp_path):
    assert judging.build_judge("lexical") is judging.lexical_judge and plugins.build_generator() is plugins.generate
    assert judging.build_judge("custom", "gleanery.operators.judging:null_judge") is judging.null_judge
    for make in (judging.build_judge, plugins.build_generator):
        with pytest.raises(ValueError, match="known"):
            make("other")
    (tmp_path / "r.md").write_text("Be strict.\nAlways.")
    text, version = judging.load_rubric(spark, str(tmp_path / "r.md"))
    assert text == "Be strict.\nAlways." and version == judging.rubric_version(text)


def test_markdown(spark):
    df = spark.createDataFrame([("b", 2), ("a|c", None)], "name string, n int")
    lines = [r.line for r in reports.markdown(df, F.col("name")).orderBy("line_no").collect()]
    assert lines == ["| name | n |", "|---|---|", "| a\\|c | - |", "| b | 2 |"]


def test_paired_ladder(spark):
    rows = [(s, f"rung {s}", f"q{k}", "m", float(s == 1) + 0.01 * k) for s in range(3) for k in range(30)]
    df = spark.createDataFrame(rows, "step int, label string, question_id string, metric string, value double")
    got = {r.step: r for r in reports.ladder_paired(df, 200).collect()}
    assert got[0].verdict is None and (got[1].verdict, got[2].verdict) == ("better", "worse") and got[1].change == pytest.approx(1.0)


def test_runs_over_different_data_sets_are_not_compared(spark):
    a, b = (spark.createDataFrame([(d,)], "dataset string") for d in "ab")
    reports.require_same_dataset(a, a)
    with pytest.raises(ValueError):
        reports.require_same_dataset(a, b)
