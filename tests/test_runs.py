"""Pipelines, judges, reports, the service and the command line."""

import pytest
from pyspark.sql import functions as F

from gleanery import cli
from gleanery.operators import judging, pipelines, reports, serving
from gleanery.plans import registry
from gleanery.sources import filings_index as S


def test_rungs_change_one_knob():
    for ladder in (pipelines.RETRIEVAL_LADDER, pipelines.GENERATION_LADDER):
        for a, b in zip(ladder, ladder[1:]):
            changed = pipelines.changed_knobs(a, b)
            assert len(changed - {"retrieve_depth", "refusal_threshold"}) == 1, (a.label, b.label, changed)
    assert all(pipelines.changed_knobs(pipelines.CHUNKING_SWEEP[0], c) == {"chunker"} for c in pipelines.CHUNKING_SWEEP[1:])


def test_configurations_are_checked():
    for bad in ({"dense": False}, {"top_k": 0}, {"rerank": True, "retrieve_depth": 2}):
        with pytest.raises(ValueError):
            pipelines.Config("x", **bad)


def test_identity(spark, sf_dir):
    q = registry.questions(spark, sf_dir)
    a = pipelines.run_id(pipelines.BASE, q)
    assert a == pipelines.run_id(pipelines.replace(pipelines.BASE, label="other"), q.repartition(3))
    assert a != pipelines.run_id(pipelines.replace(pipelines.BASE, top_k=6), q) and a != pipelines.run_id(pipelines.BASE, q.limit(2))


def test_metadata_filter_comes_before_the_cut(spark):
    rows = [(f"a{k:02}", "apple pie", [1.0] + [0.0] * 511, "Other", 2020) for k in range(60)] + [("b1", "pears", [0.0] * 511 + [1.0], "Acme", 2021)]
    index = spark.createDataFrame(rows, "chunk_id string, text string, vector array<double>, company string, fiscal_year int")
    asked = spark.createDataFrame([("q", "apple at acme")], "query_id string, query string")
    for config in (pipelines.replace(pipelines.BASE, metadata_filter=True), pipelines.RETRIEVAL_LADDER[-1]):
        assert {r.chunk_id for r in pipelines.retrieve(config, index, asked).collect()} == {"b1"}, config.label


def test_a_sweep_searches_once(spark, sf_dir, monkeypatch):
    """Rungs that share an index, queries and filters share their rankings, to the depth that the deepest one needs."""
    made = []
    for name in ("dense", "bm25_search"):
        search = getattr(pipelines.retrieval, name)
        monkeypatch.setattr(pipelines.retrieval, name, lambda index, asked, k, filters=None, name=name, search=search: made.append((name, k, filters is not None)) or search(index, asked, k, filters=filters))
    documents, questions = registry.filings(spark, sf_dir), registry.questions(spark, sf_dir)
    runs = list(pipelines.sweep(pipelines.RETRIEVAL_LADDER[:4], documents, questions))
    assert sorted(made) == [("bm25_search", 50, False), ("dense", 5, False), ("dense", 50, False)]
    alone = pipelines.evaluate(pipelines.RETRIEVAL_LADDER[1], pipelines.Indexes(documents), questions)
    key = lambda run: sorted(map(tuple, run.scores.collect()), key=str)
    assert key(runs[1]) == key(alone) and made[-1] == ("dense", 5, False)
    assert alone.warnings == pipelines.evaluate(pipelines.RETRIEVAL_LADDER[1], pipelines.Indexes(documents), questions).warnings


CASES = "question_id string, question string, gold_answer string, gold_chunks array<struct<chunk_id:string,relevance:int>>, gold_spans array<struct<doc_id:string,char_start:int,char_end:int,weight:double>>"


def judged(spark, judge):
    q = spark.createDataFrame([("a", "q", "profit rose to five", [("c", 2)], None), ("b", "q", None, None, None)], CASES)
    r = spark.createDataFrame([("a", "Profit rose to five. Moons fell.", False, ["profit rose to five"]), ("b", "", True, [])], "question_id string, answer string, refused boolean, texts array<string>")
    return judge(judging.cases(q, r))


def test_judged_metrics(spark):
    rows = {(r.question_id, r.metric): r.value for r in judging.judged_scores(judged(spark, judging.lexical_judge)).collect()}
    assert rows == {("a", "context_sufficiency"): 1.0, ("a", "answer_correctness"): 1.0, ("a", "groundedness"): 0.5}
    assert judging.judged_scores(judged(spark, judging.null_judge)).collect() == []


def test_scales(spark):
    df = spark.createDataFrame([("answer_correctness", 1), ("context_sufficiency", 1), ("claim_support", None)], "metric string, score int")
    assert [r.v for r in df.select(judging.normalise(F.col("metric"), F.col("score")).alias("v")).collect()] == [0.5, 1.0, None]
    with pytest.raises(Exception, match="outside its scale"):
        spark.createDataFrame([("context_sufficiency", 2)], "metric string, score int").select(judging.normalise(F.col("metric"), F.col("score"))).collect()
    assert judging.rubric_version("a") != judging.rubric_version("b") and len(judging.rubric_version("a")) == 12


def test_failed_judge_falls_back(spark):
    answers = spark.createDataFrame([("t", "Profit rose to five.", ["c"])], "trace_id string, answer string, cited array<string>")
    corpus = spark.createDataFrame([("c", "profit rose to five")], "chunk_id string, text string")
    r = judging.verify(answers, "trace_id", corpus, judging.null_judge).first()
    assert r.supported and r.score == 1.0 and r.reason.startswith("judge failed (no judge configured)")
    assert judging.verify(answers, "trace_id", corpus, judging.lexical_judge).first().score == 1.0


def test_agreement(spark):
    both = lambda k, h, j: (str(k), {"context_sufficiency": h}, {"context_sufficiency": j, "claim_support": 1})
    samples = spark.createDataFrame([both(0, 1, 1), both(1, 0, 0), both(2, 1, 1), both(3, 0, 0)], "question_id string, human_scores map<string,int>, judge_scores map<string,int>")
    (r,) = judging.agreement(samples).collect()
    assert (r.metric, r.kappa, r.n, r.band, r.passes) == ("context_sufficiency", 1.0, 4, "almost perfect", True)


def test_comparison_verdicts(spark):
    rows = [("ndcg@10", 0.1, 0.05, 0.2, 9, True), ("false_refusal", 0.1, 0.05, 0.2, 9, True), ("mrr@10", 0.1, -0.1, 0.2, 9, False)]
    paired = spark.createDataFrame(rows, "metric string, delta double, ci_low double, ci_high double, n_pairs long, significant boolean")
    assert {r.metric: r.verdict for r in reports.comparison(paired).collect()} == {"ndcg@10": "better", "false_refusal": "worse", "mrr@10": "inconclusive"}


def test_service(spark):
    turns = "array<struct<question:string,answer:string>>"
    requests = spark.createDataFrame([("1", "a", None, ["x", "y"]), ("2", "a", None, ["y", "x"]), ("3", "b", None, None), ("4", "bad", None, None)], f"request_id string, question string, history {turns}, roles array<string>")
    known = requests.filter("question = 'b'").select(serving.cache_key(F.col("question"), F.col("history"), F.col("roles")).alias("key"), F.lit("kept").alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(90.0).alias("created_at"))
    answer = lambda df: df.select("key", F.upper("question").alias("answer"), F.when(F.col("question") == "bad", "failed").alias("error"))
    responses, fresh = serving.serve(requests, known, answer, now=100.0)
    assert {r.request_id: (r.cache_hit, r.answer) for r in responses.collect()} == {"1": (False, "A"), "2": (False, "A"), "3": (True, "kept"), "4": (False, "BAD")}
    assert [r.answer for r in fresh.collect()] == ["A"]
    late, _ = serving.serve(requests, known, answer, now=90.0 + serving.CACHE_TTL + 1)
    assert not late.filter("cache_hit").collect()


def test_requests_are_checked(spark):
    rows = [("ok", "q", None, 5, None), ("long", "q" * 2001, None, None, None), ("k", "q", None, 51, None), ("none", None, None, 1, None)]
    df = spark.createDataFrame(rows, "request_id string, question string, history array<string>, top_k int, roles array<string>")
    assert {r.request_id: r.problems for r in serving.invalid_requests(df).collect()} == {"long": ["question length"], "k": ["top_k"], "none": ["question length"]}


def test_stages_degrade(spark):
    df = spark.createDataFrame([("a", True), (None, True), ("c", False)], "v string, healthy boolean")
    value, degraded = serving.degrade(F.col("v"), F.lit("f"), F.col("healthy"))
    assert [tuple(r) for r in df.select(value.alias("v"), degraded.alias("d")).collect()] == [("a", False), ("f", True), ("f", True)]
    value, _ = serving.degrade(F.col("v"), F.lit(None).cast("string"), F.col("healthy"), required=True)
    with pytest.raises(Exception, match="required stage"):
        df.select(value).collect()


def test_read_through(spark):
    wanted = spark.createDataFrame([("u1",), ("u2",)], "url string")
    store = spark.createDataFrame([("u1", b"one")], "url string, body binary").select(S.url_key(F.col("url")).alias("key"), "body")
    got, fresh = S.read_through(wanted, store, spark.createDataFrame([("u2", b"two")], "url string, body binary"))
    assert {r.url: bytes(r.body) for r in got.collect()} == {"u1": b"one", "u2": b"two"} and [bytes(r.body) for r in fresh.collect()] == [b"two"]
    named = spark.createDataFrame([("judge:1",), ("embed:1",)], "key string")
    assert [r.key for r in S.purge(named, "judge").collect()] == ["embed:1"]


def test_rate_limiter():
    now, slept = [0.0], []
    limiter = S.RateLimiter(10, clock=lambda: now[0], sleep=slept.append)
    assert [round(limiter.acquire(), 3) for _ in range(3)] == [0.0, 0.1, 0.2] and len(slept) == 2
    now[0] = 9.0
    assert limiter.acquire() == 0.0


def test_command_line(spark, sf_dir, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    call = lambda *argv: cli.main(list(argv), spark)
    assert call("ingest", "--pages", f"{sf_dir}/raw_filings.parquet", "--out", at("documents")) == 0
    n = spark.read.parquet(at("documents")).count()
    assert call("ingest", "--pages", f"{sf_dir}/raw_filings.parquet", "--out", at("documents")) == 0
    assert n == spark.read.parquet(at("documents")).count() > 0
    doc_id = spark.read.parquet(at("documents")).first().doc_id
    assert call("index", "--documents", at("documents"), "--out", at("index")) == 0
    assert call("query", "--index", at("index"), "--question", "revenue") == 0
    assert call("inspect", "--documents", at("documents"), "--doc-id", doc_id) == 0
    assert doc_id in capsys.readouterr().out
    questions = f"{sf_dir}/questions.parquet"
    assert call("stats", "--questions", questions) == 0 and call("validate", "--questions", questions) in (0, 1)
    assert call("run", "--documents", at("documents"), "--questions", questions, "--out", at("run"), "--ladder", "retrieval", "--step", "2") == 0
    assert call("baseline", "--run", at("run"), "--out", at("base")) == 0
    assert call("compare", "--baseline", at("base"), "--candidate", at("run")) == 0
    assert call("gate", "--baseline", at("base"), "--candidate", at("run")) == 0
    judged = spark.createDataFrame([("fil-0000000", "answer_correctness", 2, None)], "question_id string, metric string, score int, error string")
    judged.write.parquet(at("judged"))
    assert call("calibrate-export", "--judged", at("judged"), "--questions", questions, "--out", at("labels"), "--n", "3") == 0
