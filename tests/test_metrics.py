"""Numbers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from gleanery.operators import evaluation as E
from gleanery.operators import judging, refusal


def metrics(spark, hits, qrels, question_ids, ks=(1, 3, 10)):
    h = spark.createDataFrame([(q, c, r) for q, c, r in hits], "query_id string, chunk_id string, rank int")
    g = spark.createDataFrame(qrels, "question_id string, chunk_id string, relevance int")
    q = spark.createDataFrame([(i,) for i in question_ids], "question_id string")
    return {(r.question_id, r.k): r for r in E.retrieval_metrics(h, g, q, ks).collect()}


def test_retrieval_metrics(spark):
    hits = [("a", "x", 1), ("a", "g2", 2), ("a", "g1", 3), ("c", "g", 1)]
    qrels = [("a", "g2", 2), ("a", "g1", 1), ("a", "g0", 1), ("b", "g", 2)]
    got = metrics(spark, hits, qrels, ["a", "b", "c"])
    r = got["a", 3]
    assert (r.recall, r.answer_recall, r.precision, r.hit_rate, r.mrr) == (pytest.approx(2 / 3), 1.0, pytest.approx(2 / 3), 1.0, 0.5)
    dcg = 3 / math.log2(3) + 1 / math.log2(4)
    ideal = 3 + 1 / math.log2(3) + 1 / math.log2(4)
    assert r.ndcg == pytest.approx(dcg / ideal)
    assert (got["a", 1].recall, got["a", 1].mrr, got["a", 1].ndcg) == (0.0, 0.0, 0.0)
    r = got["b", 10]  # gold but no hits
    assert (r.recall, r.precision, r.hit_rate, r.mrr, r.ndcg) == (0.0, 0.0, 0.0, 0.0, 0.0)
    r = got["c", 10]  # no gold: undefined, never 0
    assert (r.recall, r.answer_recall, r.precision, r.hit_rate, r.mrr, r.ndcg) == (None,) * 6


def test_k_below_one(spark):
    with pytest.raises(ValueError):
        metrics(spark, [], [], [], ks=(0,))


def spans(spark, gold, chunks):
    g = spark.createDataFrame(gold, "question_id string, doc_id string, char_start int, char_end int, weight double")
    c = spark.createDataFrame(chunks, "doc_id string, chunk_id string, char_start int, char_end int")
    return {(r.question_id, r.chunk_id): r.relevance for r in E.resolve_spans(g, c).collect()}


def test_spans(spark):
    chunks = [("d", "all", 0, 100), ("d", "most", 5, 95), ("d", "half", 50, 100), ("d", "bit", 0, 20), ("e", "else", 0, 100)]
    assert spans(spark, [("q", "d", 0, 100, 1.0)], chunks) == {("q", "all"): 2, ("q", "most"): 2, ("q", "half"): 1}
    assert spans(spark, [("q", "d", 0, 100, 0.5)], chunks) == {("q", "all"): 1, ("q", "most"): 1, ("q", "half"): 1}
    assert spans(spark, [("q", "d", 60, 60, 1.0)], chunks) == {("q", "all"): 2, ("q", "most"): 2, ("q", "half"): 2}
    with pytest.raises(ValueError):
        E.resolve_spans(None, None, full=0.2, partial=0.3)


def values(spark, rows):
    return spark.createDataFrame(rows, "metric string, question_id string, value double")


def test_aggregates_count_the_undefined(spark):
    rows = [("m", str(k), v) for k, v in enumerate([1.0, 1.0, 1.0, None, None])]
    slices = spark.createDataFrame([(str(k), "a" if k < 4 else "b") for k in range(5)], "question_id string, question_type string")
    got = {r.question_type: (r["mean"], r.n, r.n_undefined) for r in E.aggregates(values(spark, rows), slices).collect()}
    assert got == {"(all)": (1.0, 3, 2), "a": (1.0, 3, 1), "b": (None, 0, 1)}


def test_bootstrap(spark):
    rows = [("m", str(k), float(k % 2)) for k in range(40)] + [("one", "0", 0.25), ("none", "0", None)]
    got = {r.metric: r for r in E.bootstrap_interval(values(spark, rows), resamples=300).collect()}
    assert got["m"]["mean"] == 0.5 and 0.3 < got["m"].ci_low < 0.45 < 0.55 < got["m"].ci_high < 0.7
    assert (got["one"].ci_low, got["one"].ci_high) == (0.25, 0.25)
    assert got["none"]["mean"] is None and got["none"].ci_low is None


def test_pairs(spark):
    a = values(spark, [("m", "1", 0.5), ("m", "2", None), ("m", "3", 1.0), ("m", "5", 0.0)])
    b = values(spark, [("m", "1", 1.0), ("m", "2", 0.5), ("m", "4", 1.0), ("m", "5", 0.0)])
    (r,) = E.paired_bootstrap(a, b, resamples=50).collect()
    assert (r.delta, r.n_pairs, r.n_dropped, r.significant) == (0.25, 2, 3, False)
    (p,) = E.paired_power(a, b).collect()
    sd = math.sqrt(0.125)
    assert p.sd == pytest.approx(sd) and p.detectable == pytest.approx(1.96 * sd / math.sqrt(2)) and p.required_n == int((1.96 * sd / 0.02) ** 2) + 1


def test_equal_differences_need_two(spark):
    a, b = values(spark, [("m", "1", 0.0), ("m", "2", 0.5)]), values(spark, [("m", "1", 0.25), ("m", "2", 0.75)])
    assert E.paired_power(a, b).first().required_n == 2


@pytest.mark.parametrize(("weighting", "want"), [("unweighted", 0.25), ("linear", 0.25), ("quadratic", 0.25)])
def test_kappa_two_categories(spark, weighting, want):
    pairs = [(1, 1)] * 4 + [(0, 0)] * 2 + [(1, 0)] * 2 + [(0, 1)] * 2
    raw, p = 0.6, (6 / 10) * (6 / 10) + (4 / 10) * (4 / 10)
    labels = spark.createDataFrame([("m", h, j) for h, j in pairs], "metric string, human int, judge int")
    r = E.kappa(labels, (0, 1), weighting).first()
    assert r.raw_agreement == raw and r.kappa == pytest.approx((raw - p) / (1 - p))


def test_kappa_weights_and_undefined(spark):
    labels = spark.createDataFrame([("m", 0, 0), ("m", 1, 1), ("m", 2, 2), ("m", 0, 2)], "metric string, human int, judge int")
    far = {w: E.kappa(labels, (0, 1, 2), w).first().kappa for w in ("unweighted", "linear", "quadratic")}
    assert far["quadratic"] < far["linear"] < far["unweighted"]
    same = spark.createDataFrame([("m", 1, 1)] * 3, "metric string, human int, judge int")
    r = E.kappa(same, (0, 1, 2)).first()
    assert r.kappa is None and r.raw_agreement == 1.0
    with pytest.raises(Exception, match="outside the categories"):
        E.kappa(spark.createDataFrame([("m", 7, 1)], "metric string, human int, judge int"), (0, 1, 2)).collect()


def test_gate(spark):
    run = lambda **m: spark.createDataFrame([(k.replace("_at_", "@"), v) for k, v in m.items()], "metric string, mean double")
    got = {r.metric: r.verdict for r in E.gate(run(ndcg_at_10=0.8, recall_at_10=0.9, latency_ms=100.0, groundedness=0.5), run(ndcg_at_10=0.77, recall_at_10=0.89, latency_ms=700.0, groundedness=None, citation_fabrication_rate=0.0)).collect()}
    assert got["ndcg@10"] == "FAIL" and got["recall@10"] == "PASS" and got["latency_ms"] == "FAIL" and got["groundedness"] == "SKIP" and got["citation_fabrication_rate"] == "PASS" and got["false_refusal"] == "SKIP"


def test_confidence_and_curve(spark):
    hits = spark.createDataFrame([("a", "x", 1, 0.9), ("a", "y", 2, 0.5), ("b", "z", 1, 0.4)], "query_id string, chunk_id string, rank int, score double")
    got = {r.query_id: (r.top_score, r.mean_score, r.margin) for r in refusal.confidence(hits).collect()}
    assert got == {"a": (0.9, pytest.approx(0.7), pytest.approx(0.4)), "b": (0.4, 0.4, 0.4)}
    seen = spark.createDataFrame([(0.1, False), (0.2, False), (0.3, True), (0.4, True)], "confidence double, answerable boolean")
    points = refusal.curve(seen)
    rows = {round(r.threshold, 6): (r.correct_refusals, r.false_refusals, r.youden_j) for r in points.collect()}
    assert rows[0.25] == (2, 0, 1.0) and rows[0.35] == (2, 1, 0.5) and rows[0.097] == (0, 0, 0.0) and len(rows) == 5
    assert refusal.operating_point(points).first().threshold == 0.25


def test_curve_of_one_kind(spark):
    seen = spark.createDataFrame([(0.5, True), (0.5, True)], "confidence double, answerable boolean")
    rows = refusal.curve(seen).collect()
    assert {r.correct_rate for r in rows} == {None} and len(rows) == 2 and refusal.operating_point(refusal.curve(seen)).collect() == []


def test_dataset_problems(spark):
    schema = "question_id string, question string, question_type string, gold_answer string, gold_chunks array<struct<chunk_id:string,relevance:int>>, gold_spans array<struct<doc_id:string,char_start:int,char_end:int,weight:double>>"
    rows = [
        ("ok", "q", "single_hop", "a", [("c", 2)], None),
        ("span", "q", "single_hop", "a", None, [("d", 0, 9, 1.0)]),
        ("none", "q", "single_hop", None, [], []),
        ("twice", "q", "single_hop", "a", [("c", 2), ("c", 1)], None),
        ("weak", "q", "single_hop", "a", [("c", 1)], None),
        ("un", "q", "unanswerable", "a", [("c", 2)], None),
        ("clear", "q", "ambiguous", None, None, None),
        ("said", " ", "ambiguous", "a", None, None),
    ]
    got = {r.question_id: r.problems for r in E.problems(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"none": ["no evidence"], "twice": ["repeated gold chunk"], "weak": ["no sufficient chunk"], "un": ["unanswerable with evidence", "unanswerable with answer"], "said": ["no question", "ambiguous with answer"]}


def test_judged_context_holds_every_passage(spark):
    rows = [("a", ["x" * 3000, "y" * 5000, "profit rose to five"]), ("b", [f"passage {k}" for k in range(22)]), ("c", []), ("d", None)]
    df = spark.createDataFrame(rows, "question_id string, texts array<string>")
    got = {r.question_id: r.c for r in df.select("question_id", judging.shown_context(F.col("texts")).alias("c")).collect()}
    assert got["a"] == "[1] " + "x" * 3000 + "\n\n[2] " + "y" * 4000 + " (cut)\n\n[3] profit rose to five"
    assert "[20] passage 19" in got["b"] and "passage 20" not in got["b"] and got["b"].endswith("(2 passages omitted)")
    assert got["c"] == "(nothing retrieved)"
