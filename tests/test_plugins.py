import pytest
from pyspark.sql import functions as F

from gleanery.operators import context, plugins, reports, retrieval
from gleanery.sources import fixture

TURNS = "query_id string, query string, history array<struct<question:string,answer:string>>"


def test_fixture_pipeline(spark):
    rows = {r.query_id: r for r in fixture.answer(spark, ["What was the revenue of Alder Mills in fiscal 2023?", "quantum teleportation"]).collect()}
    assert not rows["0"].refused and "$61.5 million" in rows["0"].answer and rows["0"].groundedness == 1.0 and rows["0"].retrieved[0] == "mill-2023-1"
    assert rows["1"].refused and rows["1"].answer == "" and rows["1"].retrieved is None


def test_rewriter_falls_back(spark):
    q = spark.createDataFrame([("a", "and then?", [("What of Alder Mills in 2021?", "x")]), ("b", "and then?", [("What of Alder Mills in 2021?", "x")])], TURNS)
    model = lambda df: df.withColumns({"rewritten": F.lit("by the model"), "error": F.when(F.col("query_id") == "b", "down")})
    got = {r.query_id: r["query"] for r in plugins.rewrite(q, model).collect()}
    assert got["a"] == "by the model" and got["b"].endswith("fiscal 2021: and then?") and got["b"] == {r.query_id: r["query"] for r in plugins.rewrite(q).collect()}["b"]


def test_reranker(spark):
    corpus = fixture.corpus(spark)
    asked = spark.createDataFrame([("q", "paper revenue")], "query_id string, query string")
    hits = retrieval.bm25_search(corpus, asked, 5)
    model = lambda df: df.withColumns({"score": F.length("text").cast("double"), "error": F.when(F.col("chunk_id") == "mill-2022-1", "down")})
    got = [r.chunk_id for r in plugins.rerank(hits, asked, corpus, 2, model).orderBy("rank").collect()]
    assert "mill-2022-1" not in got and len(got) == 2
    assert len(plugins.rerank(hits, asked, corpus, 2).collect()) == 2


def test_generator(spark):
    corpus = fixture.corpus(spark)
    asked = spark.createDataFrame([("q", "paper revenue of Alder Mills"), ("none", "zzz")], "query_id string, query string")
    shown = context.assemble(retrieval.bm25_search(corpus, asked, 2), corpus)
    plain = {r.query_id: r for r in plugins.generate(shown, asked, corpus).collect()}
    assert plain["q"].citations[0].chunk_ids == [shown.first().kept[0].chunk_id] and plain["none"].refused
    claims = F.array(F.struct(F.lit("c").alias("text"), F.array(F.lit(1), F.lit(9)).alias("passages")))
    good = lambda df: df.withColumns({"answer": F.col("prompt"), "refused": F.lit(False), "claims": claims, "error": F.lit(None).cast("string")})
    r = plugins.generate(shown, asked, corpus, good).first()
    assert r.answer.startswith('<passage index="0"') and r.citations[0].chunk_ids == [shown.first().kept[0].chunk_id]
    bad = lambda df: good(df).withColumn("error", F.lit("down"))
    r = plugins.generate(shown, asked, corpus, bad).first()
    assert (r.answer, r.refused, r.citations, r.error) == ("", False, None, "down")


def test_load():
    assert plugins.load("gleanery.operators.context:MAX_TOKENS") == 4000
    assert plugins.load("gleanery.operators.chunking:build_chunker", name="fixed") is not None
    with pytest.raises(ValueError):
        plugins.load("gleanery")


def test_bad_runs_are_named(spark, tmp_path):
    for k, v in enumerate((0.5, 0.75)):
        spark.createDataFrame([("q", "m", v)], "question_id string, metric string, value double").write.parquet(str(tmp_path / f"run{k}"))
    (tmp_path / "broken").mkdir()
    runs, bad = reports.load_runs(spark, [str(tmp_path / n) for n in ("run0", "broken", "run1")])
    assert bad == [str(tmp_path / "broken")]
    assert [(r["mean"], r.change) for r in reports.ladder_of(runs).orderBy("step").collect()] == [(0.5, None), (0.75, 0.25)]
