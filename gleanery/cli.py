"""Command line: corpora and evaluation runs over Parquet and JSON files.

    python -m gleanery.cli ingest --pages PAGES --out DOCUMENTS [--force]
    python -m gleanery.cli index --documents DOCUMENTS --out INDEX [--chunker fixed]
    python -m gleanery.cli query --index INDEX --question TEXT [--k 5]
    python -m gleanery.cli inspect --documents DOCUMENTS --doc-id ID
    python -m gleanery.cli validate|stats --questions QUESTIONS
    python -m gleanery.cli run --documents DOCUMENTS --questions QUESTIONS --out RUN [--ladder generation --step 5]
    python -m gleanery.cli compare|gate --baseline RUN --candidate RUN
    python -m gleanery.cli security|refusal --index INDEX --questions QUESTIONS
    python -m gleanery.cli loadtest --index INDEX --questions QUESTIONS [--n 30]
    python -m gleanery.cli baseline --run RUN --out BASELINE
    python -m gleanery.cli calibrate-export --judged JUDGED --questions QUESTIONS --n 30 --out FILE
    python -m gleanery.cli calibrate-report --labels FILE
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import vectors as V
from gleanery.operators import answering, chunking, evaluation, judging, parsing, pipelines, refusal, reports, retrieval, security, serving
from gleanery.session import local_session, tune
from gleanery.sources import filings_index

EMBEDDER = {"name": "hashing", "dim": 512, "seed": 0}


def ingest(spark: SparkSession, a) -> int:
    pages = spark.read.parquet(a.pages).withColumn("doc_id", T.stable_id(F.col("cik").cast("string"), F.col("accession"), F.col("form_type")))
    stored = filings_index.baseline(spark, a.out)
    if stored is not None and not a.force:
        pages = pages.join(stored.select("doc_id"), "doc_id", "left_anti")
    made, failures = parsing.parse_filings(pages.drop("doc_id"))
    made.write.mode("append" if stored is not None and not a.force else "overwrite").parquet(a.out)
    bad = failures.collect() if not failures.isEmpty() else []
    for r in bad:
        print("failed:", r.accession, r.problem)
    return int(bool(bad))


def index(spark: SparkSession, a) -> int:
    config = pipelines.replace(pipelines.BASE, chunker=a.chunker)
    filings_index.write_index(pipelines.Indexes(spark.read.parquet(a.documents)).get(config), a.out, EMBEDDER)
    return 0


def query(spark: SparkSession, a) -> int:
    stored = filings_index.read_index(spark, a.index, EMBEDDER)
    asked = spark.createDataFrame([("q", a.question)], "query_id string, query string").withColumn("vector", V.hashing_embedder(EMBEDDER["dim"])(F.col("query")))
    hits = retrieval.dense(stored.select("chunk_id", "vector"), asked, a.k).join(stored.select("chunk_id", "text"), "chunk_id")
    hits.orderBy("rank").select("rank", F.round("score", 4).alias("score"), "chunk_id", F.left("text", F.lit(100)).alias("text")).show(a.k, truncate=False)
    return 0


def inspect(spark: SparkSession, a) -> int:
    found = spark.read.parquet(a.documents).filter(F.col("doc_id") == a.doc_id)
    found.select("doc_id", F.length("text").alias("n_chars"), F.size("doc_tables").alias("n_tables"), F.transform("sections", lambda s: s["section_name"]).alias("sections")).show(truncate=False)
    return 0


def validate(spark: SparkSession, a) -> int:
    bad = evaluation.problems(spark.read.parquet(a.questions))
    bad.show(50, truncate=False)
    return int(not bad.isEmpty())


def stats(spark: SparkSession, a) -> int:
    reports.composition(spark.read.parquet(a.questions).groupBy("question_type").agg(F.count("*").alias("n"))).show(truncate=False)
    return 0


def run(spark: SparkSession, a) -> int:
    ladder = {"chunking": pipelines.CHUNKING_SWEEP, "retrieval": pipelines.RETRIEVAL_LADDER, "generation": pipelines.GENERATION_LADDER}[a.ladder]
    questions = spark.read.parquet(a.questions)
    made = pipelines.evaluate(ladder[a.step], pipelines.Indexes(spark.read.parquet(a.documents)), questions)
    reports.run_rows(made, ladder[a.step], pipelines.dataset_digest(questions)).write.mode("overwrite").parquet(a.out)
    reports.run_lines(made.aggregates).select("line").show(100, truncate=False)
    for w in made.warnings:
        print("warning:", w)
    return 0


def _means(spark: SparkSession, path: str):
    return spark.read.parquet(path).groupBy("metric").agg(F.avg("value").alias("mean"))


def compare(spark: SparkSession, a) -> int:
    baseline, candidate = reports.read_run(spark, a.baseline), reports.read_run(spark, a.candidate)
    reports.require_same_dataset(baseline, candidate)
    paired = evaluation.paired_bootstrap(baseline, candidate)
    reports.comparison(paired).orderBy("metric").show(100, truncate=False)
    return 0


def gate(spark: SparkSession, a) -> int:
    verdicts = evaluation.gate(_means(spark, a.baseline), _means(spark, a.candidate))
    verdicts.orderBy("metric").show(truncate=False)
    return int(not verdicts.filter("verdict = 'FAIL'").isEmpty())


def loadtest(spark: SparkSession, a) -> int:
    stored = filings_index.read_index(spark, a.index, EMBEDDER).select("chunk_id", "vector").cache()
    asked = [r.question for r in spark.read.parquet(a.questions).filter("question is not null").select("question").orderBy("question_id").limit(8).collect()]

    def answer(question: str) -> list:
        one = spark.createDataFrame([("q", question)], "query_id string, query string").withColumn("vector", V.hashing_embedder(EMBEDDER["dim"])(F.col("query")))
        return retrieval.dense(stored, one, a.k).collect()

    for level in serving.ramp(answer, asked, levels=(1, 2, 4, 8), requests=a.n):
        print(" ".join(f"{k}={v:.2f}" if isinstance(v, float) else f"{k}={v}" for k, v in level.items()))
    return 0


def security_report(spark: SparkSession, a) -> int:
    """Attacks through the extractive generator, best passage of every question; fails when one succeeds."""
    stored = filings_index.read_index(spark, a.index, EMBEDDER)
    asked = spark.read.parquet(a.questions).filter("question is not null").select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))
    tried = security.attack_runs(retrieval.bm25_search(stored, asked, 1), asked, stored, answering.extractive)
    tried.orderBy("attempt_id", "sanitised").show(20, truncate=False)
    return int(not tried.filter("n_succeeded > 0").isEmpty())


def refusal_report(spark: SparkSession, a) -> int:
    """The refusal curve of each signal and its best threshold."""
    stored = filings_index.read_index(spark, a.index, EMBEDDER)
    questions = spark.read.parquet(a.questions)
    asked = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))
    signals = refusal.confidence(retrieval.bm25_search(stored, asked, a.k))
    known = questions.select(F.col("question_id").alias("query_id"), (F.coalesce(F.size("gold_chunks"), F.lit(0)) + F.coalesce(F.size("gold_spans"), F.lit(0)) > 0).alias("answerable")).join(signals, "query_id", "left")
    for signal in ("top_score", "mean_score", "margin"):
        points = refusal.curve(known.select(F.coalesce(signal, F.lit(0.0)).alias("confidence"), "answerable"))
        print(signal)
        refusal.operating_point(points).show(truncate=False)
    return 0


def baseline(spark: SparkSession, a) -> int:
    filings_index.promote(spark.read.parquet(a.run), a.out)
    return 0


def calibrate_export(spark: SparkSession, a) -> int:
    sample = judging.calibration_sample(spark.read.parquet(a.questions).select("question_id", "question_type"), spark.read.parquet(a.judged), a.n)
    sample.coalesce(1).write.mode("overwrite").json(a.out)
    return 0


def calibrate_report(spark: SparkSession, a) -> int:
    judging.agreement(filings_index.read_labels(spark, a.labels)).show(truncate=False)
    return 0


COMMANDS = {
    "ingest": (ingest, ["pages", "out"]),
    "index": (index, ["documents", "out"]),
    "query": (query, ["index", "question"]),
    "inspect": (inspect, ["documents", "doc_id"]),
    "validate": (validate, ["questions"]),
    "stats": (stats, ["questions"]),
    "run": (run, ["documents", "questions", "out"]),
    "compare": (compare, ["baseline", "candidate"]),
    "gate": (gate, ["baseline", "candidate"]),
    "loadtest": (loadtest, ["index", "questions"]),
    "security": (security_report, ["index", "questions"]),
    "refusal": (refusal_report, ["index", "questions"]),
    "baseline": (baseline, ["run", "out"]),
    "calibrate-export": (calibrate_export, ["judged", "questions", "out"]),
    "calibrate-report": (calibrate_report, ["labels"]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gleanery", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, needed) in COMMANDS.items():
        c = commands.add_parser(name)
        for n in needed:
            c.add_argument("--" + n.replace("_", "-"), required=True)
        c.add_argument("--force", action="store_true")
        c.add_argument("--chunker", default="fixed", choices=sorted(chunking.CHUNKERS))
        c.add_argument("--k", type=int, default=5)
        c.add_argument("--n", type=int, default=30)
        c.add_argument("--ladder", default="generation", choices=["chunking", "retrieval", "generation"])
        c.add_argument("--step", type=int, default=0)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return COMMANDS[a.command][0](tune(spark or local_session()), a)


if __name__ == "__main__":
    sys.exit(main())
