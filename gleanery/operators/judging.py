"""Judged metrics: scales, judges as functions of DataFrames, fallbacks, and calibration against human labels.

A judge is a function of (question_id, metric, question, answer, context, gold_answer, claim) rows that adds score,
reasoning and error; a row with an error is unscored and never counts as 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import answering, evaluation

# Categories and labels of the judged metrics.
SCALES = {
    "answer_correctness": {0: "incorrect", 1: "partially correct", 2: "correct"},
    "context_sufficiency": {0: "insufficient", 1: "sufficient"},
    "claim_support": {0: "contradicted", 1: "not stated", 2: "supported"},
}
PASSAGES_SHOWN, PASSAGE_CHARS = 20, 4000
Judge = Callable[[DataFrame], DataFrame]


def normalise(metric: Column, score: Column) -> Column:
    """Scores mapped to 0..1; a score outside its scale is an error."""
    out = None
    for name, labels in SCALES.items():
        lo, hi = min(labels), max(labels)
        inside = F.when(score.isin(*labels), (score - lo) / (hi - lo)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: score outside its scale: "), score.cast("string"))).cast("double"))
        out = F.when(metric == name, inside) if out is None else out.when(metric == name, inside)
    return F.when(score.isNotNull(), out)


def null_judge(rows: DataFrame) -> DataFrame:
    """No judge: every row is unscored, with the reason."""
    return rows.withColumns({"score": F.lit(None).cast("int"), "reasoning": F.lit(""), "error": F.lit("no judge configured")})


def lexical_judge(rows: DataFrame) -> DataFrame:
    """A judge without a model, for tests and offline runs: word overlap with the reference or the context."""
    share = lambda a, b: F.try_divide(F.size(F.array_intersect(T.content_tokens(a), T.content_tokens(b))), F.size(T.content_tokens(a)))
    overlap = F.when(F.col("metric") == "answer_correctness", share(F.col("gold_answer"), F.col("answer"))).when(F.col("metric") == "context_sufficiency", share(F.col("gold_answer"), F.col("context"))).otherwise(share(F.col("claim"), F.col("context")))
    graded = F.when(overlap >= 0.8, 2).when(overlap >= 0.4, 1).otherwise(0)
    score = F.when(F.col("metric") == "context_sufficiency", F.when(overlap >= 0.6, 1).otherwise(0)).otherwise(graded)
    return rows.withColumns({"score": score, "reasoning": F.format_string("%.2f of the words shared", F.coalesce(overlap, F.lit(0.0))), "error": F.lit(None).cast("string")})


def shown_context(texts: Column) -> Column:
    """The first PASSAGES_SHOWN passages, numbered, each cut at PASSAGE_CHARS, and a note of how many are left out."""
    shown = lambda t: F.when(F.length(t) > PASSAGE_CHARS, F.concat(F.left(t, F.lit(PASSAGE_CHARS)), F.lit(" (cut)"))).otherwise(t)
    each = F.transform(F.slice(texts, 1, PASSAGES_SHOWN), lambda t, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), shown(T.strip(t))))
    more = F.size(texts) - PASSAGES_SHOWN
    whole = F.concat(F.array_join(each, "\n\n"), F.when(more > 0, F.concat(F.lit("\n\n("), more.cast("string"), F.lit(" passages omitted)"))).otherwise(""))
    return F.when(F.size(texts) <= 0, "(nothing retrieved)").otherwise(whole)


def cases(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """What a judge is asked: sufficiency and correctness where there is a gold answer to an answerable question, support
    of each claim where there is an answer. ``responses`` has question_id, answer, refused, texts (of hits by rank)."""
    answerable = (F.coalesce(F.size("gold_chunks"), F.lit(0)) > 0) | (F.coalesce(F.size("gold_spans"), F.lit(0)) > 0)
    joined = questions.select("question_id", "question", "gold_answer", answerable.alias("answerable")).join(responses, "question_id")
    base = joined.withColumn("context", shown_context(F.col("texts")))
    gold = base.filter(F.col("answerable") & (F.coalesce(F.trim("gold_answer"), F.lit("")) != ""))
    columns = ["question_id", "metric", "question", "answer", "context", "gold_answer", "claim"]
    rated = gold.withColumn("metric", F.explode(F.array(F.lit("context_sufficiency"), F.lit("answer_correctness")))).withColumn("claim", F.lit(None).cast("string")).select(columns)
    spoken = base.filter((F.coalesce(F.trim("answer"), F.lit("")) != "") & ~F.coalesce("refused", F.lit(False)))
    claimed = spoken.withColumn("claim", F.explode(T.claims(F.col("answer")))).withColumn("metric", F.lit("claim_support")).select(columns)
    return rated.unionByName(claimed)


def judged_scores(judged: DataFrame) -> DataFrame:
    """(question_id, metric, value): normalised scores, groundedness as the share of supported claims; errors unscored."""
    scored = judged.filter("error is null")
    rated = scored.filter("metric <> 'claim_support'").select("question_id", "metric", normalise(F.col("metric"), F.col("score")).alias("value"))
    grounds = scored.filter("metric = 'claim_support'").groupBy("question_id").agg(F.avg((F.col("score") == 2).cast("double")).alias("value"))
    return rated.unionByName(grounds.select("question_id", F.lit("groundedness").alias("metric"), "value"))


def verify(answers: DataFrame, key: str, corpus: DataFrame, judge: Judge) -> DataFrame:
    """Claim verdicts by a judge (supported when the score is 2); where it fails, the lexical verdict with the reason."""
    lexical = answering.verify(answers, key, corpus)
    context = answers.select(key, F.explode("cited").alias("chunk_id")).join(corpus.select("chunk_id", "text"), "chunk_id").groupBy(key).agg(F.concat_ws("\n\n", F.array_sort(F.collect_list("text"))).alias("context"))
    rows = lexical.join(context, key, "left").withColumns({"metric": F.lit("claim_support"), "question": F.lit(""), "answer": F.lit(""), "gold_answer": F.lit("")})
    judged = judge(rows.withColumnsRenamed({"score": "lexical_score", "supported": "lexical_supported", "reason": "lexical_reason"}))
    failed = F.col("error").isNotNull()
    return judged.select(
        key,
        "claim_no",
        "claim",
        F.when(failed, F.col("lexical_supported")).otherwise(F.col("score") == 2).alias("supported"),
        F.when(failed, F.col("lexical_score")).otherwise(F.col("score") / 2).alias("score"),
        F.when(failed, F.concat(F.lit("judge failed ("), "error", F.lit("): "), "lexical_reason")).otherwise(F.col("reasoning")).alias("reason"),
    )


def rubric_version(text: str) -> str:
    """Twelve hex digits that change with the text of a rubric."""
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def load_rubric(spark, path: str) -> tuple[str, str]:
    """(text, version) of a rubric file."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if not text.strip():
        raise ValueError(f"the rubric {path} is empty")
    return text, rubric_version(text)


def build_judge(name: str = "none", spec: str | None = None) -> Judge:
    """A judge by name; "custom" is what ``spec`` (module:name) names."""
    known = {"none": null_judge, "lexical": lexical_judge}
    if name == "custom" and spec:
        from gleanery.operators.plugins import load

        return load(spec)
    if name not in known:
        raise ValueError(f"unknown judge {name!r}; known: custom, {', '.join(sorted(known))}")
    return known[name]


def calibration_sample(results: DataFrame, judged: DataFrame, n: int, salt: str = "0") -> DataFrame:
    """n judged questions for hand labelling: (question_id, question_type, judge_scores, human_scores empty)."""
    scores = judged.filter("error is null").groupBy("question_id", "metric").agg(F.first("score").alias("score")).groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "score"))).alias("judge_scores"))
    chosen = evaluation.stratified_sample(results.join(scores.select("question_id"), "question_id", "left_semi"), n, salt)
    return chosen.join(scores, "question_id").withColumn("human_scores", F.create_map().cast("map<string,int>")).orderBy("question_id")


def agreement(samples: DataFrame) -> DataFrame:
    """(metric, kappa, raw_agreement, n, band, passes) of samples labelled by both; two categories are unweighted."""
    labelled = samples.select("question_id", "human_scores", F.explode("judge_scores").alias("metric", "judge")).withColumn("human", F.try_element_at("human_scores", F.col("metric"))).filter("human is not null and judge is not null")
    out = None
    for metric, labels in SCALES.items():
        part = evaluation.kappa(labelled.filter(F.col("metric") == metric).select("metric", "human", "judge"), tuple(labels), "unweighted" if len(labels) <= 2 else "quadratic")
        out = part if out is None else out.unionByName(part)
    return out.select("metric", "kappa", "raw_agreement", "n", evaluation.kappa_band(F.col("kappa")).alias("band"), F.coalesce(F.col("kappa") >= evaluation.KAPPA_GATE, F.lit(False)).alias("passes"))
