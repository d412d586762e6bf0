"""Rewriting, extractive answers, claim checking, and the grounded pipeline over a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import context, refusal, retrieval, security
from gleanery.session import checkpointed

SENTENCES, SUPPORT = 3, 0.6
# Patterns of questions that lean on what was said before, and of framing that claims nothing.
CONTINUATION = r"(?i)^\s*(?:and|but|so|then|also|what about|how about|why|and what|and how)\b"
ELLIPSIS = r"(?i)\b(?:the (?:year|quarter|period) (?:before|after|prior)|prior year|same for|too|as well)\b"
ANAPHORA = r"(?i)\b(?:that|those|these|this|it|its|they|them|their|he|she|him|her|his|there)\b"
ENTITY = r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]+)*\b"
DISCOURSE = (
    r"(?i)^\s*(?:in summary|to summari[sz]e|here(?:'s| is| are)|summary|overall|based on (?:the )?(?:filing|passages|context)|"
    r"according to (?:the )?(?:filing|passages)|i hope this helps|note that|in conclusion)\b"
)


def is_dependent(query: Column) -> Column:
    """Whether a question cannot stand alone; errs towards yes. A blank question can."""
    q = T.strip(query)
    named = F.substr(q, F.lit(2)).rlike(ENTITY)
    return F.when(q == "", False).when(q.rlike(CONTINUATION) | q.rlike(ELLIPSIS), True).when(q.rlike(ANAPHORA) & ~named, True).otherwise((F.size(F.split(q, rf"[{T.WS}]+")) <= 6) & ~named)


def rewrite(query: Column, history: Column, lookback: int = 2) -> Column:
    """Names and a year of the last turns in front of a dependent question that lacks them."""
    recent = F.slice(history, F.greatest(F.size(history) - (lookback - 1), F.lit(1)), F.lit(lookback))
    said = F.array_join(F.transform(recent, lambda h: F.concat_ws(" ", h["question"], h["answer"])), " ")
    known = F.transform(T.all_matches(F.substr(query, F.lit(2)), ENTITY), lambda e: F.lower(e))
    fresh = F.filter(T.all_matches(said, ENTITY), lambda e: ~F.array_contains(known, F.lower(e)))
    # the first of names that differ in case only
    lowered = F.transform(fresh, lambda e: F.lower(e))
    fresh = F.filter(F.transform(fresh, lambda e, k: F.when(F.array_position(lowered, F.lower(e)) == k + 1, e)), lambda e: e.isNotNull() & (F.length(e) > 3))
    new_years = F.filter(T.all_matches(said, T.YEAR, 1), lambda y: ~F.array_contains(T.all_matches(query, T.YEAR, 1), y))
    year = F.when(F.size(new_years) > 0, F.array(F.concat(F.lit("fiscal "), new_years[0]))).otherwise(F.array().cast("array<string>"))
    prefix = F.array_join(F.concat(F.slice(fresh, 1, 2), year), " ")
    use = (F.coalesce(F.size(history), F.lit(0)) > 0) & is_dependent(query) & (prefix != "")
    return F.when(use, F.concat(prefix, F.lit(": "), T.strip(query))).otherwise(query)


def extractive(hits: DataFrame, queries: DataFrame, corpus: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """(query_id, answer, citations): sentences of the first passage by shared terms, in order where they share as many."""
    best = hits.filter("rank = 1").join(corpus.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    parts = F.filter(F.transform(F.split(F.col("text"), rf"(?<=[.!?])[{T.WS}]+"), lambda s: T.strip(s)), lambda s: s != "")
    terms = T.answer_terms(F.col("query"))
    scored = F.transform(parts, lambda s, k: F.struct((-F.size(F.array_intersect(terms, T.answer_terms(s)))).alias("shared"), k.alias("place"), s.alias("sentence")))
    chosen = F.transform(F.slice(F.array_sort(scored), 1, sentences), lambda s: s["sentence"])
    made = best.select("query_id", "chunk_id", chosen.alias("chosen"))
    citations = F.transform("chosen", lambda s, k: F.struct(k.cast("int").alias("claim_index"), F.array(F.col("chunk_id")).alias("chunk_ids"), s.alias("text")))
    return made.select("query_id", F.array_join("chosen", " ").alias("answer"), citations.alias("citations"))


def verify(answers: DataFrame, key: str, corpus: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """(key, claim_no, claim, supported, score, reason) for every claim of answers (key, answer, cited chunk ids).

    A figure that no cited chunk has makes a claim unsupported; framing without content is supported; otherwise the
    share of content words found in the cited chunks decides.
    """
    cited = answers.select(key, F.explode("cited").alias("chunk_id"))
    known = corpus.select("chunk_id", T.numbers(F.col("text")).alias("n"), T.content_tokens(F.col("text")).alias("t"))
    joined = cited.join(known, "chunk_id").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("known_numbers"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("known_tokens"))
    claims = answers.select(key, F.posexplode(T.claims(F.col("answer"))).alias("claim_no", "claim")).join(joined, key, "left")
    empty = F.array().cast("array<string>")
    missing = F.array_except(T.numbers(F.col("claim")), F.coalesce("known_numbers", empty))
    tokens = T.content_tokens(F.col("claim"))
    share = F.size(F.array_intersect(tokens, F.coalesce("known_tokens", empty))) / F.size(tokens)
    checked = claims.withColumn("missing", F.array_sort(missing)).withColumn("framing", F.col("claim").rlike(DISCOURSE) | (F.size(tokens) == 0))
    score = F.when(F.size("missing") > 0, 0.0).when(F.col("framing"), 1.0).otherwise(share)
    reason = (
        F.when(F.size("missing") > 0, F.concat(F.lit("figures not in context: "), F.array_join("missing", ", "))).when(F.col("framing"), F.lit("no factual content")).otherwise(F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("% of content terms present")))
    )
    return checked.select(key, "claim_no", "claim", ((F.size("missing") == 0) & (score >= threshold)).alias("supported"), score.alias("score"), reason.alias("reason"))


def annotate(answers: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Answers with a caveat for their unsupported claims."""
    lacking = verdicts.filter(~F.col("supported")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "claim"))), lambda c: c["claim"]).alias("lacking"))
    caveat = F.concat(F.lit("\n\nNot supported by the cited passages: "), F.array_join("lacking", " | "))
    return answers.join(lacking, key, "left").select(key, F.when(F.col("lacking").isNull(), F.col("answer")).otherwise(F.concat("answer", caveat)).alias("answer"), F.coalesce(F.size("lacking"), F.lit(0)).alias("n_unsupported"))


def grounded(queries: DataFrame, corpus: DataFrame, where: Column | None = None, k: int = 5, signal: str = "top_score", threshold: float = 2.0) -> DataFrame:
    """One response per query: rewritten query, refusal, answer, groundedness, hits in the retriever's order.

    ``queries`` has query_id, query and history. A refusal is decided on the hits before anything is generated; refused
    queries take no further part.
    """
    asked = queries.select("query_id", rewrite(F.col("query"), F.col("history")).alias("query"))
    hits = checkpointed(retrieval.bm25_search(corpus, asked, k, where))
    clean = corpus.select("chunk_id", security.sanitise(F.col("text")).alias("text"))
    signals = asked.join(refusal.confidence(hits), "query_id", "left")
    decided = checkpointed(refusal.refused(signals, signal, threshold).select("query_id", "query", "n_hits", signal, "refused"))
    open_hits = hits.join(decided.filter(~F.col("refused")).select("query_id"), "query_id", "left_semi")
    shown = checkpointed(context.assemble(open_hits, clean))
    first = shown.select("query_id", F.posexplode("kept").alias("place", "h")).select("query_id", F.col("h.chunk_id").alias("chunk_id"), (F.col("place") + 1).alias("rank"))
    made = checkpointed(extractive(first, asked, clean))
    cited = made.join(shown.select("query_id", F.transform("kept", lambda h: h["chunk_id"]).alias("cited")), "query_id").select("query_id", "answer", "cited")
    verdicts = checkpointed(verify(cited, "query_id", clean))
    grounds = verdicts.groupBy("query_id").agg(F.avg(F.col("supported").cast("double")).alias("groundedness"))
    answered = annotate(made.select("query_id", "answer"), verdicts, "query_id").join(grounds, "query_id", "left")
    retrieved = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("retrieved"))
    return decided.join(answered, "query_id", "left").join(retrieved, "query_id", "left").select("query_id", "query", "refused", F.coalesce("answer", F.lit("")).alias("answer"), F.round("groundedness", 6).alias("groundedness"), "n_unsupported", "retrieved")
