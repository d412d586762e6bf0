"""Places for models that are not part of this engine, each a function of DataFrames with a fallback inside the engine.

A model gets the rows it needs and gives them back with its columns and an ``error`` column; a row with an error, or
without a result, gets the fallback, so a failing model never fails a batch.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import answering, retrieval

Model = Callable[[DataFrame], DataFrame]


def load(spec: str, **knobs):
    """What ``module:name`` names, called with the knobs if there are any."""
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"{spec!r} is not of the form module:name")
    found = getattr(importlib.import_module(module), name)
    return found(**knobs) if knobs else found


def rewrite(queries: DataFrame, model: Model | None = None) -> DataFrame:
    """(query_id, query): rewritten by the model (adds ``rewritten``), else by the rules for dependent questions."""
    ruled = queries.withColumn("ruled", answering.rewrite(F.col("query"), F.col("history")))
    if model is None:
        return ruled.select("query_id", F.col("ruled").alias("query"))
    made = model(ruled)
    usable = F.col("error").isNull() & (F.coalesce(F.trim("rewritten"), F.lit("")) != "")
    return made.select("query_id", F.when(usable, F.col("rewritten")).otherwise(F.col("ruled")).alias("query"))


def rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, model: Model | None = None) -> DataFrame:
    """Hits scored again, by the model over (query_id, chunk_id, query, text) or by word overlap, cut to k."""
    if model is None:
        return retrieval.top_k(retrieval.lexical_rerank(hits, queries, corpus), k)
    pairs = hits.select("query_id", "chunk_id").join(corpus.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    scored = model(pairs).select("query_id", "chunk_id", F.when(F.col("error").isNull(), F.col("score")).alias("score"))
    return retrieval.top_k(scored.filter("score is not null"), k)


def cited_chunks(indexes: Column, chunk_ids: Column) -> Column:
    """Chunk ids of the passages that a model cites by number, from 1; numbers it was not shown are dropped."""
    return F.array_compact(F.transform(indexes, lambda i: F.when((i >= 1) & (i <= F.size(chunk_ids)), F.try_element_at(chunk_ids, i))))


def generate(shown: DataFrame, queries: DataFrame, corpus: DataFrame, model: Model | None = None) -> DataFrame:
    """(query_id, answer, refused, citations, error) from assembled contexts.

    The model gets query_id, query and prompt, the numbered passages, and adds answer, refused, claims (an array of
    text and passage numbers) and error; an error is reported and not raised. Without a model the answer is extractive.
    """
    ids = F.transform("kept", lambda h: h["chunk_id"])
    if model is None:
        first = shown.select("query_id", F.posexplode("kept").alias("place", "h")).select("query_id", F.col("h.chunk_id").alias("chunk_id"), (F.col("place") + 1).alias("rank"))
        made = answering.extractive(first, queries, corpus)
        joined = queries.select("query_id").join(made, "query_id", "left")
        return joined.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.col("answer").isNull().alias("refused"), "citations", F.lit(None).cast("string").alias("error"))
    prompts = shown.select("query_id", ids.alias("chunk_ids"), T.passages(ids, F.transform("kept", lambda h: h["text"])).alias("prompt")).join(queries.select("query_id", "query"), "query_id")
    made = model(prompts)
    citations = F.transform("claims", lambda c, k: F.struct(k.cast("int").alias("claim_index"), cited_chunks(c["passages"], F.col("chunk_ids")).alias("chunk_ids"), c["text"].alias("text")))
    failed = F.col("error").isNotNull()
    return made.select("query_id", F.when(failed, "").otherwise(F.coalesce("answer", F.lit(""))).alias("answer"), F.coalesce(~failed & F.col("refused"), F.lit(False)).alias("refused"), F.when(~failed, citations).alias("citations"), "error")


def build_generator(name: str = "extractive", spec: str | None = None) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """A generator by name: "extractive", or "model", which is what ``spec`` (module:name) names, with its fallbacks."""
    if name == "extractive":
        return generate
    if name == "model" and spec:
        model = load(spec)
        return lambda shown, queries, corpus: generate(shown, queries, corpus, model)
    raise ValueError(f"unknown generator {name!r}; known: extractive, model with module:name")
