"""From ranked hits to the passages that a generator sees."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

_TOKEN = re.compile(T.TOKEN)
MAX_TOKENS, DUPLICATE, SHINGLE = 4000, 0.8, 4


def presentation_order(hits: DataFrame) -> DataFrame:
    """Adds ``position``: odd ranks from the front, even ranks from the back, so the best stand at both ends."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    r = F.col("rank")
    return hits.withColumn("position", F.when(r % 2 == 1, (r + 1) / 2).otherwise(n - r / 2 + 1).cast("int"))


ASSEMBLED = (
    "query_id {0}, kept array<struct<rank:int,chunk_id:string,score:double,text:string,cost:int>>, dropped_duplicate array<struct<dropped:string,kept:string,similarity:double>>, "
    "dropped_budget array<string>, tokens_used int, utilisation double"
)


def _runs(tokens: list[str], size: int) -> set:
    if len(tokens) < size:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[k : k + size]) for k in range(len(tokens) - size + 1)}


def _similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def assemble(hits: DataFrame, corpus: DataFrame, max_tokens: int = MAX_TOKENS, duplicate: float = DUPLICATE, reorder: bool = True) -> DataFrame:
    """One row per query: kept passages in presentation order, dropped duplicates and passages over the budget.

    A hit is dropped when its shingles reach the Jaccard ``duplicate`` with a hit kept before it; one that does not fit
    the budget is skipped, later ones may still fit, and the first is always kept. Each hit depends on the ones before
    it, so the at most k hits of a query are one group.
    """
    passages = hits.join(corpus.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "rank", "score", "text")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        unique, dropped = [], []
        for hit in group.sort_values("rank").itertuples():
            tokens = _TOKEN.findall((hit.text or "").lower())
            runs = _runs(tokens, SHINGLE)
            near = next(((k["chunk_id"], s) for k, own in unique if (s := _similarity(runs, own)) >= duplicate), None)
            if near:
                dropped.append({"dropped": hit.chunk_id, "kept": near[0], "similarity": near[1]})
            else:
                unique.append(({"rank": int(hit.rank), "chunk_id": hit.chunk_id, "score": float(hit.score), "text": hit.text, "cost": len(tokens)}, runs))
        kept, over, used = [], [], 0
        for hit, _ in unique:
            if used + hit["cost"] > max_tokens and kept:
                over.append(hit["chunk_id"])
            else:
                kept.append(hit)
                used += hit["cost"]
        if reorder:
            kept = kept[::2] + kept[1::2][::-1]
        return pd.DataFrame([(group["query_id"].iloc[0], kept, dropped, over, used, used / max_tokens)], columns=["query_id", "kept", "dropped_duplicate", "dropped_budget", "tokens_used", "utilisation"])

    return passages.groupBy("query_id").applyInPandas(fold, ASSEMBLED.format(hits.schema["query_id"].dataType.simpleString()))
