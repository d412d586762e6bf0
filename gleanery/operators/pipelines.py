"""Configurations of the whole pipeline, sweeps over them, and evaluation runs with an identity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import vectors as V
from gleanery.operators import answering, chunking, context, evaluation, judging, refusal, retrieval
from gleanery.session import checkpointed


@dataclass(frozen=True)
class Config:
    """Every knob that can change a result, and nothing else."""

    label: str
    chunker: str = "fixed"
    chunker_knobs: dict = field(default_factory=dict)
    dim: int = 512
    dense: bool = True
    bm25: bool = False
    rrf_k: int = 60
    fetch_depth: int = 50
    rerank: bool = False
    retrieve_depth: int = 50
    metadata_filter: bool = False
    top_k: int = 5
    context_tokens: int = 4000
    deduplicate: bool = True
    reorder: bool = True
    rewrite: bool = False
    refusal_signal: str = ""
    refusal_threshold: float = 0.0
    verify: bool = False

    def __post_init__(self):
        if not (self.dense or self.bm25):
            raise ValueError(f"{self.label}: needs a dense or a lexical retriever")
        if self.top_k < 1:
            raise ValueError(f"{self.label}: top_k must be at least 1")
        if self.rerank and self.retrieve_depth < self.top_k:
            raise ValueError(f"{self.label}: retrieve_depth must be at least top_k")

    def index_key(self) -> str:
        """Configurations of one key share chunks and vectors."""
        return json.dumps([self.chunker, self.chunker_knobs, self.dim], sort_keys=True)


BASE = Config("fixed, dense")
CHUNKING_SWEEP = [replace(BASE, label=name, chunker=name) for name in ("fixed", "recursive", "structure", "sentence_window", "parent_document", "semantic")]
_STRUCTURE = replace(BASE, label="+ structure", chunker="structure")
_HYBRID = replace(_STRUCTURE, label="+ lexical, fused", bm25=True)
_RERANK = replace(_HYBRID, label="+ reranking", rerank=True, retrieve_depth=30)
RETRIEVAL_LADDER = [BASE, _STRUCTURE, _HYBRID, _RERANK, replace(_RERANK, label="+ metadata filter", metadata_filter=True)]
_PLAIN = replace(_HYBRID, label="structure, fused", deduplicate=False, reorder=False)
_DEDUP = replace(_PLAIN, label="+ deduplication", deduplicate=True)
_ORDER = replace(_DEDUP, label="+ presentation order", reorder=True)
_REWRITE = replace(_ORDER, label="+ rewriting", rewrite=True)
_VERIFY = replace(_REWRITE, label="+ claim checks", verify=True)
GENERATION_LADDER = [_PLAIN, _DEDUP, _ORDER, _REWRITE, _VERIFY, replace(_VERIFY, label="+ refusal", refusal_signal="top_score", refusal_threshold=0.0324)]


def changed_knobs(a: Config, b: Config) -> set[str]:
    """What differs between two configurations, the label aside."""
    x, y = asdict(a), asdict(b)
    return {k for k in x if k != "label" and x[k] != y[k]}


class Indexes:
    """Chunks and vectors of documents, made once for each key of a sweep.

    The vectors, which are longer than the texts, are not stored: a search makes them in the pass that reads them.
    """

    def __init__(self, documents: DataFrame):
        self.documents = documents
        self._made: dict[str, DataFrame] = {}

    def get(self, config: Config) -> DataFrame:
        key = config.index_key()
        if key not in self._made:
            texts = self.documents.select("doc_id", F.col("text").alias("whole"), F.col("metadata")["company"].alias("company"), F.expr("try_cast(metadata['fiscal_year'] as int)").alias("fiscal_year"))
            made = chunking.build_chunker(config.chunker, **config.chunker_knobs)(self.documents).drop("text")
            cut = lambda a, b: F.substr("whole", a + 1, b - a)
            focus = [cut(F.col("focus_start"), F.col("focus_end")).alias("embed_text")] if "focus_start" in made.columns else []
            joined = made.join(texts, "doc_id").select("chunk_id", "doc_id", "char_start", "char_end", "company", "fiscal_year", cut(F.col("char_start"), F.col("char_end")).alias("text"), *focus)
            embedded = F.col("embed_text" if focus else "text")
            self._made[key] = checkpointed(joined).withColumn("vector", V.hashing_embedder(config.dim)(embedded)).drop("embed_text")
        return self._made[key]


def _depths(config: Config) -> tuple[int, int]:
    """Hits that are fused or reranked, and hits of each ranking."""
    depth = config.retrieve_depth if config.rerank else config.top_k
    return depth, max(depth, config.fetch_depth) if config.dense and config.bm25 else depth


class Searches:
    """Rankings and labels of one set of questions, made once for all configurations of a sweep that share them.

    A ranking is made to the greatest depth that any of ``configs`` needs; its first ranks are the ranking to a lower one.
    """

    def __init__(self, *configs: Config):
        self.configs = configs
        self._made: dict[tuple, DataFrame] = {}

    def get(self, kind: str, config: Config, make: Callable[[int], DataFrame]) -> DataFrame:
        """``make`` with the greatest depth, or what it gave before."""
        knobs = lambda c: (c.index_key(), *((c.rewrite, c.metadata_filter) if kind in ("bm25", "dense") else ()))
        key = (kind, *knobs(config))
        if key not in self._made:
            depths = [_depths(c)[1] for c in (config, *self.configs) if (kind not in ("bm25", "dense") or getattr(c, kind)) and knobs(c) == key[1:]]
            self._made[key] = checkpointed(make(max(depths)))
        return self._made[key]


def retrieve(config: Config, index: DataFrame, asked: DataFrame, searches: Searches | None = None) -> DataFrame:
    """Hits of a batch of queries under a configuration."""
    searches = searches or Searches()
    depth, first = _depths(config)
    filters = checkpointed(retrieval.extract_filters(asked, retrieval.company_aliases(index))) if config.metadata_filter else None
    ranked = lambda hits: hits.select("query_id", "chunk_id", "rank", "score")
    rankings = []
    if config.bm25:
        rankings.append(searches.get("bm25", config, lambda k: ranked(retrieval.bm25_search(index, asked, k, filters=filters))))
    if config.dense:
        vectors = asked.select("query_id", V.hashing_embedder(config.dim)(F.col("query")).alias("vector"))
        rankings.append(searches.get("dense", config, lambda k: ranked(retrieval.dense(index, vectors, k, filters=filters))))
    rankings = [r.filter(F.col("rank") <= first) for r in rankings]
    if len(rankings) == 1:
        hits = rankings[0]
    else:
        fused = retrieval.reciprocal_rank_fusion(*rankings, k=config.rrf_k)
        # one ranking alone may have found nothing that fits and given the others
        hits = retrieval.top_k(fused, depth) if filters is None else retrieval.filtered(fused, filters, index, depth)
    if config.rerank:
        hits = retrieval.top_k(retrieval.lexical_rerank(hits, asked, index), config.top_k)
    return checkpointed(hits.filter(F.col("rank") <= config.top_k))


def decide(config: Config, index: DataFrame, questions: DataFrame, searches: Searches | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, decided): hits in the retriever's order; query_id, query, signals and refusal of every question."""
    text = answering.rewrite(F.col("question"), F.col("history")) if config.rewrite else F.col("question")
    asked = checkpointed(questions.select(F.col("question_id").alias("query_id"), text.alias("query")))
    hits = retrieve(config, index, asked, searches)
    signals = asked.join(refusal.confidence(hits), "query_id", "left")
    return hits, refusal.refused(signals, config.refusal_signal or "top_score", config.refusal_threshold if config.refusal_signal else float("-inf"))


def build(config: Config, indexes: Indexes) -> Callable[[DataFrame], DataFrame]:
    """A function of questions (question_id, question, history) to responses: one row per question with rewritten query,
    hits in the retriever's order, refusal, answer, citations and groundedness."""

    def answer(questions: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        index = indexes.get(config)
        hits, decided = found or decide(config, index, questions)
        asked = decided.select("query_id", "query")
        kept = hits.join(decided.filter(~F.col("refused")).select("query_id"), "query_id", "left_semi")
        shown = context.assemble(kept, index, config.context_tokens, context.DUPLICATE if config.deduplicate else 2.0, config.reorder)
        first = shown.select("query_id", F.posexplode("kept").alias("place", "h")).select("query_id", F.col("h.chunk_id").alias("chunk_id"), (F.col("place") + 1).alias("rank"))
        made = checkpointed(answering.extractive(first, asked, index))
        found = hits.join(index.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "text"))).alias("h"))
        out = decided.select("query_id", "query", "refused").join(made, "query_id", "left").join(found, "query_id", "left")
        out = out.select("query_id", "query", "refused", F.coalesce("answer", F.lit("")).alias("answer"), "citations", F.transform("h", lambda h: h["chunk_id"]).alias("retrieved"), F.transform("h", lambda h: h["text"]).alias("texts"))
        if config.verify:
            cited = made.select("query_id", "answer", F.array_distinct(F.flatten(F.transform("citations", lambda c: c["chunk_ids"]))).alias("cited"))
            grounds = answering.verify(cited, "query_id", index).groupBy("query_id").agg(F.avg(F.col("supported").cast("double")).alias("groundedness"))
            return out.join(grounds, "query_id", "left")
        return out.withColumn("groundedness", F.lit(None).cast("double"))

    return answer


def dataset_digest(questions: DataFrame) -> str:
    """A digest of the questions, whatever their order and partitions."""
    line = F.sha2(F.to_json(F.struct(*sorted(questions.columns))), 256)
    sums = questions.select(line.alias("h")).agg(*(F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)), F.count("*").alias("n")).first()
    return hashlib.sha256(repr(tuple(map(str, sums))).encode()).hexdigest()


def run_id(config: Config, questions: DataFrame, judge: str = "none", resamples: int = 10_000, seed: str = "20260906") -> str:
    """Twelve hex digits of everything that can change a number: never of labels, times or machines."""
    knobs = {k: v for k, v in asdict(config).items() if k != "label"}
    payload = {"config": knobs, "judge": judge, "ks": list(evaluation.KS), "resamples": resamples, "seed": seed, "dataset": dataset_digest(questions)}
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:12]


@dataclass
class Run:
    run_id: str
    label: str
    scores: DataFrame
    aggregates: DataFrame
    find_warnings: Callable[[], list[str]]

    @cached_property
    def warnings(self) -> list[str]:
        return self.find_warnings()


def evaluate(config: Config, indexes: Indexes, questions: DataFrame, judge: judging.Judge = judging.null_judge, allow_unverified: bool = True, searches: Searches | None = None) -> Run:
    """All metrics of a configuration over a set of questions, in long form and aggregated by slice.

    Answers are made where a score depends on them (claim checks, a judge), and for the warnings when these are read:
    the null judge gives no score.
    """
    if not allow_unverified and not questions.filter("verified_by is null or verified_at is null").isEmpty():
        raise ValueError("the data set has unverified questions")
    searches = searches or Searches()
    index = indexes.get(config)
    hits, decided = decide(config, index, questions, searches)
    responses = lru_cache(lambda: checkpointed(build(config, indexes)(questions, (hits, decided))))
    judged = lru_cache(lambda: judge(judging.cases(questions, responses().select(F.col("query_id").alias("question_id"), "answer", "refused", "texts"))))
    qrels = searches.get("labels", config, lambda _: evaluation.relevance(questions, index))
    scores = evaluation.long_form(evaluation.retrieval_metrics(hits.select("query_id", "chunk_id", "rank"), qrels, questions))
    answerable = (F.coalesce(F.size("gold_chunks"), F.lit(0)) > 0) | (F.coalesce(F.size("gold_spans"), F.lit(0)) > 0)
    settled = responses().select("query_id", "refused", "groundedness") if config.verify else decided.select("query_id", "refused", F.lit(None).cast("double").alias("groundedness"))
    spoken = questions.select("question_id", answerable.alias("answerable")).join(settled.withColumnRenamed("query_id", "question_id"), "question_id")
    refusals = spoken.select("question_id", *evaluation.refusal_scores(F.col("answerable"), F.col("refused")), "groundedness")
    names = ("correct_refusal", "answered_unanswerable", "false_refusal", "groundedness")
    scores = scores.unionByName(evaluation.long_form(refusals.select("question_id", *names), names))
    if judge is not judging.null_judge:
        scores = scores.unionByName(judging.judged_scores(judged()).filter("metric <> 'groundedness'"))
    scores = checkpointed(scores)

    def find_warnings() -> list[str]:
        lost = evaluation.coverage(questions, qrels).filter("lost").count()
        failed = judged().filter("error is not null").count()
        return [f"{lost} questions lost their evidence under this chunking"] * (lost > 0) + [f"{failed} judgements failed and are unscored"] * (failed > 0)

    return Run(run_id(config, questions, getattr(judge, "__name__", "judge")), config.label, scores, evaluation.aggregates(scores, questions), find_warnings)


def sweep(configs: list[Config], documents: DataFrame, questions: DataFrame, judge: judging.Judge = judging.null_judge) -> Iterator[Run]:
    """Runs of several configurations that share what their index keys and searches let them share."""
    indexes, searches = Indexes(documents), Searches(*configs)
    for config in configs:
        yield evaluate(config, indexes, questions, judge, searches=searches)
