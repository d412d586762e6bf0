"""Scoring of retrieval and answers against labels; an undefined value is NULL and never 0."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL, PARTIAL = 0.90, 0.25
KS = (1, 5, 10, 20)
METRICS = ("recall", "answer_recall", "precision", "hit_rate", "mrr", "ndcg")


def resolve_spans(gold: DataFrame, chunks: DataFrame, full: float = FULL, partial: float = PARTIAL) -> DataFrame:
    """(question_id, chunk_id, relevance) from gold spans and the chunks that overlap them.

    ``gold`` has question_id, doc_id, char_start, char_end, weight; a range join within the equi-join on doc_id. A gold
    span of no length is covered by the chunk it lies in.
    """
    if full <= partial:
        raise ValueError(f"full coverage {full} must exceed partial coverage {partial}")
    g = gold.select("question_id", "doc_id", F.col("char_start").alias("g_start"), F.col("char_end").alias("g_end"), "weight")
    c = chunks.select("doc_id", "chunk_id", "char_start", "char_end")
    overlaps = (F.col("char_start") < F.col("g_end")) & (F.col("g_start") < F.col("char_end"))
    empty = (F.col("g_start") == F.col("g_end")) & (F.col("char_start") <= F.col("g_start")) & (F.col("g_start") < F.col("char_end"))
    met = g.join(c, "doc_id").filter(overlaps | empty)
    length = F.col("g_end") - F.col("g_start")
    share = F.when(length == 0, 1.0).otherwise((F.least("char_end", "g_end") - F.greatest("char_start", "g_start")) / length)
    earned = F.when(share >= full, F.when(F.col("weight") >= 1.0, 2).otherwise(1)).when(share >= partial, 1).otherwise(0)
    return met.groupBy("question_id", "chunk_id").agg(F.max(earned).alias("relevance")).filter("relevance > 0")


def relevance(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels of every question: from its spans where it has any, else from its chunk labels."""
    spans = questions.select("question_id", F.explode("gold_spans").alias("g")).select("question_id", "g.doc_id", "g.char_start", "g.char_end", "g.weight")
    labels = questions.filter(F.coalesce(F.size("gold_spans"), F.lit(0)) <= 0).select("question_id", F.explode("gold_chunks").alias("g")).select("question_id", "g.chunk_id", "g.relevance")
    return resolve_spans(spans, chunks).unionByName(labels.filter("relevance > 0"))


def coverage(questions: DataFrame, qrels: DataFrame) -> DataFrame:
    """(question_id, n_relevant, lost, degraded) of every question with spans."""
    expects = F.exists("gold_spans", lambda g: g["weight"] >= 1.0)
    spanned = questions.filter(F.size("gold_spans") > 0).select("question_id", expects.alias("expects"))
    found = qrels.groupBy("question_id").agg(F.count("*").alias("n"), F.max("relevance").alias("best"))
    joined = spanned.join(found, "question_id", "left")
    return joined.select("question_id", F.coalesce("n", F.lit(0)).alias("n_relevant"), F.col("n").isNull().alias("lost"), (F.col("n").isNotNull() & F.col("expects") & (F.col("best") < 2)).alias("degraded"))


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, questions: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(question_id, k, recall, answer_recall, precision, hit_rate, mrr, ndcg) of every question and k.

    ``hits`` has query_id, chunk_id, rank. Without gold everything is NULL; without hits precision is 0.
    """
    if any(k < 1 for k in ks):
        raise ValueError("k must be at least 1")
    gold = qrels.groupBy("question_id").agg(F.count_if(F.col("relevance") >= 1).alias("n_gold"), F.count_if(F.col("relevance") >= 2).alias("n_answer"))
    ideal_order = Window.partitionBy("question_id").orderBy(F.col("relevance").desc(), "chunk_id")
    ideal = qrels.withColumn("place", F.row_number().over(ideal_order)).select("question_id", "place", ((F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("place") + 1)).alias("gain"))
    graded = hits.select(F.col("query_id").alias("question_id"), "chunk_id", "rank").join(qrels, ["question_id", "chunk_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    per_k, ideal_k = [], []
    for k in ks:
        top, at = F.col("rank") <= k, F.lit(k)
        relevant = top & (F.col("relevance") >= 1)
        per_k.append(
            F.struct(
                at.alias("k"),
                F.countDistinct(F.when(relevant, F.col("chunk_id"))).alias("found"),
                F.countDistinct(F.when(top & (F.col("relevance") >= 2), F.col("chunk_id"))).alias("answers"),
                F.count_if(relevant).alias("good"),
                F.count_if(top).alias("seen"),
                F.min(F.when(relevant, F.col("rank"))).alias("first"),
                F.sum(F.when(top, (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1))).alias("dcg"),
            )
        )
        ideal_k.append(F.sum(F.when(F.col("place") <= k, F.col("gain"))).alias(f"ideal_{k}"))
    seen = graded.groupBy("question_id").agg(F.array(*per_k).alias("per_k"))
    ideals = ideal.groupBy("question_id").agg(F.create_map(*[x for k, c in zip(ks, ideal_k) for x in (F.lit(k), c)]).alias("ideals"))
    grid = questions.select("question_id").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    flat = seen.select("question_id", F.explode("per_k").alias("s")).select("question_id", "s.*")
    joined = grid.join(flat, ["question_id", "k"], "left").join(gold, "question_id", "left").join(ideals, "question_id", "left")
    known = F.col("n_gold") > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "question_id",
        "k",
        F.when(known, zero("found") / F.col("n_gold")).alias("recall"),
        F.when(F.col("n_answer") > 0, zero("answers") / F.col("n_answer")).alias("answer_recall"),
        F.when(known, F.when(zero("seen") == 0, 0.0).otherwise(F.col("good") / F.col("seen"))).alias("precision"),
        F.when(known, F.when(zero("found") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.when(known, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(known, F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideals")[F.col("k")]).alias("ndcg"),
    )


def long_form(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(question_id, metric, value): a row for each metric, metric@k where there is a k."""
    name = "concat('{0}@', k)" if "k" in scores.columns else "'{0}'"
    stack = ", ".join(f"{name.format(m)}, {m}" for m in metrics)
    return scores.select("question_id", F.expr(f"stack({len(metrics)}, {stack}) as (metric, value)"))


def aggregates(scores: DataFrame, slices: DataFrame) -> DataFrame:
    """(metric, question_type, mean, n, n_undefined) over all and by slice, in one pass; NULL type is the total."""
    joined = scores.join(slices.select("question_id", "question_type"), "question_id")
    sets = joined.groupingSets([["metric"], ["metric", "question_type"]], "metric", "question_type")
    made = sets.agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_undefined"), F.grouping("question_type").alias("total"))
    return made.select("metric", F.when(F.col("total") == 1, F.lit("(all)")).otherwise(F.col("question_type")).alias("question_type"), "mean", "n", "n_undefined")


def draw(replicate: Column, place: Column, n: Column, salt: str) -> Column:
    """A number below n that depends on its arguments alone, so every engine draws the same."""
    code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), replicate.cast("string"), place.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return code % n


def numbered(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """Rows numbered from 0 within their group, by two hex digits of the key's MD5, then by the key.

    Counted within those 256 buckets and moved up by what comes before, so no task ranks a whole group.
    """
    bucketed = rows.withColumn("bucket", F.substring(F.md5(key), 1, 2))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(group, "bucket").agg(F.count("*").alias("n")).select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(group, "bucket").orderBy(key)
    return bucketed.withColumn("local", F.row_number().over(within) - 1).join(offsets, [group, "bucket"]).withColumn(name, F.col("local") + F.col("offset")).drop("bucket", "local", "offset")


#: So many scored values are sent to every task at once at most (8 bytes each); a metric with more is drawn by a join.
BROADCAST_VALUES = 4_000_000
#: Replicates whose draws one product of matrices adds up.
REPLICATES_AT_ONCE = 16


def _drawn_by_join(kept: DataFrame, resamples: int, salt: str) -> DataFrame:
    places = numbered(kept, "metric", "question_id", "place").select("metric", "place", "value")
    counts = places.groupBy("metric").agg(F.count("*").alias("n"))
    draws = places.select("metric", "place").join(counts, "metric").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = draws.select("metric", "replicate", draw(F.col("replicate"), F.col("place"), F.col("n"), salt).alias("place"))
    return drawn.join(places, ["metric", "place"]).groupBy("metric", "replicate").agg(F.avg("value").alias("mean"))


def _drawn_in_tasks(kept: DataFrame, metrics: list[str], resamples: int, salt: str) -> DataFrame:
    spark = kept.sparkSession
    number = (F.array_position(F.array(*map(F.lit, metrics)), F.col("metric")) - 1).cast("int")
    rows = kept.filter(F.col("metric").isin(*metrics)).select(number.alias("metric"), F.substring(F.md5("question_id"), 1, 2).alias("bucket"), "question_id", "value").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("metric", "bucket", "question_id", "value")])
    own, every = rows.column("metric").to_numpy(), rows.column("value").to_numpy()
    bounds = np.searchsorted(own, np.arange(len(metrics) + 1))
    by_length: dict[int, list[int]] = {}
    for m, n in enumerate(np.diff(bounds).tolist()):
        by_length.setdefault(n, []).append(m)
    # metrics of as many values share their draws
    shared = spark.sparkContext.broadcast([([metrics[m] for m in same], np.stack([every[bounds[m] : bounds[m + 1]] for m in same], axis=1)) for same in by_length.values()])

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        places = [str(k).encode() for k in range(max(len(table) for _, table in known))]
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for at in range(0, len(numbers), REPLICATES_AT_ONCE):
                some = numbers[at : at + REPLICATES_AT_ONCE]
                starts = [f"{salt}:{r}:".encode() for r in some]
                codes = [np.frombuffer(b"".join([md5(start + k).digest()[:4] for k in places]), dtype=">u4").astype(np.int64) for start in starts]
                names, replicates, means = [], [], []
                for own, table in known:
                    n = len(table)
                    times = np.stack([np.bincount(c[:n] % n, minlength=n) for c in codes]).astype(float)
                    found = times @ table / n
                    found[np.abs(found) < 1e-14] = 0.0  # what is left of 0, whose parts are added up in another order
                    names += own * len(some)
                    replicates += np.repeat(some, len(own)).tolist()
                    means.append(found.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(replicates, pa.int32()), pa.array(np.concatenate(means), pa.float64())], names=["metric", "replicate", "mean"])

    tasks = max(1, min(resamples // 50, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, resamples, 1, tasks).mapInArrow(resample, "metric string, replicate int, mean double")


def bootstrap_means(values: DataFrame, resamples: int, salt: str, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """(metric, replicate, mean) of resamples with replacement of ``values`` (metric, question_id, value), NULLs dropped.

    The draws depend on replicate and place alone. Metrics are taken together up to ``broadcast_values`` values, counted
    before, and the replicates are spread over the tasks: a task makes the draws of a replicate once for all metrics,
    counts them by place and adds up the values as a product of matrices, and one row for each metric leaves it. The
    draws of a metric with more values are joined with these by place.
    """
    kept = values.filter("value is not null")
    counts = {r.metric: r.n for r in kept.groupBy("metric").agg(F.count("*").alias("n")).orderBy("metric").collect()}  # a row for each metric
    joined = [m for m, n in counts.items() if n > broadcast_values]
    groups, held = [], broadcast_values + 1
    for m, n in counts.items():
        if n <= broadcast_values:
            if held + n > broadcast_values:
                groups.append([])
                held = 0
            groups[-1].append(m)
            held += n
    parts = [_drawn_in_tasks(kept, group, resamples, salt) for group in groups]
    if joined or not parts:
        parts.append(_drawn_by_join(kept.filter(F.col("metric").isin(*joined)), resamples, salt))
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def bootstrap_interval(values: DataFrame, resamples: int = 10_000, confidence: float = 0.95, salt: str = "20260906") -> DataFrame:
    """(metric, mean, ci_low, ci_high, n); one value is its own interval."""
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must lie between 0 and 1, got {confidence}")
    tail = (1 - confidence) / 2
    means = bootstrap_means(values, resamples, salt).groupBy("metric").agg(F.percentile("mean", F.lit(tail)).alias("ci_low"), F.percentile("mean", F.lit(1 - tail)).alias("ci_high"))
    return values.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).join(means, "metric", "left")


def pair(baseline: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differences, accounts) of two runs in long form: pairs where both are defined; how many ids were dropped."""
    a = baseline.select("question_id", "metric", F.col("value").alias("before"))
    b = candidate.select("question_id", "metric", F.col("value").alias("after"))
    both = a.join(b, ["question_id", "metric"], "full")
    paired = F.col("before").isNotNull() & F.col("after").isNotNull()
    accounts = both.groupBy("metric").agg(F.count_if(paired).alias("n_pairs"), F.count_if(~paired).alias("n_dropped"))
    return both.filter(paired).select("metric", "question_id", (F.col("after") - F.col("before")).alias("value")), accounts


def paired_bootstrap(baseline: DataFrame, candidate: DataFrame, resamples: int = 10_000, salt: str = "20260906") -> DataFrame:
    """(metric, delta, ci_low, ci_high, n_pairs, n_dropped, significant): significant when the interval excludes 0."""
    differences, accounts = pair(baseline, candidate)
    made = accounts.join(bootstrap_interval(differences, resamples, salt=salt).withColumnRenamed("mean", "delta").drop("n"), "metric", "left")
    return made.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def paired_power(baseline: DataFrame, candidate: DataFrame, target: float = 0.02, z: float = 1.96) -> DataFrame:
    """(metric, n, sd, detectable, required_n): the effect that n pairs resolve, and the pairs a target effect needs."""
    differences, _ = pair(baseline, candidate)
    made = differences.groupBy("metric").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("sd")).filter("n >= 2")
    required = F.when(F.col("sd") == 0, 2).otherwise(F.floor(F.pow(z * F.col("sd") / target, 2)) + 1).cast("long")
    return made.select("metric", "n", "sd", (z * F.col("sd") / F.sqrt("n")).alias("detectable"), required.alias("required_n"))


def kappa(labels: DataFrame, categories: tuple[int, ...], weighting: str = "quadratic") -> DataFrame:
    """(metric, kappa, raw_agreement, n) of two raters; ``labels`` has metric, human, judge.

    Undefined (NULL) when chance alone explains everything. A label outside the categories is an error.
    """
    k = len(categories)
    place = F.create_map(*[x for i, c in enumerate(sorted(categories)) for x in (F.lit(c), F.lit(i))])
    known = lambda c: F.when(F.col(c).isin(*categories), place[F.col(c)]).otherwise(F.raise_error(F.concat(F.lit("label outside the categories: "), F.col(c).cast("string"))).cast("int"))
    cells = labels.select("metric", known("human").alias("i"), known("judge").alias("j")).groupBy("metric", "i", "j").agg(F.count("*").alias("n"))
    apart = F.abs(F.col("i") - F.col("j"))
    weight = {"unweighted": F.when(apart == 0, 0.0).otherwise(1.0), "linear": apart / max(1, k - 1), "quadratic": F.pow(apart / max(1, k - 1), F.lit(2.0))}[weighting]
    totals = cells.groupBy("metric").agg(F.sum("n").alias("total"), F.sum(weight * F.col("n")).alias("observed"), F.sum(F.when(apart == 0, F.col("n")).otherwise(0)).alias("agree"))
    rows = cells.groupBy("metric", "i").agg(F.sum("n").alias("r"))
    columns = cells.groupBy("metric", "j").agg(F.sum("n").alias("c"))
    expected = rows.join(columns, "metric").groupBy("metric").agg(F.sum(weight * F.col("r") * F.col("c")).alias("expected"))
    value = 1 - (F.col("observed") / F.col("total")) / F.nullif(F.col("expected") / (F.col("total") * F.col("total")), F.lit(0.0))
    return totals.join(expected, "metric").select("metric", (value if k > 1 else F.lit(None).cast("double")).alias("kappa"), (F.col("agree") / F.col("total")).alias("raw_agreement"), F.col("total").alias("n"))


# The names of the bands and the agreement a judge must reach.
BANDS = ((0.20, "poor"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial"))
KAPPA_GATE = 0.60


def kappa_band(value: Column) -> Column:
    bands = F.when(value < 0, "worse than chance")
    for limit, name in BANDS:
        bands = bands.when(value <= limit, name)
    return F.when(value.isNull(), "undefined").otherwise(bands.otherwise("almost perfect"))


def refusal_scores(answerable: Column, refused: Column) -> list[Column]:
    """Four scores, each NULL off its slice."""
    return [
        F.when(~answerable, refused.cast("double")).alias("correct_refusal"),
        F.when(~answerable, (~refused).cast("double")).alias("answered_unanswerable"),
        F.when(answerable, refused.cast("double")).alias("false_refusal"),
        F.when(answerable, (~refused).cast("double")).alias("answered"),
    ]


def citation_validity(cited: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, n_citations, n_resolvable, n_fabricated, fabrication_rate, uncited) of answers (key, answer, refused, citations).

    Resolvable citations are counted as often as they occur, fabricated ones once.
    """
    every = cited.select(key, F.explode(F.flatten(F.transform("citations", lambda c: c["chunk_ids"]))).alias("chunk_id"))
    judged = every.join(known.select("chunk_id", F.lit(True).alias("known")), "chunk_id", "left")
    counts = judged.groupBy(key).agg(F.count("*").alias("total"), F.count("known").alias("resolvable"), F.countDistinct(F.when(F.col("known").isNull(), F.col("chunk_id"))).alias("fabricated"))
    joined = cited.select(key, "answer", "refused").join(counts, key, "left").na.fill(0, ["total", "resolvable", "fabricated"])
    has_answer = (F.coalesce(F.trim("answer"), F.lit("")) != "") & ~F.coalesce("refused", F.lit(False))
    return joined.select(
        key,
        F.col("total").alias("n_citations"),
        F.col("resolvable").alias("n_resolvable"),
        F.col("fabricated").alias("n_fabricated"),
        F.when(F.col("total") > 0, (F.col("total") - F.col("resolvable")) / F.col("total")).alias("fabrication_rate"),
        (has_answer & (F.col("total") == 0)).alias("uncited"),
    )


# How far a metric may fall or rise before a run fails.
MAX_DROP = {"ndcg@10": 0.02, "recall@10": 0.02, "groundedness": 0.03, "answer_correctness": 0.03, "context_sufficiency": 0.03}
MAX_RISE = {"false_refusal": 0.05, "answered_unanswerable": 0.05, "latency_ms": 500.0}


def gate(baseline: DataFrame, candidate: DataFrame, judge_errors: int = 0) -> DataFrame:
    """(metric, before, after, verdict): PASS, FAIL, or SKIP where either run has no value; runs have metric and mean.

    Judgements that failed leave figures out, so any of them fails the run, in a row of its own.
    """
    spark = candidate.sparkSession
    limits = spark.createDataFrame([(m, -x) for m, x in MAX_DROP.items()] + list(MAX_RISE.items()) + [("citation_fabrication_rate", 0.0)], "metric string, limit double")
    joined = limits.join(baseline.select("metric", F.col("mean").alias("before")), "metric", "left").join(candidate.select("metric", F.col("mean").alias("after")), "metric", "left")
    delta = F.col("after") - F.col("before")
    absolute = F.col("metric") == "citation_fabrication_rate"
    fails = F.when(absolute, F.col("after") > F.col("limit")).when(F.col("limit") < 0, delta < F.col("limit")).otherwise(delta > F.col("limit"))
    errors = spark.createDataFrame([("judge_errors", None, float(judge_errors), "FAIL" if judge_errors else "PASS")], "metric string, before double, after double, verdict string")
    return joined.select("metric", "before", "after", F.when(F.when(absolute, F.col("after").isNull()).otherwise(delta.isNull()), "SKIP").when(fails, "FAIL").otherwise("PASS").alias("verdict")).unionByName(errors)


def select_questions(questions: DataFrame, types: list[str] | None = None, ids: list[str] | None = None, verified: bool | None = None, limit: int | None = None) -> DataFrame:
    """A part of a data set: of some types, then of some ids, then (un)verified, then the first ``limit`` by id."""
    if types is not None:
        questions = questions.filter(F.col("question_type").isin(*types))
    if ids is not None:
        questions = questions.filter(F.col("question_id").isin(*ids))
    if verified is not None:
        signed = F.col("verified_by").isNotNull() & F.col("verified_at").isNotNull()
        questions = questions.filter(signed if verified else ~signed)
    return questions if limit is None else questions.orderBy("question_id").limit(limit)


def problems(questions: DataFrame) -> DataFrame:
    """(question_id, problems) of the questions that break a rule of the data set."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    chunks, spans = F.coalesce(F.col("gold_chunks"), F.array()), F.coalesce(F.col("gold_spans"), F.array())
    n_chunks, n_spans = F.size(chunks), F.size(spans)
    kind = F.col("question_type")
    answerable_kind = ~kind.isin("unanswerable")
    rules = {
        "no id": blank("question_id"),
        "no question": blank("question"),
        "repeated gold chunk": F.size(F.array_distinct(F.transform(chunks, lambda g: g["chunk_id"]))) < n_chunks,
        "unanswerable with evidence": (kind == "unanswerable") & ((n_chunks > 0) | (n_spans > 0)),
        "unanswerable with answer": (kind == "unanswerable") & ~blank("gold_answer"),
        "no sufficient span": answerable_kind & (n_spans > 0) & ~F.exists(spans, lambda g: g["weight"] >= 1.0),
        "spans without answer": answerable_kind & (n_spans > 0) & blank("gold_answer"),
        "no sufficient chunk": answerable_kind & (n_spans <= 0) & (n_chunks > 0) & ~F.exists(chunks, lambda g: g["relevance"] >= 2),
        "chunks without answer": answerable_kind & (n_spans <= 0) & (n_chunks > 0) & blank("gold_answer"),
        "no evidence": answerable_kind & (kind != "ambiguous") & (n_spans <= 0) & (n_chunks <= 0),
        "ambiguous with answer": (kind == "ambiguous") & (n_spans <= 0) & (n_chunks <= 0) & ~blank("gold_answer"),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return questions.select("question_id", found.alias("problems")).filter(F.size("problems") > 0)


def stratified_sample(rows: DataFrame, n: int, salt: str = "0") -> DataFrame:
    """n rows: an equal share of each question_type, drawn by hash, topped up from the rest."""
    code = F.md5(F.concat_ws(":", F.lit(salt), F.col("question_id")))
    n_types = max(1, rows.select("question_type").distinct().count())
    share = max(1, n // n_types)
    placed = rows.withColumn("code", code).withColumn("place", F.row_number().over(Window.partitionBy("question_type").orderBy("code", "question_id")))
    first = (F.col("place") > share).cast("int")
    return placed.orderBy(first, "code", "question_id").limit(max(n, 0)).drop("code", "place") if share * n_types <= n else placed.filter(F.col("place") <= share).drop("code", "place")
