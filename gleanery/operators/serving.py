"""Telemetry, caching and circuit breaking as batch views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATENCY_RING, CACHE_THRESHOLD, CACHE_TTL, CACHE_CAPACITY = 2000, 0.95, 3600.0, 1000
BREAKER_FAILURES, BREAKER_RECOVERY = 5, 30.0


def valid_duration(c: Column) -> Column:
    return (c >= 0) & ~F.isnan(c)


POINTS = (0.5, 0.95, 0.99)


def latency_report(spans: DataFrame, *keys: str, points: tuple[float, ...] = POINTS) -> DataFrame:
    """Count, mean, percentiles and maximum of the valid durations.

    Exact, with linear interpolation, and without a buffer of values: durations of a group are counted in buckets of a
    64th of their power of two first; only those of the at most two buckets around a rank are then counted by value.
    What a task holds is bounded by the buckets and by the distinct values in two of them.
    """
    d = F.col("duration_ms")
    valid = spans.filter(valid_duration(d)).select(*keys, "duration_ms")
    exponent = F.when(d > 0, F.floor(F.log2("duration_ms"))).otherwise(-1075)
    bucket = F.when(d > 0, exponent * 64 + F.least(F.floor((d / F.pow(F.lit(2.0), exponent) - 1) * 64), F.lit(63))).otherwise(-100_000).cast("long")
    placed = valid.withColumn("bucket", bucket)
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = placed.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(by)}).withColumn("below", F.col("upto") - F.col("n"))
    spots = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("total") - 1)).alias("spot")) for k, p in enumerate(points)])
    near = ranked.withColumn("s", F.explode(spots)).filter((F.col("upto") > F.floor("s.spot")) & (F.col("below") <= F.ceil("s.spot")))
    wanted = near.select(*keys, "bucket", "below", F.col("s.k").alias("k"), F.col("s.spot").alias("spot"))
    values = placed.groupBy(*keys, "bucket", "duration_ms").agg(F.count("*").alias("m"))
    buckets = wanted.select(*keys, "bucket", "below").distinct()
    same = [*(F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), F.col("v.bucket") == F.col("b.bucket")]
    joined = values.alias("v").join(buckets.alias("b"), _all(same)).select(*(F.col(f"v.{k}").alias(k) for k in keys), F.col("v.bucket").alias("bucket"), "duration_ms", "m", "below")
    inside = Window.partitionBy(*keys, "bucket").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    steps = joined.withColumn("last", F.sum("m").over(inside) + F.col("below") - 1).withColumn("first", F.col("last") - F.col("m") + 1)
    same = [*(F.col(f"v.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys), F.col("v.bucket") == F.col("w.bucket")]
    met = steps.alias("v").join(wanted.alias("w"), _all(same)).select(*(F.col(f"v.{k}").alias(k) for k in keys), "k", "spot", "duration_ms", "first", "last")
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("duration_ms")))
    found = met.groupBy(*keys, "k", "spot").agg(at(F.floor("spot")).alias("lo"), at(F.ceil("spot")).alias("hi"))
    point = found.withColumn("p", F.col("lo") + (F.col("spot") - F.floor("spot")) * (F.col("hi") - F.col("lo")))
    names = [f"p{p * 100:g}" for p in points]
    wide = point.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(name) for k, name in enumerate(names)])
    whole = valid.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"))
    if not keys:
        return whole.crossJoin(wide).select("n", "mean_ms", *names, "max_ms").filter("n > 0")
    both = whole.alias("a").join(wide.alias("c"), _all([F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]))
    return both.select(*(F.col(f"a.{k}").alias(k) for k in keys), "n", "mean_ms", *names, "max_ms")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def health(corpus: DataFrame, entries: DataFrame, started: float, now: float) -> DataFrame:
    """One row: status, n_chunks, n_cached, uptime_s; without a chunk the service is not ready."""
    n = corpus.agg(F.count("*").alias("n_chunks")).crossJoin(F.broadcast(entries.agg(F.count("*").alias("n_cached"))))
    return n.select(F.when(F.col("n_chunks") > 0, "ok").otherwise("not ready").alias("status"), "n_chunks", "n_cached", F.lit(float(now - started)).alias("uptime_s"))


def ramp(answer, questions: list[str], levels: tuple[int, ...] = (1, 2, 4, 8, 16, 32), requests: int = 200, clock=None) -> list[dict]:
    """A load test of a callable on the driver: for each number of workers the latencies, throughput and errors of
    ``requests`` requests that go through the questions in turn."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    if not questions or requests < 1:
        raise ValueError("a load test needs questions and at least one request")
    clock = clock or time.perf_counter
    out = []

    def one(k: int) -> tuple[float, bool]:
        began = clock()
        try:
            answer(questions[k % len(questions)])
            return (clock() - began) * 1000, True
        except Exception:  # noqa: BLE001 - a failed request is a figure of the test
            return (clock() - began) * 1000, False

    for workers in levels:
        began = clock()
        with ThreadPoolExecutor(workers) as pool:
            done = list(pool.map(one, range(requests)))
        spent, ms = clock() - began, sorted(t for t, _ in done)
        spot = lambda p: ms[min(len(ms) - 1, int(p * (len(ms) - 1) + 0.5))]  # noqa: B023, E731
        out.append({"workers": workers, "requests": requests, "errors": sum(not ok for _, ok in done), "p50_ms": spot(0.5), "p95_ms": spot(0.95), "p99_ms": spot(0.99), "max_ms": ms[-1], "per_second": requests / spent if spent > 0 else None})
    return out


def latest(spans: DataFrame, key: str, time: str, unique: str, n: int = LATENCY_RING) -> DataFrame:
    """The last n rows of each key."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(unique).desc())
    return spans.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")


def failure_runs(events: DataFrame, component: str, time: str, unique: str, failed: Column, threshold: int = BREAKER_FAILURES) -> DataFrame:
    """(component, n, n_failed, longest_run, n_runs_at_threshold): runs of failures between successes.

    Runs are found within hours and joined over their borders, so no task holds a whole component.
    """
    rows = events.select(F.col(component).alias("component"), F.date_trunc("hour", F.col(time)).alias("period"), F.col(time).alias("at"), F.col(unique).alias("tie"), failed.cast("int").alias("failed"))
    within = Window.partitionBy("component", "period").orderBy("at", "tie")
    islands = rows.withColumn("island", F.sum(1 - F.col("failed")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("component", "period", "island").agg(F.sum("failed").alias("run"), F.count("*").alias("n"))
    # island 0 touches the start of the hour, the last island its end; they may be one
    periods = runs.groupBy("component", "period").agg(F.max("island").alias("last"), F.sum("n").alias("n"), F.sum("run").alias("n_failed"))
    # a run goes on into an hour whose first island it touches: number the chains of such hours
    touching = runs.join(periods.select("component", "period", "last"), ["component", "period"])
    order = Window.partitionBy("component").orderBy("period")
    ends = touching.groupBy("component", "period").agg(F.sum(F.when(F.col("island") == 0, F.col("run")).otherwise(0)).alias("head"), F.sum(F.when(F.col("island") == F.col("last"), F.col("run")).otherwise(0)).alias("tail"), F.max("last").alias("last"))
    breaks = ends.withColumn("chain", F.sum(F.when(F.col("last") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the tail of an hour and the heads of the hours up to and including the next one with a success form one run
    tails = breaks.select("component", F.col("chain"), F.col("tail").alias("run"))
    heads = breaks.filter("last > 0").select("component", (F.col("chain") - 1).alias("chain"), F.col("head").alias("run"))
    across = tails.unionByName(heads).groupBy("component", "chain").agg(F.sum("run").alias("run")).select("component", "run")
    inner = touching.filter((F.col("island") > 0) & (F.col("island") < F.col("last"))).select("component", "run")
    every = inner.unionByName(across).groupBy("component").agg(F.max("run").alias("longest_run"), F.count_if(F.col("run") >= threshold).alias("n_runs_at_threshold"))
    totals = periods.groupBy("component").agg(F.sum("n").alias("n"), F.sum("n_failed").alias("n_failed"))
    return totals.join(every, "component")


def cache_lookup(queries: DataFrame, entries: DataFrame, now: float, version: str, threshold: float = CACHE_THRESHOLD, ttl: float = CACHE_TTL) -> DataFrame:
    """(query_id, entry_id, similarity): the best live entry of each query, NULL where none is near enough.

    ``entries`` has entry_id, vector, created_at, corpus_version; expired ones and those of another corpus are dead.
    """
    from gleanery.operators.retrieval import dense

    live = entries.filter((F.lit(now) - F.col("created_at") <= ttl) & (F.col("corpus_version") == version))
    best = dense(live.select(F.col("entry_id").alias("chunk_id"), "vector"), queries, 1).filter(F.col("score") >= threshold)
    return queries.select("query_id").join(best.select("query_id", F.col("chunk_id").alias("entry_id"), F.col("score").alias("similarity")), "query_id", "left")


def cache_put(entries: DataFrame, new: DataFrame, capacity: int = CACHE_CAPACITY) -> DataFrame:
    """Entries after adding new ones without an error; those with fewest hits, then the oldest, make room, the greater
    first column first among equals."""
    union = entries.unionByName(new.filter("error is null").select(*entries.columns))
    return union.orderBy(F.col("hits").desc(), F.col("created_at").desc(), F.col(entries.columns[0])).limit(capacity)


def cache_invalidate(entries: DataFrame, key: str, changed: DataFrame) -> DataFrame:
    """Entries that use none of the changed chunks."""
    used = entries.select(key, F.explode("chunk_ids").alias("chunk_id"))
    stale = used.join(changed.select("chunk_id"), "chunk_id", "left_semi").select(key).distinct()
    return entries.join(stale, key, "left_anti")


def event_stream(answers: DataFrame, key: str) -> DataFrame:
    """(key, seq, event, data): trace, passages, then error, refusal or tokens of 48 characters, then done."""
    from gleanery.functions.text import fixed_width_parts

    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    tokens = F.transform(fixed_width_parts(F.coalesce("answer", F.lit(""))), lambda t: event("token", t))
    n_cited = F.size(F.flatten(F.transform("citations", lambda c: c["chunk_ids"])))
    body = F.when(F.col("error").isNotNull(), F.array(event("error", F.col("error")))).when(F.col("refused"), F.array(event("refusal", F.lit("")))).otherwise(tokens)
    events = F.concat(F.array(event("trace", F.col(key)), event("passages", F.greatest(n_cited, F.lit(0)).cast("string"))), body, F.array(event("done", F.lit(""))))
    return answers.select(key, F.posexplode(events).alias("seq", "e")).select(key, "seq", "e.event", "e.data")


def prometheus(metrics: DataFrame, prefix: str = "gleanery") -> DataFrame:
    """One row: the text exposition of (name, kind, value) rows."""
    line = F.format_string(f"# TYPE {prefix}_%s %s\n{prefix}_%s %s", F.translate("name", ".", "_"), F.col("kind"), F.translate("name", ".", "_"), F.col("value").cast("string"))
    return metrics.select("name", line.alias("line")).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda r: r["line"]), "\n"), F.lit("\n")).alias("exposition"))


def degrade(primary: Column, fallback: Column, healthy: Column, required: bool = False) -> tuple[Column, Column]:
    """(value, degraded): the primary while its breaker is closed and it gave something, else the fallback; a required
    stage without either is an error."""
    value = F.when(healthy & primary.isNotNull(), primary).otherwise(fallback)
    if required:
        value = F.coalesce(value, F.raise_error(F.lit("a required stage is unavailable")).cast("string"))
    return value, ~(healthy & primary.isNotNull())


def cache_key(question: Column, history: Column, roles: Column) -> Column:
    """What must be equal for two requests to share an answer: question, history and the sorted roles."""
    said = F.array_join(F.transform(F.coalesce(history, F.array().cast("array<struct<question:string,answer:string>>")), lambda h: F.concat_ws("\0", h["question"], h["answer"])), "\0")
    return F.concat_ws("\0", question, said, F.array_join(F.array_sort(F.array_distinct(F.coalesce(roles, F.array().cast("array<string>")))), "\0"))


def invalid_requests(requests: DataFrame) -> DataFrame:
    """(request_id, problems) of requests outside the limits of the service."""
    rules = {
        "question length": ~F.coalesce(F.length("question"), F.lit(0)).between(1, 2000),
        "history length": F.coalesce(F.size("history"), F.lit(0)) > 20,
        "top_k": ~F.coalesce("top_k", F.lit(5)).between(1, 50),
        "roles": F.coalesce(F.size("roles"), F.lit(0)) > 20,
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return requests.select("request_id", found.alias("problems")).filter(F.size("problems") > 0)


def serve(requests: DataFrame, entries: DataFrame, answer, now: float) -> tuple[DataFrame, DataFrame]:
    """(responses, entries to add) of a batch of requests (request_id, question, history, roles).

    Requests of an equal key share an answer; a key that the cache (key, answer, error, created_at) knows and that has
    not expired is not computed again; ``answer`` maps (key, question, history) to (key, answer, error). Answers with
    an error are not kept. A stream calls this in foreachBatch.
    """
    keyed = requests.withColumn("key", cache_key(F.col("question"), F.col("history"), F.col("roles")))
    live = entries.filter(F.lit(now) - F.col("created_at") <= CACHE_TTL).groupBy("key").agg(F.max_by(F.struct("answer", "error"), "created_at").alias("hit"))
    known = keyed.join(live, "key", "left")
    missing = known.filter("hit is null").groupBy("key").agg(F.first(F.struct("question", "history")).alias("r")).select("key", "r.question", "r.history")
    made = answer(missing).select("key", F.struct("answer", "error").alias("made"))
    responses = known.join(made, "key", "left").select("request_id", F.col("hit").isNotNull().alias("cache_hit"), F.coalesce("hit", "made").alias("r")).select("request_id", "cache_hit", "r.answer", "r.error")
    fresh = made.filter("made.error is null").select("key", "made.answer", "made.error", F.lit(now).alias("created_at"))
    return responses, fresh
