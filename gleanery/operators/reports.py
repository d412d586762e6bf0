"""Results as tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics of which less is better, and how many questions of each kind a full set has.
LOWER_IS_BETTER = ("answered_unanswerable", "false_refusal", "citation_fabrication_rate", "latency_ms")
TARGETS = {"single_hop": 55, "numeric_table": 40, "multi_hop": 35, "comparative_temporal": 25, "unanswerable": 30, "ambiguous": 20, "adversarial": 15}


def number(value: Column, digits: int = 4) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_number(value, digits))


def run_lines(aggregates: DataFrame) -> DataFrame:
    """(metric, line): the mean over all questions, how many are scored and how many undefined."""
    line = F.concat(F.rpad("metric", 24, " "), F.lpad(number(F.col("mean")), 10, " "), F.lit("  n="), F.col("n").cast("string"), F.lit("  undefined="), F.col("n_undefined").cast("string"))
    return aggregates.filter("question_type = '(all)'").select("metric", line.alias("line"))


def slice_table(aggregates: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each slice, a column for each metric."""
    return aggregates.filter(F.col("metric").isin(metrics)).groupBy("question_type").pivot("metric", metrics).agg(F.round(F.first("mean"), 4))


def comparison(paired: DataFrame, *keys: str) -> DataFrame:
    """(metric, delta, verdict) of a paired bootstrap: better, worse, or inconclusive where the interval holds 0."""
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    return paired.select(*keys, "metric", "delta", "ci_low", "ci_high", "n_pairs", F.when(F.col("delta").isNull(), "no pairs").when(~F.col("significant"), "inconclusive").when(better, "better").otherwise("worse").alias("verdict"))


def composition(counts: DataFrame) -> DataFrame:
    """(question_type, n, target, gap): every kind, also those without a question."""
    targets = counts.sparkSession.createDataFrame(list(TARGETS.items()), "question_type string, target long")
    joined = targets.join(counts.select("question_type", "n"), "question_type", "left").na.fill(0, ["n"])
    return joined.select("question_type", "n", "target", (F.col("n") - F.col("target")).alias("gap"))


def curve_lines(points: DataFrame, ceiling: float = 0.05) -> DataFrame:
    """(threshold, line): the refusal curve with the points allowed by the ceiling marked."""
    mark = F.when(F.col("degenerate"), " ").when(F.col("false_rate") <= ceiling, "*").otherwise(" ")
    line = F.concat(mark, F.lpad(number(F.col("threshold")), 10, " "), F.lpad(number(F.col("correct_rate")), 10, " "), F.lpad(number(F.col("false_rate")), 10, " "), F.lpad(number(F.col("youden_j")), 10, " "))
    return points.select("threshold", line.alias("line"))


def ladder(runs: DataFrame) -> DataFrame:
    """(step, label, metric, mean, change): each rung against the one before; runs have step, label, metric, mean."""
    from pyspark.sql import Window

    before = F.lag("mean").over(Window.partitionBy("metric").orderBy("step"))
    return runs.select("step", "label", "metric", F.round("mean", 4).alias("mean"), F.round(F.col("mean") - before, 4).alias("change"))


def ladder_paired(scores: DataFrame, resamples: int = 10_000) -> DataFrame:
    """ladder() of the scores of runs (step, label, question_id, metric, value), each rung held against the one before by
    a paired bootstrap: (step, label, metric, mean, change, ci_low, ci_high, verdict)."""
    from gleanery.operators import evaluation

    rungs = ladder(scores.groupBy("step", "label", "metric").agg(F.avg("value").alias("mean")))
    # a pair of rungs is a metric of its own, so one bootstrap serves all of them
    named = lambda step: F.concat(step.cast("string"), F.lit("|"), F.col("metric"))
    before = scores.select("question_id", named(F.col("step") + 1).alias("metric"), "value")
    after = scores.filter("step > 0").select("question_id", named(F.col("step")).alias("metric"), "value")
    steps = after.select("metric").distinct()
    paired = evaluation.paired_bootstrap(before.join(F.broadcast(steps), "metric", "left_semi"), after, resamples)
    parts = F.split("metric", "[|]", 2)
    held = comparison(paired.withColumns({"step": parts[0].cast("int"), "metric": parts[1]}), "step").select("step", "metric", F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"), "verdict")
    return rungs.join(held, ["step", "metric"], "left").select("step", "label", "metric", "mean", "change", "ci_low", "ci_high", "verdict")


def expected(actual: DataFrame, stated: DataFrame) -> DataFrame:
    """(name, stated, actual, ok): figures derived again against the stated ones within their tolerance."""
    joined = stated.join(actual, "name", "left")
    return joined.select("name", "stated", "actual", F.coalesce(F.abs(F.col("actual") - F.col("stated")) <= F.col("tolerance"), F.lit(False)).alias("ok"))


def markdown(table: DataFrame, order: Column) -> DataFrame:
    """(line_no, line): a table as Markdown, its rows by ``order``; for reports, so small by nature."""
    from pyspark.sql import Window

    spark = table.sparkSession
    cells = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in table.columns)), " | "), F.lit(" |"))
    head = spark.createDataFrame([(0, "| " + " | ".join(table.columns) + " |"), (1, "|" + "---|" * len(table.columns))], "line_no int, line string")
    return head.unionByName(table.select((F.row_number().over(Window.orderBy(order)) + 1).alias("line_no"), cells.alias("line")))


RUN = "run_id string, label string, config string, dataset string, warnings array<string>, question_id string, metric string, value double"


def run_rows(run, config, dataset: str) -> DataFrame:
    """A run as rows to store: every score with the run's identity, configuration, digest of its data set and warnings."""
    import json
    from dataclasses import asdict

    about = {"run_id": F.lit(run.run_id), "label": F.lit(run.label), "config": F.lit(json.dumps(asdict(config), sort_keys=True)), "dataset": F.lit(dataset), "warnings": F.array(*map(F.lit, run.warnings)).cast("array<string>")}
    return run.scores.select(*(c.alias(name) for name, c in about.items()), "question_id", "metric", "value")


def read_run(spark, path: str) -> DataFrame:
    """A stored run; columns that this version does not know are ignored, those it lacks are NULL."""
    return spark.read.schema(RUN).parquet(path)


def require_same_dataset(baseline: DataFrame, candidate: DataFrame) -> None:
    """Two runs are compared only over one data set."""
    a, b = ({r.dataset for r in run.select("dataset").distinct().limit(2).collect()} for run in (baseline, candidate))
    if a != b or len(a) > 1:
        raise ValueError(f"runs over different data sets: {sorted(map(str, a))} and {sorted(map(str, b))}")


def load_runs(spark, folders: list[str]) -> tuple[DataFrame | None, list[str]]:
    """(scores of the runs stored in the folders, folders that hold no run)."""
    runs, bad = None, []
    for step, folder in enumerate(folders):
        try:
            part = spark.read.parquet(folder).select(F.lit(step).alias("step"), F.lit(folder).alias("label"), "question_id", "metric", "value")
        except Exception:  # noqa: BLE001 - whatever is wrong with a stored run, the others are still of use
            bad.append(folder)
            continue
        runs = part if runs is None else runs.unionByName(part)
    return runs, bad


def ladder_of(runs: DataFrame) -> DataFrame:
    """ladder() of stored runs."""
    return ladder(runs.groupBy("step", "label", "metric").agg(F.avg("value").alias("mean")))
