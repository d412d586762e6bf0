"""Queries that run a stream over everything that has arrived and give what it made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.plans.registry import SPANS_SQL, query
from gleanery.plans.serve import VALID_SQL
from gleanery.session import shared_folder, tune
from gleanery.streaming import telemetry


LATE = 1  # days


@query(
    f"""select date_trunc('hour', started_at) as hour, span_name, cast(count(*) as bigint) as n, cast(count("error") as bigint) as n_errors, round(sum(case when {VALID_SQL} then duration_ms end), 3) as total_ms from {SPANS_SQL}
 where date_trunc('hour', started_at) + interval 1 hour <= (select max(started_at) from trace_spans) - interval {LATE} days group by all"""
)
def stream_hourly_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming twin of serve_hourly: hours that the watermark has passed, each given once; duplicates dropped."""
    spans = tune(spark).readStream.schema(telemetry.SPAN).parquet(f"{sf_dir}/trace_spans.parquet*")
    return telemetry.run_once(telemetry.hourly(spans, late=f"{LATE} days"), "append", shared_folder(spark, "hourly"))


@query()
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circuit breaker for each stage: how often it opened, and the requests that it turned away or let through as probes."""
    spans = tune(spark).readStream.schema(telemetry.SPAN).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/trace_spans.parquet*")
    outcomes = spans.select(F.col("span_name").alias("component"), F.col("started_at").cast("timestamp").cast("double").alias("at"), F.col("span_id").alias("tie"), F.col("error").isNotNull().alias("failed"))
    states = telemetry.run_once(telemetry.breaker(outcomes, failures=3), "append", shared_folder(spark, "breaker"))
    return states.groupBy("component").agg(F.max("trips").alias("trips"), F.count_if(F.col("admitted") == "reject").alias("n_rejected"), F.count_if(F.col("admitted") == "probe").alias("n_probes"))
