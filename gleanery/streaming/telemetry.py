"""Streaming twins of the telemetry operators, for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery.operators.serving import BREAKER_FAILURES, BREAKER_RECOVERY

SPAN = "span_id bigint, trace_id string, span_name string, subject string, started_at timestamp_ntz, ended_at timestamp_ntz, duration_ms double, attributes string, error string, received_at timestamp_ntz"


def read_spans(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Spans as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(SPAN).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly(spans: DataFrame, late: str = "14 days") -> DataFrame:
    """Spans, errors and time by stage and hour; a span that comes twice counts once, one later than ``late`` is dropped."""
    timed = spans.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", late)
    unique = timed.dropDuplicatesWithinWatermark(["span_id"])
    d = F.col("duration_ms")
    made = unique.groupBy(F.window("at", "1 hour").alias("w"), "span_name").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"), F.round(F.sum(F.when((d >= 0) & ~F.isnan(d), d)), 3).alias("total_ms"))
    return made.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "span_name", "n", "n_errors", "total_ms")


BREAKER = "component string, tie bigint, admitted string, state string, failures int, trips int"
BREAKER_STATE = "state string, failures int, opened double, trips int"


def step(state: tuple[str, int, float, int], at: float, failed: bool, failures: int, recovery: float) -> tuple[str, int, float, int]:
    """The breaker's state (name, failures in a row, time of opening, trips) after one request.

    An open circuit takes no calls: until ``recovery`` seconds have passed a request changes nothing. The first one
    after that is the probe of a half-open circuit: a success closes it, a failure opens it again at once.
    """
    name, row, opened, trips = state
    if name == "open":
        if at - opened < recovery:
            return state
        return ("open", row + 1, at, trips + 1) if failed else ("closed", 0, opened, trips)
    if not failed:
        return "closed", 0, opened, trips
    return ("open", row + 1, at, trips + 1) if row + 1 >= failures else ("closed", row + 1, opened, trips)


def admitted(state: tuple[str, int, float, int], at: float, recovery: float) -> str:
    """What the circuit does with a request: "call", "probe" (half-open) or "reject"."""
    return "call" if state[0] == "closed" else "probe" if at - state[2] >= recovery else "reject"


def breaker(outcomes: DataFrame, failures: int = BREAKER_FAILURES, recovery: float = BREAKER_RECOVERY) -> DataFrame:
    """(component, tie, admitted, state, failures, trips) after every request (component, at in seconds, tie, failed).

    ``failures`` in a row open the circuit; while it is open no request is let through or counted; after ``recovery``
    seconds one probe is, which closes it or opens it again at once. Outcomes are taken in the order of their time within a micro-batch, so the size
    of a micro-batch bounds what a task holds.
    """
    if failures < 1 or recovery <= 0:
        raise ValueError("failures must be at least 1 and recovery positive")

    def follow(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = kept.get if kept.exists else ("closed", 0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "tie"])
        out = []
        for at, tie, failed in zip(rows["at"], rows["tie"], rows["failed"]):
            what = admitted(state, float(at), recovery)
            state = step(state, float(at), bool(failed), failures, recovery)
            out.append((key[0], int(tie), what, state[0], state[1], state[3]))
        kept.update(state)
        yield pd.DataFrame(out, columns=["component", "tie", "admitted", "state", "failures", "trips"])

    return outcomes.groupBy("component").applyInPandasWithState(follow, BREAKER, BREAKER_STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Everything that has arrived so far, through tables in a shared folder: the last state of a complete stream, all
    rows of an appending one. Each micro-batch overwrites its own table, so a batch that runs again changes nothing.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'last' if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
