"""Problem 6: percentiles per group and day of very large numeric columns.

Method: radix selection. Each value is mapped to a 64-bit integer of the same order (the bits of the double, with the
lower 63 flipped for negative ones). A pass counts the values of each cell by their next DIGIT_BITS bits; the digit
that holds each target rank is followed, and the next pass looks at values with that prefix alone. After all passes
the percentile is exact: the value of rank ceil(p / 100 * n), so the error is none.

The counts of a pass are a summary that can be added up: histograms() of separate days or partitions, summed by
merge(), give percentiles() of the whole, with a relative error of at most 2^-(bits - 12) of the value (bits include
the sign and the 11 of the exponent) and no error in the bucket's rank.

Scale: counting combines before the shuffle, so a hot group costs a row for each digit and task. Target prefixes, at
most one for each cell and percentile, are broadcast when their count is within BROADCAST_TARGETS; beyond that the
join is salted. The one shuffle of rows removes repeated ids.

Defined results: null, NaN and negative values, and rows with a null id, group or day, do not count; a cell without
values has no percentile; a repeated id counts once in its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import checkpointed

DIGIT_BITS = 16
CELL = ["metric", "group_name", "day_utc"]
BROADCAST_TARGETS = 500_000
SALTS = 64
_LOW63 = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as signed integers of the same order; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _LOW63, bits)


def from_ordered_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ _LOW63, bits).view(np.float64)


def _to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = ordered_bits(batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(bits)], names=["id", *CELL, "bits"])


def _to_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = from_ordered_bits(batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(values)], names=[*CELL, "quantile_pct", "n", "value"])


def measurements(df: DataFrame, metric: str, id_col: str, group_col: str, time_col: str, value: str) -> DataFrame:
    """(metric, group_name, day_utc, bits) of the values that count, one for each id."""
    rows = df.select(
        F.col(id_col).cast("string").alias("id"),
        F.lit(metric).alias("metric"),
        F.col(group_col).alias("group_name"),
        F.date_format(F.col(time_col), "yyyy-MM-dd").alias("day_utc"),
        F.col(value).cast("double").alias("value"),
    ).filter("id is not null and group_name is not null and day_utc is not null and value >= 0 and not isnan(value)")
    bits = rows.mapInArrow(_to_bits, "id string, metric string, group_name string, day_utc string, bits long")
    return bits.groupBy("id", *CELL).agg(F.min("bits").alias("bits")).drop("id")


def histograms(rows: DataFrame, bits: int = 24) -> DataFrame:
    """(metric, group_name, day_utc, prefix, n): counts by the leading bits, a summary that can be added up."""
    return rows.groupBy(*CELL, F.shiftright("bits", 64 - bits).alias("prefix")).agg(F.count("*").alias("n"))


def merge(*summaries: DataFrame) -> DataFrame:
    """The summary of several summaries of equal bits."""
    union = summaries[0]
    for s in summaries[1:]:
        union = union.unionByName(s)
    return union.groupBy(*CELL, "prefix").agg(F.sum("n").alias("n"))


def _follow(counts: DataFrame, targets: DataFrame, within: list[str]) -> DataFrame:
    """The digit that holds each target's rank, and the rank left inside it. counts: within, prefix, n."""
    order = Window.partitionBy(*within).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(order))
    hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
    return targets.join(upto, within).filter(hit).select(*CELL, "quantile_pct", "total", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "prefix")


def _ranks(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    totals = counts.groupBy(*CELL).agg(F.sum("n").alias("total"))
    return totals.join(wanted, ["metric", "group_name"]).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("quantile_pct") * F.col("total") / 100)).cast("long"))


def percentiles(summary: DataFrame, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """(metric, group_name, day_utc, quantile_pct, n, value) from a summary: the middle of the bucket that holds the rank."""
    found = _follow(summary, _ranks(summary, wanted), CELL)
    middle = F.shiftleft("prefix", 64 - bits) + F.lit(1 << (63 - bits))
    return _named(found.withColumn("prefix", middle))


def _named(found: DataFrame) -> DataFrame:
    return found.select(*CELL, "quantile_pct", F.col("total").alias("n"), "prefix").mapInArrow(_to_values, "metric string, group_name string, day_utc string, quantile_pct int, n long, value double")


def _with_prefix(rows: DataFrame, prefixes: DataFrame, shift: int) -> DataFrame:
    """The rows of which a cell follows the prefix."""
    rows = rows.withColumn("at", F.shiftright("bits", shift))
    keys = [*CELL, "at"]
    if prefixes.count() <= BROADCAST_TARGETS:
        return rows.join(F.broadcast(prefixes), keys, "left_semi")
    salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left_semi").drop("salt")


def select_percentiles(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(metric, group_name, day_utc, quantile_pct, n, value): the exact percentile of every cell.

    ``rows`` comes from measurements(); ``wanted`` has metric, group_name and quantile_pct.
    """
    rows = checkpointed(rows)
    wanted = wanted.select("metric", "group_name", F.col("quantile_pct").cast("int").alias("quantile_pct")).distinct()
    counts = checkpointed(histograms(rows, DIGIT_BITS))
    targets = checkpointed(_follow(counts, _ranks(counts, wanted), CELL))
    for shift in range(64 - 2 * DIGIT_BITS, -1, -DIGIT_BITS):
        targets = targets.withColumnRenamed("prefix", "at")
        kept = _with_prefix(rows, targets.select(*CELL, "at").distinct(), shift + DIGIT_BITS)
        counts = kept.groupBy(*CELL, "at", F.shiftright("bits", shift).alias("prefix")).agg(F.count("*").alias("n"))
        targets = checkpointed(_follow(counts, targets, [*CELL, "at"]))
    return _named(targets)
