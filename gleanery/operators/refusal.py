"""Signals of confidence, refusal at a threshold, and the choice of the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import checkpointed


def confidence(hits: DataFrame) -> DataFrame:
    """(query_id, n_hits, top_score, mean_score, margin); the margin of a lone hit is its score."""
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    rest = F.avg(F.when(F.col("rank") > 1, F.col("score")))
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), top.alias("top_score"), F.avg("score").alias("mean_score"), F.coalesce(top - rest, top).alias("margin"))


def refused(signals: DataFrame, signal: str, threshold: float) -> DataFrame:
    """Adds ``refused``: no hits, or a signal below the threshold."""
    return signals.withColumn("refused", (F.coalesce("n_hits", F.lit(0)) == 0) | (F.col(signal) < threshold))


BINS = 256


def curve(observations: DataFrame) -> DataFrame:
    """Counts and rates at every threshold between two neighbouring confidences and beyond both ends.

    ``observations`` has confidence and answerable. They are counted by confidence first; running sums over the
    distinct values then give all thresholds, so no threshold meets an observation again. The sums run within BINS
    ranges of confidence and over the at most BINS totals of these.
    """
    counts = checkpointed(observations.groupBy("confidence").agg(F.count_if(~F.col("answerable")).alias("un"), F.count_if("answerable").alias("an")))
    whole = counts.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"), F.sum("un").alias("n_un"), F.sum("an").alias("n_an"))
    width = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    binned = counts.crossJoin(F.broadcast(whole)).withColumn("width", width).withColumn("bin", F.least(F.floor((F.col("confidence") - F.col("lo")) / F.col("width") * BINS), F.lit(BINS - 1)).cast("int"))
    bins = binned.groupBy("bin").agg(F.sum("un").alias("bin_un"), F.sum("an").alias("bin_an"), F.max("confidence").alias("bin_hi"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("bin_un").over(before), F.lit(0)).alias("un_before"), F.coalesce(F.sum("bin_an").over(before), F.lit(0)).alias("an_before"), F.lag("bin_hi").over(Window.orderBy("bin")).alias("hi_before"))
    order = Window.partitionBy("bin").orderBy("confidence")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = binned.join(F.broadcast(bins), "bin").select(
        "confidence", "un", "an", "n_un", "n_an", "width", "hi",
        F.coalesce(F.lag("confidence").over(order), F.col("hi_before")).alias("before"),
        (F.sum("un").over(upto) + F.col("un_before")).alias("un_upto"),
        (F.sum("an").over(upto) + F.col("an_before")).alias("an_upto"),
    )
    below = F.struct(F.coalesce((F.col("before") + F.col("confidence")) / 2, F.col("confidence") - 0.01 * F.col("width")).alias("threshold"), (F.col("un_upto") - F.col("un")).alias("c"), (F.col("an_upto") - F.col("an")).alias("f"))
    above = F.struct((F.col("confidence") + 0.01 * F.col("width")).alias("threshold"), F.col("un_upto").alias("c"), F.col("an_upto").alias("f"))
    points = sums.select("n_un", "n_an", F.explode(F.when(F.col("confidence") == F.col("hi"), F.array(below, above)).otherwise(F.array(below))).alias("p"))
    correct, false = F.try_divide("p.c", "n_un"), F.try_divide("p.f", "n_an")
    return points.select(
        F.round("p.threshold", 9).alias("threshold"),
        F.col("p.c").alias("correct_refusals"),
        F.col("p.f").alias("false_refusals"),
        correct.alias("correct_rate"),
        false.alias("false_rate"),
        (correct - false).alias("youden_j"),
        (F.col("p.c") == 0).alias("degenerate"),
    )


def operating_point(points: DataFrame, ceiling: float = 0.05, require_useful: bool = True) -> DataFrame:
    """The point of the highest correct rate within the ceiling of false refusals; the lower threshold wins a tie."""
    allowed = points.filter(F.col("false_rate") <= ceiling)
    if require_useful:
        allowed = allowed.filter(~F.col("degenerate"))
    return allowed.orderBy(F.col("correct_rate").desc(), "threshold").limit(1)
