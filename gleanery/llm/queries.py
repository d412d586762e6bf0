"""The queries of the llm operators: name -> function of (spark, data directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import contamination, markup_blocks, near_duplicates, packing, radix_percentiles, splitting, term_weights, textform, truncation
from gleanery.operators.repeats import settled
from gleanery.session import checkpointed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, id, text) of documents and chunks."""
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("id"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("id"), "text")
    return documents.unionByName(chunks)


# ---- problem 1


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.NearDuplicates(text_records(spark, sf_dir), threshold=0.6, run_size=4).record_pairs()


@query
def p1_record_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and number of links of every record, at the similarity and run size used for training data."""
    return near_duplicates.NearDuplicates(text_records(spark, sf_dir), threshold=0.8, run_size=5).record_classes()


# ---- problem 3


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [
        textform.form_keys(table(spark, sf_dir, name), id_col, "text").withColumn("table_name", F.lit(name))
        for name, id_col in (("documents", "doc_id"), ("chunks", "chunk_id"))
    ]
    return textform.look_alike_pairs(checkpointed(keys[0].unionByName(keys[1]))).select("table_name", "id_a", "id_b")


@query
def p3_consistent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents and chunks in the consistent form."""
    documents = textform.consistent_texts(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.lit("documents").alias("table_name"), F.col("id").cast("string").alias("id"), "form")
    chunks = textform.consistent_texts(settled(table(spark, sf_dir, "chunks").select("chunk_id", "text"), "chunk_id", lambda same: same.dropDuplicates(["chunk_id"])), "chunk_id", "text").select(F.lit("chunks").alias("table_name"), "id", "form")
    return documents.unionByName(chunks)


# ---- problem 5


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = term_weights.term_weights(table(spark, sf_dir, "chunks"), "chunk_id", "text", min_tf=3, max_df=6)
    return weights.select(F.col("id").alias("chunk_id"), "term")


@query
def p5_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every chunk with its weight."""
    weights = term_weights.term_weights(table(spark, sf_dir, "chunks"), "chunk_id", "text")
    return weights.select(F.col("id").alias("chunk_id"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


# ---- problem 6


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = radix_percentiles.measurements(table(spark, sf_dir, "trace_spans"), "duration_ms", "span_id", "span_name", "started_at", "duration_ms")
    answers = table(spark, sf_dir, "answers").select("trace_id", "model_name", "answered_at", F.col("token_usage.output_tokens").alias("output_tokens"))
    return spans.unionByName(radix_percentiles.measurements(answers, "output_tokens", "trace_id", "model_name", "answered_at", "output_tokens"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "quantile_marks").select("metric", "group_name", F.col("quantile_pct").cast("int").alias("quantile_pct"), "mark_value")
    exact = radix_percentiles.select_percentiles(measured(spark, sf_dir), marks)
    return exact.join(marks, ["metric", "group_name", "quantile_pct"]).filter("value > mark_value").select("metric", "group_name", "quantile_pct", "day_utc")


@query
def p6_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile of every group and day, exact."""
    rows = measured(spark, sf_dir)
    groups = rows.select("metric", "group_name").distinct()
    wanted = groups.withColumn("quantile_pct", F.explode(F.array(*map(F.lit, (50, 90, 95, 99)))))
    return radix_percentiles.select_percentiles(rows, wanted)


@query
def p6_day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries to which further days can be added."""
    return radix_percentiles.histograms(measured(spark, sf_dir))


# ---- problem 2


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(splitting.pieces(splitting.latest(table(spark, sf_dir, "filings"))))


@query
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all items."""
    return splitting.pieces(splitting.latest(table(spark, sf_dir, "filings")))


# ---- problem 7


@query
def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document, or of every part of a document above the capacity."""
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


@query
def p7_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused space and balance."""
    return packing.fill_report(packing.pack(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")))


# ---- problem 8


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "heldout_items"), "item_id", "passage")


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(spark, sf_dir).select(F.col("id").alias("doc_id"), "item_id")


@query
def p8_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, how far."""
    return contamination.item_report(leaked(spark, sf_dir))


@query
def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, those with passages without them."""
    return contamination.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "heldout_items"), "item_id", "passage").withColumnRenamed("id", "doc_id")


# ---- problem 9


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).filter("truncated").select(F.col("id").alias("doc_id"))


@query
def p9_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of truncated rows of each source."""
    return truncation.source_report(judged(spark, sf_dir))


# ---- problem 4


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = markup_blocks.marked_records(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("table_name", F.lit("documents"))
    filings = markup_blocks.marked_records(table(spark, sf_dir, "filings"), "doc_id", "text", "doc_tables").withColumn("table_name", F.lit("filings"))
    return documents.unionByName(filings).filter("n_marked > 0").select("table_name", F.col("id").alias("record_id")).distinct()


@query
def p4_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every document and filing, and the tables of every filing with clean cells."""
    documents = markup_blocks.clean_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("table_name", F.lit("documents"))
    filings = markup_blocks.clean_texts(splitting.latest(table(spark, sf_dir, "filings")), "doc_id", "text", "doc_tables").withColumn("table_name", F.lit("filings"))
    return documents.unionByName(filings, allowMissingColumns=True).select("table_name", F.col("id").alias("record_id"), "clean", "n_marked", "doc_tables")
