"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.repeats import settled
from gleanery.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with equivalent SQL where there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- inputs shared by several queries

#: The same chunks in SQL: a repeated chunk_id counts once.
CHUNKS_SQL = """(select chunk_id, any_value(doc_id) as doc_id, any_value("text") as "text", any_value(char_start) as char_start, any_value(char_end) as char_end,
 any_value(metadata.company) as company, any_value(metadata.fiscal_year) as fiscal_year, any_value(metadata.form_type) as form_type, any_value(metadata.section) as section,
 any_value(metadata.contains_table) as contains_table, any_value(metadata.is_footnote) as is_footnote from chunks group by chunk_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    flat = table(spark, sf_dir, "chunks").select(
        "chunk_id", "doc_id", "text", "char_start", "char_end", m["company"].alias("company"), m["fiscal_year"].alias("fiscal_year"), m["form_type"].alias("form_type"),
        m["section"].alias("section"), m["contains_table"].alias("contains_table"), m["is_footnote"].alias("is_footnote"),
    )
    return settled(flat, "chunk_id", lambda rows: rows.dropDuplicates(["chunk_id"]))


FILINGS_SQL = """(select * from (select *, row_number() over (partition by doc_id order by ingested_at desc) as version from filings) where version = 1)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "filings")
    others = [c for c in rows.columns if c != "doc_id"]
    latest = lambda same: same.groupBy("doc_id").agg(F.max_by(F.struct(*others), "ingested_at").alias("d")).select("doc_id", "d.*")
    return settled(rows.select("doc_id", *others), "doc_id", latest)


ANSWERS_SQL = """(select * from (select *, row_number() over (partition by trace_id order by answered_at) as version from answers) where version = 1)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").dropDuplicates(["trace_id"])


SPANS_SQL = """(select span_id, any_value(trace_id) as trace_id, any_value(span_name) as span_name, any_value(subject) as subject, any_value(started_at) as started_at,
 any_value(duration_ms) as duration_ms, any_value(attributes) as attributes, any_value("error") as "error", min(received_at) as received_at from trace_spans group by span_id)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ["trace_id", "span_name", "subject", "started_at", "duration_ms", "attributes", "error"]
    rows = table(spark, sf_dir, "trace_spans")
    return rows.groupBy("span_id").agg(*[F.first(c).alias(c) for c in kept], F.min("received_at").alias("received_at"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "questions")
