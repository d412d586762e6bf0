"""An invented corpus of eight chunks, for smoke tests of whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators import answering

CHUNKS = [
    ("mill-2023-1", "mill-2023", "Alder Mills sold 4,200 tonnes of paper in fiscal 2023. Revenue was $61.5 million.", "Alder Mills Inc.", 2023),
    ("mill-2023-2", "mill-2023", "Alder Mills closed its kiln in spring. The closure cost $2.1 million.", "Alder Mills Inc.", 2023),
    ("mill-2022-1", "mill-2022", "Alder Mills sold 3,900 tonnes of paper in fiscal 2022. Revenue was $55.0 million.", "Alder Mills Inc.", 2022),
    ("mill-2022-2", "mill-2022", "Energy was the largest cost of Alder Mills in fiscal 2022.", "Alder Mills Inc.", 2022),
    ("dock-2023-1", "dock-2023", "Brine Docks handled 310 vessels in fiscal 2023. Berth fees rose to $18.4 million.", "Brine Docks plc", 2023),
    ("dock-2023-2", "dock-2023", "A storm damaged two cranes of Brine Docks. Insurance covered $1.3 million.", "Brine Docks plc", 2023),
    ("seed-2023-1", "seed-2023", "Carden Seeds grew its orchard business by 12%. Harvest began in August.", "Carden Seeds Ltd", 2023),
    ("seed-2023-2", "seed-2023", "Carden Seeds has 85 employees and one customer above 10% of revenue.", "Carden Seeds Ltd", 2023),
]
SCHEMA = "chunk_id string, doc_id string, text string, company string, fiscal_year int"


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHUNKS, SCHEMA)


def answer(spark: SparkSession, questions: list[str]) -> DataFrame:
    """Responses of the grounded pipeline over the invented corpus."""
    rows = [(str(k), q, None) for k, q in enumerate(questions)]
    asked = spark.createDataFrame(rows, "query_id string, query string, history array<struct<question:string,answer:string>>")
    return answering.grounded(asked, corpus(spark))
