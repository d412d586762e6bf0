"""Problem 5: how distinctive each term of a record is.

Method: probabilistic relevance weighting. weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the average length count every record once.

A term is a run of four or more letters a-z of the lower-cased text in its consistent form; the length of a record is
its number of terms.

Scale: document frequencies are summed in each Python worker before anything is shuffled. A term in at least
one record of COMMON is joined by broadcast: there can be no more such terms than COMMON times the mean number of
distinct terms of a record, and the count is checked against BROADCAST_TERMS before. Only postings of rarer terms are
shuffled, so the words of which everything is full move no data.

Defined results: a null text is an empty one (it counts in N and has no terms); rows with a null id are left out; a
repeated id counts once, with one of its texts; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.textform import consistent_form
from gleanery.operators.repeats import settled
from gleanery.session import checkpointed

K1, B = 1.5, 0.75
COMMON = 1000
BROADCAST_TERMS = 200_000
TERM = re.compile(r"[a-z]{4,}")
_FLUSH = 1_000_000


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(consistent_form(text).lower()) if text else []


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, length): partial document frequencies; the row of the null term has records and total length."""
    counts: Counter = Counter()
    n = length = 0

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array([*counts, None], pa.string()), pa.array([*counts.values(), n], pa.int64()), pa.array(np.append(np.zeros(len(counts), dtype=np.int64), length))],
            names=["term", "df", "length"],
        )
        counts.clear()
        return batch

    for batch in batches:
        for text in batch.column(1).to_pylist():
            terms = terms_of(text)
            counts.update(set(terms))
            n += 1
            length += len(terms)
        if len(counts) > _FLUSH:
            yield out()
            n = length = 0
    if n:
        yield out()


def _postings(min_tf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, tfs, lengths = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = terms_of(text)
                for term, tf in Counter(found).items():
                    if tf >= min_tf:
                        rows.append(k)
                        terms.append(term)
                        tfs.append(tf)
                        lengths.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(lengths, pa.int32())], names=["id", "term", "tf", "length"]
            )

    return run


def term_weights(df: DataFrame, id_col: str, text_col: str, min_tf: int = 1, max_df: int | None = None) -> DataFrame:
    """(id, term, tf, df, weight) of every term of every record.

    ``min_tf`` and ``max_df`` keep terms that occur at least so often in the record and in at most so many records;
    both leave the statistics as they are.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows = settled(rows, "id", lambda same: same.dropDuplicates(["id"]))
    counted = checkpointed(rows.mapInArrow(_frequencies, "term string, df long, length long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")))
    total = counted.filter("term is null").first()
    n, length = (total.df, total.length) if total else (0, 0)
    average = length / n if n else 0.0
    frequencies = counted.filter("term is not null").select("term", "df")
    if max_df is not None:
        frequencies = frequencies.filter(F.col("df") <= max_df)
    postings = rows.mapInArrow(_postings(min_tf), "id string, term string, tf int, length int")
    common = frequencies.filter(F.col("df") * COMMON >= n)
    if max_df is not None and max_df * COMMON < n or common.count() > BROADCAST_TERMS:
        joined = postings.join(frequencies, "term")
    else:
        marked = postings.join(F.broadcast(common), "term", "left")
        rare = frequencies.filter(F.col("df") * COMMON < n)
        joined = marked.filter("df is not null").unionByName(marked.filter("df is null").drop("df").join(rare, "term"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    ratio = F.col("length") / F.lit(average) if average else F.lit(1.0)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * ratio))
    return joined.select("id", "term", "tf", "df", weight.alias("weight"))
