"""Vectors as arrays of doubles, and the embedders that need no model."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gleanery.functions.text import TOKEN

#: Tokens of which a task keeps the hash.
SLOTS_KEPT = 300_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def checked_dot(a: Column, b: Column) -> Column:
    """The cosine of unit vectors; vectors of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different dimensions")).cast("double"))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def hashing_embedder(dim: int = 512, seed: int = 0):
    """Text to unit vector: a keyed 8-byte BLAKE2 hash of each token gives bucket and sign, 1 + ln(count) the weight."""
    key, token = str(seed).encode(), re.compile(TOKEN)

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}

        def slot(t: str) -> tuple[int, float]:
            if t not in known:
                if len(known) >= SLOTS_KEPT:
                    known.clear()
                v = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, key=key).digest(), "big")
                known[t] = v % dim, 1.0 if v >> 63 else -1.0
            return known[t]

        def one(text: str | None):
            if text is None:
                return None
            v = np.zeros(dim)
            for t, n in Counter(token.findall(text.lower())).items():
                k, sign = slot(t)
                v[k] += sign * (1.0 + math.log(n))
            norm = math.sqrt(float(v @ v))
            return (v / norm if norm else v).tolist()

        return texts.map(one)

    return embed


def bucket_embedded(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, vector): the same idea with MD5 for bucket and sign, so another engine can give the same numbers.

    Made where the texts lie; nothing is shuffled. Texts without tokens have no row.
    """
    token = re.compile(TOKEN)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            kept, vectors = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                v = np.zeros(dim)
                for t, n in Counter(token.findall((text or "").lower())).items():
                    place = known.get(t)
                    if place is None:
                        if len(known) >= SLOTS_KEPT:
                            known.clear()
                        code = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big")
                        known[t] = place = code % dim, 1.0 if code >> 31 else -1.0
                    v[place[0]] += place[1] * (1.0 + math.log(n))
                norm = math.sqrt(float(v @ v))
                if norm > 0:
                    kept.append(row)
                    vectors.append((v / norm).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "vector"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(embed, f"id {df.schema[id_col].dataType.simpleString()}, vector array<double>")
