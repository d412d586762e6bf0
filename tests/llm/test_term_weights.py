import math
from collections import Counter

import duckdb
import pytest

from gleanery.llm import term_weights as W


def weights(spark, rows, **knobs):
    df = spark.createDataFrame(rows, "key string, body string, term string, df int")
    return {(r.id, r.term): r for r in W.term_weights(df, "key", "body", **knobs).collect()}


def brute(rows):
    texts = {}
    for k, t, *_ in rows:
        if k is not None:
            texts.setdefault(k, t)
    terms = {k: W.terms_of(t) for k, t in texts.items()}
    n, average = len(terms), sum(map(len, terms.values())) / len(terms)
    df = Counter(t for ts in terms.values() for t in set(ts))
    out = {}
    for k, ts in terms.items():
        for t, tf in Counter(ts).items():
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            out[k, t] = idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / average))
    return out


ROWS = [("a", "alpha alpha beta gamma. Alpha!", "x", 1), ("b", "beta gamma delta", "x", 1), ("b", "beta gamma delta", "x", 1), ("c", None, "x", 1), ("d", "", "x", 1), ("e", "the cat", "x", 1), (None, "alpha", "x", 1), ("f", "аlрhа beta", "x", 1)]


def test_against_brute_force(spark):
    got, want = weights(spark, ROWS), brute(ROWS)
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.weight == pytest.approx(want[k])
    assert got["a", "alpha"].df == 2 and got["a", "alpha"].tf == 3


def test_limits_leave_the_statistics(spark):
    full, kept = weights(spark, ROWS), weights(spark, ROWS, min_tf=2)
    assert set(kept) == {("a", "alpha")} and kept["a", "alpha"].weight == full["a", "alpha"].weight
    assert ("a", "beta") not in weights(spark, ROWS, max_df=2) and ("a", "alpha") in weights(spark, ROWS, max_df=2)


def test_rare_terms_take_the_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(W, "COMMON", 2)
    got, want = weights(spark, ROWS), brute(ROWS)
    assert set(got) == set(want) and all(r.weight == pytest.approx(want[k]) for k, r in got.items())


def test_empty_table(spark):
    assert weights(spark, []) == {}


def test_found_against_brute_force(spark, sf_dir):
    from gleanery.llm.queries import QUERIES

    rows = dict(duckdb.connect().execute(f"select chunk_id, \"text\" from '{sf_dir}/chunks.parquet'").fetchall())
    terms = {k: Counter(W.terms_of(t)) for k, t in rows.items()}
    df = Counter(t for ts in terms.values() for t in ts)
    want = {(k, t) for k, ts in terms.items() for t, n in ts.items() if n >= 3 and df[t] <= 6}
    assert {tuple(r) for r in QUERIES["p5_found"](spark, sf_dir).collect()} == want
