import math
import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gleanery.llm import radix_percentiles as P

SCHEMA = "span_id bigint, grp string, at timestamp_ntz, v double, day_utc string, bits int"


def measured(spark, rows):
    return P.measurements(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), "m", "span_id", "grp", "at", "v")


@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=50))
def test_order_is_kept_and_undone(values):
    v = np.array(values)
    bits = P.ordered_bits(v)
    assert (np.sort(bits) == P.ordered_bits(np.sort(v))).all()
    assert (P.from_ordered_bits(bits) == v + 0.0).all()


def nearest(values, pct):
    return sorted(values)[max(1, math.ceil(pct * len(values) / 100)) - 1]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice("ab"), datetime(2024, 1, rng.randint(1, 3), rng.randint(0, 23)), rng.choice([rng.random() * 10, rng.expovariate(0.001), 5.0, 0.0])) for k in range(n)]


def test_exact_percentiles(spark):
    rows = rows_of(600)
    dirty = [(1000, "a", datetime(2024, 1, 1), None), (1001, "a", datetime(2024, 1, 1), float("nan")), (1002, "a", datetime(2024, 1, 1), -3.0), (1003, None, datetime(2024, 1, 1), 9.0), (1004, "a", None, 9.0), (None, "a", datetime(2024, 1, 1), 9.0), rows[0], rows[1]]
    wanted = spark.createDataFrame([("m", g, p) for g in "ab" for p in (1, 50, 95, 100)], "metric string, group_name string, quantile_pct int")
    got = {(r.group_name, r.day_utc, r.quantile_pct): (r.n, r.value) for r in P.select_percentiles(measured(spark, rows + dirty), wanted).collect()}
    cells = {}
    for _, g, at, v in rows:
        cells.setdefault((g, f"{at:%Y-%m-%d}"), []).append(v)
    assert got == {(g, d, p): (len(vs), nearest(vs, p)) for (g, d), vs in cells.items() for p in (1, 50, 95, 100)}


def test_beyond_the_broadcast(spark, monkeypatch):
    rows = rows_of(200, 2)
    wanted = spark.createDataFrame([("m", "a", 50)], "metric string, group_name string, quantile_pct int")
    plain = sorted(map(tuple, P.select_percentiles(measured(spark, rows), wanted).collect()))
    monkeypatch.setattr(P, "BROADCAST_TARGETS", 0)
    assert sorted(map(tuple, P.select_percentiles(measured(spark, rows), wanted).collect())) == plain


def test_summaries_add_up_within_the_error(spark):
    a, b = rows_of(300, 3), [(k + 10_000, g, at, v) for k, g, at, v in rows_of(300, 4)]
    summary = P.merge(P.histograms(measured(spark, a)), P.histograms(measured(spark, b)))
    wanted = spark.createDataFrame([("m", g, p) for g in "ab" for p in (50, 90)], "metric string, group_name string, quantile_pct int")
    got = {(r.group_name, r.day_utc, r.quantile_pct): r.value for r in P.percentiles(summary, wanted).collect()}
    exact = {(r.group_name, r.day_utc, r.quantile_pct): r.value for r in P.select_percentiles(measured(spark, a + b), wanted).collect()}
    assert got.keys() == exact.keys()
    for k, v in got.items():
        assert v == pytest.approx(exact[k], rel=2**-12, abs=1e-300)


def test_empty_table(spark):
    wanted = spark.createDataFrame([("m", "a", 50)], "metric string, group_name string, quantile_pct int")
    assert P.select_percentiles(measured(spark, []), wanted).collect() == []
