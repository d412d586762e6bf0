import random

import numpy as np
import pytest

from gleanery.llm import packing as P


def packed(spark, counts):
    df = spark.createDataFrame([(f"d{k}", n, 1) for k, n in enumerate(counts)], "id string, n_tokens long, size int")
    return P.pack(df).collect()


def check(rows, counts, capacity=P.CAPACITY):
    by_doc, windows, groups = {}, {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append((r.token_start, r.token_end))
        if r.token_end > r.token_start:
            windows.setdefault(r.container_id, []).append((r.container_offset, r.container_offset + r.token_end - r.token_start))
        assert groups.setdefault(r.container_id, r.step_group) == r.step_group or r.token_end == r.token_start
    assert len(by_doc) == len(counts)
    for k, n in enumerate(counts):
        spans = sorted(by_doc[f"d{k}"])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == max(1, -(-n // capacity))
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(windows) == list(range(len(windows)))
    return len(windows)


def test_every_text_has_its_place(spark):
    rng = random.Random(1)
    counts = [min(int(rng.lognormvariate(5.5, 1)) + 1, 9000) for _ in range(3000)]
    n = check(packed(spark, counts), counts)
    assert n <= -(-sum(counts) // P.CAPACITY) * 1.01 + 1


def test_cases(spark):
    counts = [0, 1, 2048, 2049, 4096, 0, 2047, 1]
    check(packed(spark, counts), counts)


def test_one_length_for_all(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 50)
    counts = [700] * 1000
    assert check(packed(spark, counts), counts) == 500


def test_nothing(spark):
    assert packed(spark, []) == []
    assert {r.container_id for r in packed(spark, [0, 0])} == {0}


def test_plan_fills_gaps_and_stays_small():
    rng = np.random.default_rng(3)
    counts = {int(k): int(rng.integers(1, 10**9)) for k in range(1, P.CAPACITY + 1)}
    slots, of_tier = P.plan(counts)
    windows = sum(of_tier)
    placed = {}
    for length, a, b, _, _ in slots:
        placed[int(length)] = placed.get(int(length), 0) + int(b - a)
    assert placed == counts
    assert windows * P.CAPACITY <= 1.01 * sum(k * n for k, n in counts.items()) + P.CAPACITY


def test_counts_against_the_tokenizer(spark):
    if not __import__("os").path.exists(P.VOCABULARY):
        pytest.skip("no vocabulary here")
    texts = ["", None, "plain words", "naïve € 12,345", "<|endoftext|>", "a " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, n_tokens string")
    got = {r.id: r.n_tokens for r in P.token_counts(df, "k", "n_tokens").collect()}
    encode = P.tokenizer(open(P.VOCABULARY, "rb").read()).encode_ordinary
    assert got == {k: len(encode(t)) if t else 0 for k, t in enumerate(texts)}


def lognormal(n, seed=4):
    counts = {}
    rng = random.Random(seed)
    for _ in range(n):
        k = min(int(rng.lognormvariate(5.5, 1)) + 1, P.CAPACITY)
        counts[k] = counts.get(k, 0) + 1
    return counts


def test_the_tiers_decide():
    counts = lognormal(5000)
    slots, of_tier = P.plan(counts)
    plain, _ = P.plan(counts, contexts=())
    assert slots.tolist() != plain.tolist() and all(n > 0 for n in of_tier)
    # a container of a tier holds a text of the tier in each of its windows, and nothing longer than its context
    ends = np.cumsum(of_tier)
    held = {}
    for length, a, b, first, _ in slots.tolist():
        for k in range(b - a):
            held.setdefault(first + k, []).append(length)
    for container, lengths in held.items():
        tier = int(np.searchsorted(ends, container, "right"))
        context, own = P.CONTEXTS[tier], [x for x in lengths if x > (P.CONTEXTS + (0,))[tier + 1]]
        assert max(lengths) <= context and sum(lengths) <= P.CAPACITY and own
        if container < ends[tier] - 1:
            assert len(own) >= P.CAPACITY // context


def test_no_more_containers_than_needed():
    counts = lognormal(5000)
    _, of_tier = P.plan(counts)
    assert sum(of_tier) <= -(-sum(k * n for k, n in counts.items()) // P.CAPACITY) + 1


def test_report(spark):
    rng = random.Random(5)
    counts = [min(int(rng.lognormvariate(5.5, 1)) + 1, 9000) for _ in range(6000)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(counts)], "id long, n_tokens long")
    rows = {r.context: r for r in P.fill_report(P.pack(df)).collect()}
    assert set(rows) == {*P.CONTEXTS, None}
    total = rows[None]
    assert total.n_tokens == sum(counts) and total.n_containers == sum(rows[c].n_containers for c in P.CONTEXTS) and total.unused_share < 0.01
    assert all(r.containers_apart <= 2 for r in rows.values()) and total.cost_apart < 0.1
