import random

import numpy as np

from gleanery.llm import near_duplicates as N
from gleanery.llm.words import shingle_set

WORDS = [f"w{k}" for k in range(400)]


def jaccard(a, b, size):
    a, b = set(shingle_set(a, size).tolist()), set(shingle_set(b, size).tolist())
    return len(a & b) / len(a | b) if a | b else 0.0


def pairs(spark, rows, threshold=0.6, size=4):
    df = spark.createDataFrame(rows, "table_name string, id string, text string, key string, class_id string")
    return {(r.id_a, r.id_b) for r in N.NearDuplicates(df, threshold, size).record_pairs().collect()}


def record(i, text, table="t"):
    return (table, i, text, "extra", "clash")


def test_every_pair_within_the_radius_meets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, size=(200, N.SYMBOLS), dtype=np.uint64).astype(np.uint32)
    other = base.copy()
    for row in other:  # one symbol of every group, and one more in one group: the worst case within the radius
        for g in range(N.GROUPS - 1):
            row[g * N.GROUP + rng.integers(N.GROUP)] ^= np.uint32(1)
            row[g * N.GROUP + rng.integers(N.GROUP)] ^= np.uint32(2)
        row[(N.GROUPS - 1) * N.GROUP + rng.integers(N.GROUP)] ^= np.uint32(1)
    assert ((base != other).sum(axis=1) <= N.RADIUS).all()
    assert (N.table_keys(base) == N.table_keys(other)).any(axis=1).all()


def test_tables_do_not_mix():
    keys = N.table_keys(np.zeros((1, N.SYMBOLS), dtype=np.uint32))[0]
    assert len(set(keys.tolist())) == N.GROUPS * len(N.MASKS)


def test_against_comparison_of_all(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = rng.choices(WORDS, k=rng.randint(3, 120))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            edited = list(words)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            texts.append(" ".join(edited))
    rows = [record(f"{k:03d}", t) for k, t in enumerate(texts)]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and jaccard(a[2], b[2], 4) >= 0.7}
    unsure = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and 0.6 <= jaccard(a[2], b[2], 4) < 0.7}
    got = pairs(spark, rows)
    assert want <= got <= want | unsure


def test_cases(spark):
    same = "one two three four five six seven"
    rows = [record("1", same), record("2", same.upper()), record("3", "one, two; three four five six seven!"), record("3", same), record("4", None), record(None, same), record("5", ""), record("6", "..."), record("7", "short"), record("8", "Short"), record("9", same, "u")]
    assert pairs(spark, rows) == {("1", "2"), ("1", "3"), ("2", "3"), ("7", "8")}


def test_empty_table(spark):
    assert pairs(spark, []) == set()


def test_record_classes_count_copies_and_links(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    df = spark.createDataFrame([record("1", " ".join(base)), record("2", " ".join(base)), record("3", near), record("4", "alone here")], "table_name string, id string, text string, key string, class_id string")
    rows = {r.id: (r.n_copies, r.n_links) for r in N.NearDuplicates(df).record_classes().collect()}
    assert rows == {"1": (2, 1), "2": (2, 1), "3": (1, 1), "4": (1, 0)}


def test_long_text(spark):
    rng = random.Random(5)
    words = rng.choices(WORDS, k=60_000)
    edited = list(words)
    for k in range(0, 60_000, 400):
        edited[k] = "x"
    assert pairs(spark, [record("1", " ".join(words)), record("2", " ".join(edited))]) == {("1", "2")}


def test_crowded_keys_are_cut_without_loss(spark):
    rng = random.Random(9)
    rows = [(c, rng.choice((90, 100, 300)), key) for c in range(400) for key in {0, rng.randrange(3), 10 + rng.randrange(200)}]
    df = spark.createDataFrame(rows, "class_id long, n_runs int, key long").cache()
    plain = {tuple(r) for r in N._met(df, 0.6).collect()}
    cut = [tuple(r) for r in N._met(df, 0.6, hot=40, sample=2, block=30).collect()]
    assert set(cut) == plain and len(plain) > 10_000
    crowd = [tuple(r) for r in N._met(df.filter("key = 0"), 0.6, hot=40, sample=2, block=30).collect()]
    assert len(crowd) == len(set(crowd))  # the blocks of a key make each pair once


def test_many_variants_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 50)
    rng = random.Random(10)
    words = rng.choices(WORDS, k=150)
    texts = []
    for _ in range(60):
        edited = list(words)
        edited[rng.randrange(len(edited))] = rng.choice(WORDS)
        texts.append(" ".join(edited))
    rows = [record(f"{k:03d}", t) for k, t in enumerate(texts)]
    assert pairs(spark, rows) == {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1]}
