import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import textform as X


@pytest.mark.parametrize(
    ("stored", "form"),
    [
        ("fіѕсаl 2025", "fiscal 2025"),
        ("ｒｅｓｔó", "restó"),
        ("a b c d", "a b c d"),
        ("mo​nth­⁠s﻿", "months"),
        ("Café", "Café"),
        ("кaпитaл", "капитал"),
        ("as а result", "as a result"),
        ("Νοtes Τhe", "Notes The"),
        ("key‐value", "key-value"),
        ("кaпитaл и <р>план</р>", "капитал и <p>план</p>"),
    ],
)
def test_forms(stored, form):
    assert X.consistent_form(stored) == form


@pytest.mark.parametrize(("a", "b"), [("Case", "case"), ("x²", "x2"), ("½", "1/2"), ("a b", "a\nb"), ("Café", "Cafe"), ("a–b", "a-b"), ("“a”", '"a"')])
def test_visible_differences_stay(a, b):
    assert X.consistent_form(a) != X.consistent_form(b)


@pytest.mark.parametrize(
    ("stored", "form"),
    [
        ("αѕ νіеԝ", "as view"),
        ("զսօtе", "quote"),
        ("ᎠᎪᎢᎪ", "DATA"),
        ("Ӏtеm", "Item"),
    ],
)
def test_other_scripts(stored, form):
    assert X.consistent_form(stored) == form


def test_the_bigrams_decide(monkeypatch):
    lines = ["Выручка group: сlаѕѕ ростом цен", "Выручка: Тhе Company"]
    forms = [X.consistent_form(x) for x in lines]
    assert forms == ["Выручка group: class ростом цен", "Выручка: The Company"]
    monkeypatch.setattr(X, "bigrams", lambda: [{} for _ in X.SCRIPTS])
    X.read_token.cache_clear()
    assert forms != [X.consistent_form(x) for x in lines]
    X.read_token.cache_clear()


def test_a_line_of_one_script_keeps_its_short_words():
    assert X.consistent_form("план и спрос на рынке о цене") == "план и спрос на рынке о цене"
    assert X.consistent_form("The price of a plan, а group и план") == "The price of a plan, a group и план"


def test_hot_forms_pair_only_records_of_different_texts(spark):
    rows = [(f"a{k}", "fiscal", "x") for k in range(300)] + [("b", "fіѕсаl", "x"), ("c", "fisсal", "x")]
    got = pairs(spark, rows)
    assert len(got) == 601 and ("b", "c") in got and all("b" in p or "c" in p for p in got)


def test_null_and_empty():
    assert X.consistent_form(None) is None
    assert X.consistent_form("") == ""
    assert X.consistent_form("​﻿") == ""


def test_a_russian_line_keeps_its_script():
    assert X.consistent_form("Выручка выросла c ростом цен") == "Выручка выросла с ростом цен"


ALPHABET = st.text(st.sampled_from("aceopxysij ABEHKMOPTX bdfgqz.,1"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(ALPHABET, st.randoms(use_true_random=False))
def test_any_disguise_of_a_latin_text_is_undone(text, rng):
    members = {c: [x for _, x in options] for c, options in X.LATTICE.items()}
    disguised = "".join(rng.choice(members.get(c, [c])) + rng.choice(["", "", "​"]) for c in text)
    assert X.consistent_form(disguised) == X.consistent_form(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_the_form_is_its_own_form(text):
    form = X.consistent_form(text)
    assert X.consistent_form(form) == form


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string, form_key string")
    return {(r.id_a, r.id_b) for r in X.look_alike_pairs(X.form_keys(df, "id", "text")).collect()}


def test_pairs(spark):
    rows = [("1", "fiscal", "x"), ("2", "fіѕсаl", "x"), ("3", "fiscal", "x"), ("10", "fiscal", "x"), ("4", None, "x"), (None, "fiscal", "x"), ("5", "", ""), ("6", "​", ""), ("2", "fіѕсаl", "x"), ("7", "other", "")]
    assert pairs(spark, rows) == {("1", "2"), ("2", "3"), ("10", "2"), ("5", "6")}


def test_empty_table(spark):
    assert pairs(spark, []) == set()


def test_long_text():
    long = "fіѕсаl " * 50_000
    assert X.consistent_form(long) == "fiscal " * 50_000


def test_found_against_comparison_of_all(spark, sf_dir):
    from gleanery.llm.queries import QUERIES

    got = {tuple(r) for r in QUERIES["p3_found"](spark, sf_dir).collect()}
    for name, key in (("documents", "doc_id"), ("chunks", "chunk_id")):
        rows = dict(duckdb.connect().execute(f"select cast({key} as varchar), \"text\" from '{sf_dir}/{name}.parquet'").fetchall())
        forms = {k: X.consistent_form(t) for k, t in rows.items()}
        want = {(name, a, b) for a in rows for b in rows if a < b and forms[a] == forms[b] and rows[a] != rows[b]}
        assert {g for g in got if g[0] == name} == want
