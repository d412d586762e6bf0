import random

from gleanery.llm import contamination as C
from gleanery.llm.markup import plain_words

WORDS = [f"w{k}x" for k in range(3000)]


def leaks(spark, texts, items, **knobs):
    t = spark.createDataFrame([(k, x, "c", 1) for k, x in enumerate(texts)], "doc_id long, text string, item_id string, id int")
    i = spark.createDataFrame([(k, x, "c", 1) for k, x in items], "item_id long, passage string, text string, id int")
    return {(r.id, r.item_id): r.run_words for r in C.leaks(t, "doc_id", "text", i, "item_id", "passage", **knobs).collect()}


def passage(seed, n=40):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def part(text, a, b):
    return " ".join(text.split()[a:b])


def test_runs(spark):
    p, q = passage(1), passage(2)
    texts = [
        f"before {p} after",
        f"x {part(p, 5, 20)} y",  # fifteen words
        f"x {part(p, 5, 19)} y",  # fourteen
        f"{part(p, 0, 16)} z {part(q, 10, 40)}",
        None,
        "",
        f"{part(p, 0, 10)} z {part(p, 10, 20)}",
    ]
    assert leaks(spark, texts, [(1, p), (2, q), (3, None), (4, "too short"), (5, p)]) == {(0, 1): 40, (0, 5): 40, (1, 1): 15, (1, 5): 15, (3, 1): 16, (3, 5): 16, (3, 2): 30}


def test_disguises(spark):
    p = " ".join(["alpha", "beta", "gamma", "delta", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"])
    texts = [
        p.upper().replace(" ", "\n"),
        p.replace("beta", "<b>beta</b>").replace(" one", ",&nbsp;one"),
        p.replace("beta", "&amp;lt;i&amp;gt;beta&amp;lt;/i&amp;gt;"),
        p.replace("beta", "b​eta").replace("four", "fоur"),
        p.replace("beta", "**beta**").replace("two", "[two](#note-1)").replace("six", "[[Glossary|six]]"),
        p.replace("beta", "\\textbf{beta}").replace("two", "two~\\ref{tab:a}"),
    ]
    assert leaks(spark, texts, [(7, p)]) == {(k, 7): 16 for k in range(len(texts))}


def test_a_word_in_parts_is_one_word():
    assert plain_words("[[inversi]]ón <b>con</b>stat") == "inversión constat"


def test_more_disguises(spark):
    p = " ".join(["alpha", "beta", "gamma", "delta", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"])
    texts = [
        p.replace("beta", "{\\it beta}").replace("two", "\\noindent two"),
        p.replace("beta", "\\textbf{\\textit{\\underline{beta}}}"),
        p.replace("beta", "\\href{http://x.y/z}{beta}").replace("six", "\\colorbox[rgb]{six}"),
        p.replace("beta", "＜b＞beta＜/b＞"),  # markup in full-width signs
        p.replace("beta", "b&#1077;ta"),  # an entity for a look-alike letter
    ]
    assert leaks(spark, texts, [(7, p)]) == {(k, 7): 16 for k in range(len(texts))}


def test_a_large_set_of_passages_is_joined(spark):
    items = [(k, passage(k)) for k in range(12)] + [(20, None), (21, "too short"), (22, passage(3))]
    texts = [p for _, p in items[:12]] + [None, "", "nothing here", part(passage(5), 3, 30), items[0][1]]
    assert leaks(spark, texts, items, broadcast_chars=10) == leaks(spark, texts, items)
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    both = [sorted(map(tuple, C.cleaned(t, "doc_id", "text", i, "item_id", "passage", broadcast_chars=n).collect()), key=str) for n in (10, 10**6)]
    assert both[0] == both[1] and sum(r[2] for r in both[0]) == 14


def test_every_copy_is_removed(spark):
    p = passage(1)
    t = spark.createDataFrame([(1, ". ".join(["Start"] + [p] * 5 + ["End"]))], "doc_id long, text string")
    i = spark.createDataFrame([(1, p)], "item_id long, passage string")
    (r,) = C.cleaned(t, "doc_id", "text", i, "item_id", "passage").collect()
    assert "w" not in r.text and r.text.startswith("Start") and r.text.endswith("End")


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, passage(1))]) == {}
    assert leaks(spark, [passage(1)], []) == {}


def test_cleaned(spark):
    p = passage(1)
    t = spark.createDataFrame([(1, f"Before. {p}. After."), (2, "clean <b>text</b>"), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(1, p)], "item_id long, passage string")
    rows = {r.id: (r.text, r.removed) for r in C.cleaned(t, "doc_id", "text", i, "item_id", "passage").collect()}
    assert rows == {1: ("Before. . After.", True), 2: ("clean <b>text</b>", False), 3: (None, False)}


def test_report(spark):
    p = passage(1)
    t = spark.createDataFrame([(1, p), (2, part(p, 0, 20))], "doc_id long, text string")
    i = spark.createDataFrame([(1, p)], "item_id long, passage string")
    (r,) = C.item_report(C.leaks(t, "doc_id", "text", i, "item_id", "passage")).collect()
    assert (r.item_id, r.n_texts, r.longest_run, r.largest_share) == (1, 2, 40, 1.0)
