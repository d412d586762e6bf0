import pytest

from gleanery.llm import truncation as T

PROSE = "Revenue rose to $5,123 million as prices were higher. Costs fell by 3.5% over the year."


@pytest.mark.parametrize(
    "text",
    [
        PROSE,
        PROSE + "\n\n- END -",
        PROSE + "\n\nPage 3 of 12",
        PROSE + "\n\n[remainder left blank]",
        PROSE + "\n\n/s/ A. Person, Secretary",
        PROSE + "\n\n* denotes unaudited figures",
        "Intro.\n\n• Costs fell 3.5%\n• Revenue rose to $5,123 million",
        "Intro.\n\nFeed cost | $5,123 | 4,200",
        PROSE + "\n\n## Market Risk",
        "\\begin{document}\n" + PROSE + "\n\\end{document}",
        PROSE + "\n\n```\nx = 3\n```",
        PROSE + "\n\n$$\nr^2 \\leq 0.7\n$$",
        "<p>" + PROSE + "</p>\n</body></html>",
        "&lt;p&gt;" + PROSE + "&lt;/p&gt;",
        'He said "it was (all) fine."',
        "As described in Note 7.",
        "Wait for it [...]",
        "Er sagte „es ist gut“ und ging.",
        "• The URL ends in caf%C3%A9",
        "A stray bracket (here.\n\n" + PROSE,
        "A stray $$ here.\n\n" + PROSE,
        "<p>One.\n\n<p>Two <b>three</b>.",
        "Chiffre en hausse, conformément à la note 12.",
        "",
        "   ",
        None,
    ],
)
def test_whole(text):
    assert T.ending(text)[0] in ("whole", "part")


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (PROSE + " The board of dir", "no_terminator"),
        (PROSE + " The board of ", "no_terminator"),
        (PROSE + " It fell by 3.", "whole"),
        (PROSE + " It cost $3.", "open_number"),
        (PROSE + " It cost $", "open_number"),
        (PROSE + " It rose…", "marker"),
        (PROSE + " It rose ...", "marker"),
        (PROSE + " It rose (more", "open_bracket"),
        (PROSE + " It rose [truncated", "open_bracket"),
        (PROSE + " It ro..", "marker"),
        (PROSE + " It (as before. And so on.", "open_bracket"),
        (PROSE + " He said “we are done.", "open_quote"),
        (PROSE + " Er sagte „wir sind fertig.", "open_quote"),
        (PROSE + "\n\n```\nx = 3;", "open_markup"),
        (PROSE + "\n\n$$\nr^2", "open_markup"),
        (PROSE + "\n\n\\begin{equation}\nr = 2.", "open_markup"),
        ("<ul><li>Costs fell.</li>", "open_markup"),
        (PROSE + " It is <b>large.", "open_markup"),
        (PROSE + " caf\\u00", "broken_character"),
        (PROSE + " caf%C3", "broken_character"),
        (PROSE + " caf%C3%A", "broken_character"),
        (PROSE + " It rose [truncated]", "marker"),
        (PROSE + ' See <a href="#n', "open_markup"),
        (PROSE + " R&am", "open_markup"),
        (PROSE + " The compan�", "broken_character"),
        ("Intro.\n\n• Costs fell 3.5%\n• Software developed for", "no_terminator"),
        ("Intro.\n\n• It rose to $3,9", "open_number"),
        (PROSE + " It (as before", "open_bracket"),
        (PROSE + " He said “we", "open_quote"),
        ("<p>" + PROSE + "</p>\n\n<p>The board</p>\n</body></html>", "heading"),
        ("\\begin{document}\n" + PROSE + " The board of dir", "no_terminator"),
        (PROSE + "\n\nA. Person, Finance: Or", "heading"),
        (PROSE + " The board of\n\n- END -", "no_terminator"),
    ],
)
def test_endings(text, reason):
    assert T.ending(text)[0] == reason


def test_the_automaton_decides(monkeypatch):
    texts = [PROSE + x for x in (" It rose (more", " It rose [truncated", " He said “we are done.", "\n\n```\nx = 3;", "\n\n$$\nr^2", " It is <b>large.")]
    whole = [T.ending(t)[0] for t in texts]
    monkeypatch.setattr(T, "automaton", lambda text: ([], []))
    assert all(a != T.ending(t)[0] for a, t in zip(whole, texts))


def judged(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, reason string, length int")
    return T.truncated(df, "doc_id", "text", "source")


def test_baseline_of_a_source(spark):
    rows = [(k, "no stop here at all", "chat") for k in range(8)] + [(8, "It ends.", "chat")] + [(k, PROSE, "press") for k in range(20, 40)] + [(50, PROSE + " And th", "press"), (51, None, "press"), (None, "x", "press"), (52, PROSE + " And th", None)]
    got = {r.id for r in judged(spark, rows).filter("truncated").collect()}
    assert got == {50, 52} or got == {50}  # the null source has one row, which is its own baseline


def test_limit_of_a_source(spark):
    body = ("word " * 200)[:598]
    rows = [(k, "• " + body, "feed") for k in range(6)] + [(k, PROSE, "feed") for k in range(10, 30)] + [(40, "• Costs fell 3.5%", "feed")]
    assert {r.id for r in judged(spark, rows).filter("truncated").collect()} == set(range(6))


@pytest.mark.parametrize("limit", [140, 1023])
def test_any_length_can_be_a_limit(spark, limit):
    cut = lambda k: ("• entry " + "word " * limit)[: limit - 4] + f"x{k:03}"[::-1]
    for n in (8, 40):  # the same share of a small and of a larger source
        rows = [(k, cut(k), "feed") for k in range(n)] + [(100 + k, "• " + "w" * (21 + 7 * k), "feed") for k in range(9 * n)] + [(9000 + k, PROSE, "feed") for k in range(n)]
        assert {r.id for r in judged(spark, rows).filter("truncated").collect()} == set(range(n))


def test_usual_lengths_are_no_limits(spark):
    rows = [(100 * k + j, "• " + "w" * (80 + k % 9), "feed") for k in range(60) for j in range(2 if k % 9 == 4 else 1)] + [(9000 + k, "• " + "w" * 800, "feed") for k in range(2)] + [(9100 + k, PROSE, "feed") for k in range(30)]
    assert judged(spark, rows).filter("truncated").collect() == []


def test_known_headings_are_whole(spark):
    rows = [(k, f"Market Risk, fiscal {2000 + k}\n\n{PROSE}", "s") for k in range(4)] + [(10, PROSE + "\n\nMarket Risk, fiscal 2031", "s"), (11, PROSE + "\n\nHeadcount in the Precision Cast", "s")]
    assert {r.id for r in judged(spark, rows).filter("truncated").collect()} == {11}


def test_cut_last_lines_do_not_make_each_other_headings(spark):
    for n in (1, 20):  # the same rows many times over
        rows = [(k, PROSE + "\n\nHeadcount in the Precision Cast" + footer, "s") for k in range(n) for footer in ("", "\n\nPage 3 of 9")] + [(1000 + k, PROSE, "s") for k in range(30 * n)]
        assert judged(spark, rows).filter("truncated").count() == 2 * n


def test_report(spark):
    rows = [(k, PROSE, "s") for k in range(3)] + [(9, PROSE + " It rose…", "s")]
    (r,) = T.source_report(judged(spark, rows)).collect()
    assert (r.source, r.n_rows, r.n_truncated, r.truncated_share) == ("s", 4, 1, 0.25)


def test_empty_table_and_long_text(spark):
    assert judged(spark, []).collect() == []
    assert T.ending(PROSE * 5_000)[0] == "whole" and T.ending(PROSE * 5_000 + " And th")[0] == "no_terminator"
