import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gleanery.llm import block_model as B
from gleanery.llm import markup_blocks as M
from gleanery.llm.markup import plain_words
from gleanery.llm.words import WORD
from exact_marks import has_mark


@pytest.fixture(scope="module")
def model():
    return B.trained()


def test_held_out_accuracy(model):
    rng = random.Random(77)
    docs = [B.write_document(rng) for _ in range(300)]
    scores = model.scores(M.vectors([[line for line, _, _ in d] for d in docs], model.signs))
    pairs = [(B.KINDS[row[:-1].argmax()] == kind, (row[-1] > 0) == mark) for d, s in zip(docs, scores) for (_, kind, mark), row in zip(d, s)]
    kind_share, mark_share = np.mean(pairs, axis=0)
    assert kind_share > 0.97 and mark_share > 0.99


def test_gradients():
    rng = np.random.default_rng(1)
    net = B.BlockLabeller(5, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, lengths = rng.standard_normal((2, 4, 5)), np.array([4, 2])
    kinds, marked = np.array([[0, 1, 2, 3], [4, 5, -1, -1]]), rng.integers(0, 2, (2, 4)).astype(float)
    _, grad = net.gradients(x, lengths, kinds, marked)
    for name in ("Wf", "Wb", "Uf", "Ub", "cf", "cb", "V", "v"):
        at = tuple(0 for _ in net.p[name].shape)
        net.p[name][at] += 1e-5
        up, _ = net.gradients(x, lengths, kinds, marked)
        net.p[name][at] -= 2e-5
        down, _ = net.gradients(x, lengths, kinds, marked)
        net.p[name][at] += 1e-5
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=0.05, abs=2e-3)


def marked(spark, rows):
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id string, text string, doc_tables array<struct<grid:array<array<string>>>>, n_marked string")
    return {r.id: r.n_marked > 0 for r in M.marked_records(df, "doc_id", "text", "doc_tables").collect()}


WITH = {
    "tag": "Revenue <b>rose</b> to $5 million.",
    "entity": "Revenue&nbsp;rose to $5 million.",
    "escaped": "&lt;p&gt;Revenue rose.&lt;/p&gt;",
    "comment": "Revenue <!-- page 3 --> rose.",
    "hashes": "## Market Risk\n\nRevenue rose to $5 million.",
    "underline": "Market Risk\n===========\n\nRevenue rose.",
    "strong": "Revenue **rose** to $5 million.",
    "emphasis": "Revenue *rose* to $5 million.",
    "link": "Revenue [rose](#note-4) to $5 million.",
    "code": "Revenue `rose` to $5 million.",
    "fence": "Revenue rose.\n\n```\nx = 1\n```",
    "bullets": "Costs:\n\n- one thing\n- another thing",
    "wiki head": "== Market Risk ==\n\nRevenue rose.",
    "wiki quotes": "Revenue '''rose''' to $5 million.",
    "wiki link": "Revenue [[rose]] to $5 million.",
    "template": "Revenue {{citation needed}} rose.",
    "command": "Revenue \\textbf{rose} to $5 million.",
    "math": "Revenue $\\approx$ rose to 5.",
    "display": "Revenue rose.\n\n$$\nr^2 \\leq 0.7\n$$",
    "hidden": "Revenue <b​>rose</b> to $5 million.",
}
WITHOUT = {
    "prose": "Revenue rose to $5 million. R&D and S&M were below budget.",
    "signs": "Margins were < 5% at two sites and > 9% elsewhere. The rate p < 0.05 applied to $3 and $9 notes alike.",
    "stars": "Footnotes marked * or ** are unaudited {see above}.",
    "field": "The share_count_basic field was 0 in filing #2 [3].",
    "bullets": "Costs:\n\n• one thing\n• another thing",
    "table": "Measure | FY2024\nFeed cost | $5,123",
    "footer": "Revenue rose.\n\n* denotes unaudited figures",
    "end": "Revenue rose.\n\n- END -",
    "name": "The merger with Zörnbeck & Söhne closed.",
    "quote": "As quoted: [...] the plant closed [...]",
    "braces": "We began shipping {name} from {place} in {yr}.",
}


def test_records(spark):
    rows = [(f"with {k}", t, None) for k, t in WITH.items()] + [(f"without {k}", t, None) for k, t in WITHOUT.items()]
    rows += [("null", None, None), ("empty", "", []), ("cell", "Plain text.", [([["a", "<b>b</b>"], [None], None],)]), ("cells", "Plain text.", [([["a", "b & c"]],), None])]
    got = marked(spark, rows)
    assert {k for k, m in got.items() if m} == {f"with {k}" for k in WITH} | {"cell"}


def test_empty_table(spark):
    assert marked(spark, []) == {}


def flags(model, text):
    return M.label(model, [M.leaves(text)])[1][0].tolist()


def test_the_network_decides(model):
    # the same line with and without company: only the states of the network tell them apart
    assert flags(model, "Costs rose.\n- one thing was moved\n- another fell")[1:] == [True, True]
    texts = [*WITH.values(), *WITHOUT.values()]
    whole = [any(flags(model, t)) for t in texts]
    assert whole == [True] * len(WITH) + [False] * len(WITHOUT)
    blind = B.BlockLabeller(M.INPUTS)
    blind.signs, blind.p = model.signs, {k: np.zeros_like(v) if k in ("Wf", "Wb") else v for k, v in model.p.items()}
    assert [any(flags(blind, t)) for t in texts] != whole
    forgetful = B.BlockLabeller(M.INPUTS)
    forgetful.signs, forgetful.p = model.signs, {k: np.zeros_like(v) if k in ("Uf", "Ub") else v for k, v in model.p.items()}
    rng = random.Random(12)
    docs = [[line for line, _, _ in B.write_document(rng)] for _ in range(200)]
    with_context, without = M.label(model, docs), M.label(forgetful, docs)
    assert any((a != b).any() for a, b in zip(with_context[1], without[1])) and any((a != b).any() for a, b in zip(with_context[0], without[0]))


def test_against_the_exact_check(model, sf_dir):
    con = duckdb.connect()
    texts = [t for (t,) in con.execute(f"select \"text\" from '{sf_dir}/documents.parquet' union all select \"text\" from '{sf_dir}/filings.parquet'").fetchall()]
    docs = [M.leaves(t) for t in texts]
    got = [bool(f.any()) for f in M.label(model, docs)[1]]
    want = [any(has_mark(d, k) for k in range(len(d))) for d in docs]
    wrong = sum(a != b for a, b in zip(got, want))
    assert sum(want) > 10 and wrong <= 0.005 * sum(want)


def counted(text):
    return Counter(WORD.findall(text.lower()))


def test_no_word_is_lost(model, sf_dir):
    texts = [t for (t,) in duckdb.connect().execute(f"select \"text\" from '{sf_dir}/documents.parquet'").fetchall() if t]
    docs = [M.leaves(t) for t in texts]
    kinds, marked = M.label(model, docs)
    some = 0
    for d, k, f in zip(docs, kinds, marked):
        if f.any():
            some += 1
            # words joined by lowered signs are kept apart in formulas; numbers of entries, attributes of tables and names of templates are marks
            kept = [line for line in d if "sub>" not in line and not line.startswith(("% ", "{|", "{{Infobox"))]
            lost = counted("\n".join(re.sub(r"^\d+[.)] ", "", plain_words(line)) for line in kept)) - counted(M.clean(d, k, f))
            assert not lost, (lost, d)
    assert some > 10


def test_clean(model):
    def clean(text):
        lines = M.leaves(text)
        kinds, found = M.label(model, [lines])
        return M.clean(lines, kinds[0], found[0])

    page = "<html><body>\n<h2>Market Risk</h2>\n<p>Revenue <b>rose</b> to &#36;5&nbsp;million.</p>\n<ul>\n<li>one thing was moved to $3 million</li>\n<li>another fell by 3%</li>\n</ul>\n<pre><code>if a &lt; 3:\n    stop()</code></pre>\n<p>m<sub>t</sub> = (R &minus; C) / R</p>\n</body></html>"
    text = clean(page)
    assert "## Market Risk" in text and "Revenue rose to $5 million." in text
    assert "- one thing was moved to $3 million\n- another fell by 3%" in text
    assert "```\nif a < 3:\n    stop()\n```" in text and "$m_{t} = (R − C) / R$" in text
    assert "<" not in text.replace("a < 3", "")
    wiki = '== Market Risk ==\n\nRevenue [[Glossary|rose]] by 5%.\n\n{| class="wikitable"\n! Measure !! FY2020\n|-\n| Feed cost || $5,123\n|}'
    assert clean(wiki) == "# Market Risk\n\nRevenue rose by 5%.\n\nMeasure | FY2020\nFeed cost | $5,123"
    assert clean("<table><tr><th>A</th><th>B</th></tr><tr><td>one</td><td></td></tr><tr><td>two</td><td>3</td></tr></table>") == "A | B\none |\ntwo | 3"
    assert clean("<p>Here it is:</p><ul><li>one thing</li><li>another thing</li></ul>") == "Here it is:\n\n- one thing\n- another thing"
    assert clean("Market Risk\n===========\n\nRevenue **rose** by 5%.") == "# Market Risk\n\nRevenue rose by 5%."
    assert clean("The <b>rate</b> is $x_i^2 + 1$ in all.") == "The rate is $x_i^2 + 1$ in all."
    assert clean("Revenue \\textbf{\\textit{rose}} by 5\\%.") == "Revenue rose by 5%."
    assert "Ships in service" in clean('{| class="sortable"\n|+ Ships in service\n|-\n| one || two\n|}')
    assert clean("<script>\nvar a = 1;\n</script>\n<p>Revenue rose.</p>") == "Revenue rose."


def test_long_text(spark):
    assert marked(spark, [("a", "Revenue rose.\n" * 20_000 + "<b>x</b> fell.", None), ("b", "Revenue rose to five. " * 20_000, None)]) == {"a": True, "b": False}


def test_clean_cells(spark):
    kind = "array<struct<grid:array<array<string>>,caption:string,char_start:int>>"
    grid = [["Measure", "<b>FY2024</b>", None], ["&nbsp;Tooling", "'''Data margin'''", "$5,123"], None, ["**Feed** cost", "## Total", "R & D"], ["\\textbf{Rail} revenue", "cost<sup>(1)</sup>", "- 5"], []]
    rows = [("a", "Plain text.", [(grid, "<i>x</i>", 3), None, (None, "y", 4)]), ("b", "A <b>b</b>.", [([["R & D", " 5 "]], None, None)]), ("c", None, None)]
    df = spark.createDataFrame(rows, f"doc_id string, text string, doc_tables {kind}")
    got = {r.id: r for r in M.clean_texts(df, "doc_id", "text", "doc_tables").collect()}
    want = [["Measure", "FY2024", None], ["Tooling", "Data margin", "$5,123"], None, ["Feed cost", "Total", "R & D"], ["Rail revenue", "cost(1)", "- 5"], []]
    (first, second, third) = got["a"].doc_tables
    assert first.grid == want and (first.caption, first.char_start) == ("<i>x</i>", 3) and second is None and third.grid is None
    assert got["a"].clean == "Plain text." and got["a"].n_marked == 7
    assert got["b"].doc_tables[0].grid == [["R & D", " 5 "]] and got["b"].clean == "A b." and got["b"].n_marked == 1
    assert got["c"].doc_tables is None and got["c"].clean is None
    assert {r.id: r.n_marked for r in M.marked_records(df, "doc_id", "text", "doc_tables").collect()} == {i: r.n_marked for i, r in got.items()}
