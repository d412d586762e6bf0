"""A bidirectional LSTM in numpy that labels every block of a document, and the synthetic documents it learns from."""

from __future__ import annotations

import html
import random
from functools import lru_cache

import numpy as np

KINDS = ("paragraph", "heading", "list", "table", "code", "formula", "frame")
HIDDEN = 24
TRAIN_DOCUMENTS = 4000
EPOCHS = 12
SEED = 11
WORD_NOISE = 0.15


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Two LSTMs over a sequence of block vectors, one in each direction, and two heads on both states."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.signs: dict[str, int] = {}  # places of the sign features, see markup_blocks.vectors
        self.p = {}
        for d in "fb":
            self.p["W" + d] = draw(inputs, 4 * hidden)
            self.p["U" + d] = draw(hidden, 4 * hidden)
            self.p["c" + d] = np.zeros(4 * hidden, dtype=np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1.0
        self.p["V"] = draw(2 * hidden, len(KINDS) + 1)
        self.p["v"] = np.zeros(len(KINDS) + 1, dtype=np.float32)

    def _steps(self, z: np.ndarray, lengths: np.ndarray, d: str, reverse: bool, keep: list | None = None) -> np.ndarray:
        """Hidden states; z is (sequences, steps, 4 * hidden), sequences by falling length."""
        h = self.hidden
        out = np.zeros((*z.shape[:2], h), dtype=np.float32)
        hs, cs = np.zeros((len(z), h), dtype=np.float32), np.zeros((len(z), h), dtype=np.float32)
        steps = range(z.shape[1])
        for t in reversed(steps) if reverse else steps:
            n = int(np.searchsorted(-lengths, -t, "left"))  # sequences longer than t
            if not n:
                continue
            a = z[:n, t] + hs[:n] @ self.p["U" + d]
            gates = _sigmoid(a[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(a[:, 3 * h :])
            before_h, before_c = hs[:n].copy(), cs[:n].copy()
            cs[:n] = f * cs[:n] + i * g
            tc = np.tanh(cs[:n])
            hs[:n] = o * tc
            out[:n, t] = hs[:n]
            if keep is not None:
                keep.append((t, n, i.copy(), f.copy(), o.copy(), g, before_h, before_c, tc))
        return out

    def states(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = []
        for d, reverse in (("f", False), ("b", True)):
            steps = [] if keep is not None else None
            both.append(self._steps(x @ self.p["W" + d] + self.p["c" + d], lengths, d, reverse, steps))
            if keep is not None:
                keep[d] = steps
        return np.concatenate(both, axis=2)

    def _padded_states(self, sequences: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """The states of sequences by falling length; only what the blocks give to the gates is padded."""
        flat, both = np.concatenate(sequences), []
        at = (np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths]))
        for d, reverse in (("f", False), ("b", True)):
            z = np.zeros((len(lengths), max(1, int(lengths[0])), 4 * self.hidden), dtype=np.float32)
            z[at] = flat @ self.p["W" + d] + self.p["c" + d]
            both.append(self._steps(z, lengths, d, reverse))
        return np.concatenate(both, axis=2)

    def scores(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each sequence of block vectors the logits of the kinds and, last, of markup."""
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        out: list[np.ndarray] = [np.zeros((0, len(KINDS) + 1), dtype=np.float32)] * len(sequences)
        at = 0
        while at < len(order):
            # sequences of like length together: padding stays below the size of the batch
            longest = max(1, len(sequences[order[at]]))
            part = order[at : at + max(16, 40_000 // longest)]
            at += len(part)
            lengths = np.array([len(sequences[k]) for k in part])
            y = self._padded_states([sequences[k] for k in part], lengths) @ self.p["V"] + self.p["v"]
            for row, k in enumerate(part):
                out[k] = y[row, : lengths[row]]
        return out

    def gradients(self, x: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, marked: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a padded batch; kinds is -1 where there is no block."""
        h, kept = self.hidden, {}
        s = self.states(x, lengths, kept)
        y = s @ self.p["V"] + self.p["v"]
        real = kinds >= 0
        n = max(1, real.sum())
        e = np.exp(y[..., :-1] - y[..., :-1].max(axis=2, keepdims=True))
        q = e / e.sum(axis=2, keepdims=True)
        m = _sigmoid(y[..., -1])
        dy = np.zeros_like(y)
        dy[..., :-1] = q
        b, t = np.nonzero(real)
        dy[b, t, kinds[real]] -= 1
        dy[..., -1] = 2 * (m - marked)
        dy *= real[..., None] / n
        picked = q[b, t, kinds[real]]
        loss = float(-np.log(picked + 1e-12).sum() / n - 2 * (np.log(np.where(marked > 0, m, 1 - m) + 1e-12) * real).sum() / n)
        grad = {"V": np.einsum("bth,btk->hk", s, dy), "v": dy.sum(axis=(0, 1))}
        ds = dy @ self.p["V"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            gates = np.zeros((*x.shape[:2], 4 * h), dtype=x.dtype)  # what reaches the gates; the weights get it at once
            states = np.zeros((*x.shape[:2], h), dtype=x.dtype)
            dh, dcell = np.zeros((len(x), h), dtype=np.float32), np.zeros((len(x), h), dtype=np.float32)
            for t, k, i, f, o, g, before_h, before_c, tc in reversed(kept[d]):
                dht = ds[:k, t, part] + dh[:k]
                dct = dcell[:k] + dht * o * (1 - tc * tc)
                gates[:k, t] = da = np.concatenate([dct * g * i * (1 - i), dct * before_c * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                states[:k, t] = before_h
                dh[:k] = da @ self.p["U" + d].T
                dcell[:k] = dct * f
            flat = gates.reshape(-1, 4 * h)
            grad |= {"W" + d: x.reshape(-1, x.shape[2]).T @ flat, "U" + d: states.reshape(-1, h).T @ flat, "c" + d: flat.sum(axis=0)}
        return loss, grad


# ---- documents to learn from: everyday matters, in no way like the collection that is labelled

_SUBJECTS = "The gardener|A flock of geese|Our choir|The night train|Rain and hail|The baker's oven|An old lighthouse|The R&B band|Tea & cake|Das Orchester|Der Leuchtturm|La rivière|Les pommiers|La biblioteca|El tranvía|Старый мост|Хор школы|The Smith-Jones twins|Nobody in town".split("|")
_VERBS = "waited for|painted|never reached|has borrowed|may keep|was hidden behind|sang about|is older than|wartet auf|fand|a perdu|cherche|espera|encontró|ждёт|построил|will open before|counted".split("|")
_OBJECTS = "the wooden gate|seven lanterns|12 kg of flour|a map of 1804|$3 worth of apples|40% of the seeds|€5 a ticket|the lake's north shore|No. 9|3.5 litres of milk|die blauen Türen|un pont de pierre|la plaza vieja|зелёный сад|room B-12|two half-empty jars|a well-known song".split("|")
_TAILS = " after sunset|, although it snowed| in May 1931|, as chapter 4 tells|; nobody minded| near the harbour (on foot)|, wie man sagt|, dit-on|, según dicen|, говорят|||| at 6:30|, e.g. on Sundays".split("|")
_ONSETS, _VOWELS, _CODAS = "b c d f g h k l m n p r s t v w z ch st tr б в д к м п р с т".split(" ") + [""] * 3, "a e i o u ei ou é ü а е и о".split(" "), ["", "", "n", "r", "s", "t", "l", "й", "ng"]
#: Sentences with signs that are no markup.
_TRAPS = (
    "Keep it at < 8 degrees and > 2 degrees.|If x < 3 or y > 9, stop.|Seats marked * are cold, those marked ** are colder.|The guest (see [3]) left early.|Ask for {name} or {place} at the desk.|The value of max_row_count is 7.|"
    "Song #4 and song #12 were cut.|It costs $2 here and $9 there.|It weighs ~3 kg, i.e. ~5% more.|He wrote: [...] and so on.|Bed & breakfast, R&B, black&white.|Mail us @ the usual place, 50% off!|A + B = C, 2 * 3 = 6 and 2^5 = 32.|"
    "Terms and/or conditions | see below.|The path C:\\ is full.|On a scale of 1-10 - or so - it was 7.|{ and } are braces, [ and ] are brackets.|Read file_a and file_b_2 first.|Profit = price - cost.|He said 'no' and \"yes\".|"
    "Well ... who knows! (Not I.)|Add salt* and pepper.|Temperature -5 to +5.|Q&A: who? A: me; B: you.|Rated 5/5, #1 in town, 100% wool.|Part [12] and note [a].|Prices in $ and %.|Room {12} is free.|It was 3 * 4 m wide.|The rest was torn [here.|Then they left (more|and so [cut|He paid [sic] 5.|The {end.|An empty pair [] or {}.|It is 5<6 and 7>6.|50%-60% of it, $5-$6 each.|* see the last page|** not on Mondays|- none -|-- 7 --|*** sold out ***"
).split("|")
_TITLES = "How to Plant Tulips|Winter, 1931|The Old Harbour|Item 3. Boats|Songs and Dances|Part II: The Lake|Opening Hours|Über den Fluss|Las Flores|Вечер в саду|Index|Staff".split("|")
_FOOTERS = "Sheet 3 of 12|- FIN -|* closed on Mondays|[this side left blank]|/s/ A. Gardener, Warden|CONTENTS|(drawn by hand)|— 7 —|=|--|Tel. +44 20 7946".split("|")
_CODE = [
    "total = add(left, right, step=2)\nif total < 0.4:\n    return None", "SELECT name, age FROM cats WHERE age <> 3", "for bird in flock:\n    song = bird.sing(times=5)\n    print(len(song))", "speed: 0.5\nmode: quiet\ncolours: [red, blue]",
    "run --fast --level 3 a.txt", "x = {'a': 1, 'b': [2, 3]}\nassert x['a'] == 1", "int f(int *p) { return *p + 1; }", "let n = items.len();\nwhile n > 0 && ok { n -= 1; }",
]
_FORMULAS = ["a^2 + b^2 = c^2", "v_{t} = \\frac{s_{t} - s_{0}}{t}", "y = \\sum_{i=1}^n \\beta_i x_i", "\\Omega = q_{1} - q_{0}", "f(x,y) = \\int_{0}^{1} \\log\\frac{x}{y_t}", "E = m c^2", "n \\geq 0.5"]
_CELLS = "Tulips|Oak 40|Blue Door|north shore|Cats|Night Train fare|n/a|-|12|3,415|$7|$6,100|4.5%|(12)|+3|—|R & B|A/B|1931|FY 12|Total".split("|")


@lru_cache(maxsize=1)
def _words() -> list[str]:
    """Words without a meaning, a fifth of them capitalised."""
    r = random.Random(SEED)
    syllable = lambda: r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS)
    words = ["".join(syllable() for _ in range(r.randint(1, 4))) for _ in range(6000)]
    return [w.capitalize() if k % 5 == 0 else w for k, w in enumerate(words)]


class _Writer:
    """Writes one synthetic document, a block a line, with the kind and markup of each."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.lines: list[tuple[str, str, bool]] = []

    def add(self, text: str, kind: str, marked: bool) -> None:
        self.lines += [(line, kind, marked) for line in text.split("\n")]

    def word(self) -> str:
        """A word that means nothing, so that no word stands for markup."""
        return self.rng.choice(_words())

    def amount(self) -> str:
        r = self.rng
        n = r.choice([f"{r.randint(1, 99)}", f"{r.randint(1, 999)},{r.randint(100, 999)}", f"{r.randint(0, 99)}.{r.randint(1, 99)}"])
        return r.choice([f"${n}", f"${n}", f"€{n}", f"{n}%", n, f"{n} kg", f"£{n}"])

    def sentence(self) -> str:
        r = self.rng
        if r.random() < 0.3:
            return f"{r.choice(_SUBJECTS)} {r.choice(_VERBS)} {r.choice(_OBJECTS)}{r.choice(_TAILS)}."
        words = [self.amount() if r.random() < 0.15 else self.word() + ("," if r.random() < 0.1 else "-" + self.word() if r.random() < 0.05 else "") for _ in range(r.randint(3, 22))]
        return " ".join(words).rstrip(",").capitalize() + "."

    def prose(self, inline: list[str] | None = None, strays: int = 0) -> tuple[str, bool]:
        """Sentences; ``inline`` are patterns with %s for a word, of which ``strays`` are put in."""
        r = self.rng
        words = " ".join(self.sentence() if r.random() < 0.85 else r.choice(_TRAPS) for _ in range(r.choice((1, 1, 2, 3, 4, 6, 12)))).split(" ")
        if r.random() < 0.15:
            words = words[: r.randint(2, 6)]
        put = False
        for _ in range(strays if inline else 0):
            k = r.randrange(len(words))
            n = r.choice((1, 1, 1, 2, 3))
            chosen = words[k : k + n]
            if all(w.strip(",.;").isalnum() for w in chosen):
                words[k : k + n] = r.choice(inline).replace("%s", " ".join(chosen).strip(",.;"), 1).split(" ")
                put = True
        text = " ".join(words)
        return text, put

    def phrase(self) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(1, 6)))

    def grid(self) -> list[list[str]]:
        r = self.rng
        n = r.randint(2, 4)
        return [["Kind", *(f"Year {1 + k}" for k in range(n))], *([r.choice(_CELLS), *(f"{r.choice(['', '', '$', '€'])}{r.randint(1, 99)},{r.randint(100, 999)}" for _ in range(n))] for _ in range(r.randint(2, 5)))]


INLINE = {
    "html": [
        "<b>%s</b>", "<i>%s</i>", "<EM>%s</EM>", "<strong>%s</strong>", "%s<br/>", "%s<br>", "%s&nbsp;more", "&#163;4 %s", "&#xA3;4 %s", "%s <!-- fold here -->", '<a href="x.html#top">%s</a>', '<span class="big">%s</span>', '<font color="red">%s</font>', "%s<sup>2</sup>",
        "%s</td><td>", "&amp; %s", "%s&#8211;", "%s&#160;", "&lt;%s&gt;", "&quot;%s&quot;", "</p>%s", "%s<p>", "<u>%s</u>", "%s&eacute;", "&ndash; %s", '<img src="a.png"/> %s', "<code>%s</code>", "%s<sub>i</sub>",
    ],
    "markdown": ["**%s**", "*%s*", "~~%s~~", "`%s`", "[%s](x.md)", "[%s](#top)", "__%s__", "![%s](a.png)", "***%s***"],
    "wiki": ["'''%s'''", "''%s''", "[[%s]]", "[[Garden|%s]]", "{{small|%s}}", "%s {{source missing}}", '%s<ref name="a" />', "%s<ref>Old book.</ref>", "[[File:a.png|%s]]", "{{lang|de|%s}}"],
    "latex": ["\\textbf{%s}", "\\emph{%s}", "\\underline{%s}", "%s~\\ref{fig:a}", "%s~", "%s\\footnotemark{}", "%s $\\sim$", "$\\alpha$ %s", "5\\% %s", "\\$7 %s", "{\\bf %s}", "{\\it %s}", "\\cite{a1} %s", "%s \\& co", "\\textit{%s}", "%s\\\\", "a\\_%s", "\\#4 %s"],
}


def _write_cells(w: _Writer, every: list[str]) -> None:
    """The cells of tables, each a block, seldom with marks."""
    rng = w.rng
    marked = rng.random() < 0.3
    for _ in range(rng.randint(4, 40)):
        cell = rng.choice(_CELLS) if rng.random() < 0.5 else f"{rng.choice(['', '', '$', '€', '-', '('])}{rng.randint(1, 99)},{rng.randint(100, 999)}"
        if marked and rng.random() < 0.2 and cell[0].isalpha():
            w.add(rng.choice([*every, "&nbsp;%s", "# %s", "## %s"]).replace("%s", cell, 1), "table", True)
        else:
            w.add(cell, "table", False)


def write_document(rng: random.Random) -> list[tuple[str, str, bool]]:
    """(line, kind, has markup) of one document in one of the languages, or plain with a few strays of all."""
    w = _Writer(rng)
    style = rng.choice(["plain", "plain", "plain", "stray", "stray", "html", "html", "escaped", "markdown", "wiki", "latex"])
    language = "html" if style == "escaped" else style
    every = [p for ps in INLINE.values() for p in ps]
    framed = rng.random() < 0.4
    if framed and language == "html":
        w.add(rng.choice(["<html><head><title>Tulips</title><style>b { color: red }</style></head><body>", '<!DOCTYPE html>\n<html lang="en">\n<body>', '<div class="page">', "<body>"]), "frame", True)
    if framed and language == "latex":
        w.add(rng.choice(["% first try\n\\documentclass[a4paper]{book}\n\\usepackage{graphicx}\n\\begin{document}", "\\documentclass{letter}\n\\begin{document}", "\\begin{document}\n\\maketitle", "% to be printed"]), "frame", True)
    if framed and language == "wiki":
        box = rng.choice(["town", "ship", "person", "river"])
        w.add(f"{{{{Infobox {box}\n| name = {rng.choice(_CELLS)}\n| length = {rng.randint(1, 99)}\n}}}}", "frame", True)
    if rng.random() < 0.2 and language == "html":
        w.add(rng.choice(["<!-- fold here -->", "<hr/>", "<br/>"]), "frame", True)
    if style in ("plain", "stray") and rng.random() < 0.2:
        _write_cells(w, every if style == "stray" else [])
    for _ in range(rng.randint(1, 9)):
        kind = rng.choices(["paragraph", "heading", "list", "table", "code", "formula"], [8, 3, 2, 2, 1, 1])[0]
        if language in ("plain", "stray"):
            if kind == "heading":
                if style == "stray" and rng.random() < 0.2:
                    w.add(rng.choice(["# ", "## ", "### "]) + rng.choice(_TITLES), "heading", True)
                else:
                    w.add(rng.choice(_TITLES), "heading", False)
            elif kind == "list" and style == "stray" and rng.random() < 0.4:
                sign = rng.choice(["- ", "- ", "* ", "1. ", "+ "])
                for _ in range(rng.randint(2, 5)):
                    w.add(sign + (w.phrase() if rng.random() < 0.5 else w.sentence()), "list", True)
            elif kind == "list":
                sign = rng.choice(["• ", "• ", "– ", "· ", "a) ", "(1) "])
                for _ in range(rng.randint(2, 5)):
                    text, marked = w.prose(every, 1) if style == "stray" and rng.random() < 0.2 else (w.phrase() if rng.random() < 0.4 else w.sentence(), False)
                    w.add(sign + text.rstrip("."), "list", marked)
            elif kind == "table":
                for row in w.grid():
                    cell = rng.choice(["**%s**", "<b>%s</b>", "\\textbf{%s}", "'''%s'''", "%s<sup>2</sup>", "&nbsp;%s", "[[%s]]"]) if style == "stray" and rng.random() < 0.15 else "%s"
                    w.add(" | ".join([cell % row[0], *row[1:]]), "table", cell != "%s")
            elif kind == "code" and style == "stray" and rng.random() < 0.5:
                w.add(rng.choice([" ", "  "]) + w.sentence(), "paragraph", False)
            elif kind == "paragraph" or style == "plain":
                text, marked = w.prose(every, rng.randint(1, 3)) if style == "stray" and rng.random() < 0.6 else w.prose()
                w.add(text, "paragraph", marked)
            continue
        inline = INLINE[language]
        strays = rng.choice([0, 1, 1, 2, 4])
        if kind == "paragraph":
            text, marked = w.prose(inline, strays)
            if language == "html":
                text, marked = rng.choice(["<p>%s</p>", '<p class="x">%s</p>', "<div>%s</div>", "<P>%s", "%s</p>", "<p>%s", "<blockquote>%s</blockquote>"]).replace("%s", text), True
            w.add(text, "paragraph", marked)
        elif kind == "heading":
            text, level = rng.choice(_TITLES) if rng.random() < 0.7 else w.sentence().rstrip("."), rng.randint(1, 4)
            if language == "markdown" and rng.random() < 0.4:
                w.add(text, "heading", False)
                w.add(rng.choice("=-") * len(text), "frame", True)
            else:
                w.add({"html": f"<h{level}>{text}</h{level}>", "markdown": "#" * level + " " + text, "wiki": "=" * (level + 1) + f" {text} " + "=" * (level + 1), "latex": f"\\{'sub' * (level % 3)}section{{{text}}}"}[language], "heading", True)
        elif kind == "list":
            opening, item, closing = {"html": ("<ul>", "<li>%s</li>", "</ul>"), "markdown": ("", rng.choice(["- %s", "* %s", "1. %s", "+ %s"]), ""), "wiki": ("", rng.choice(["* %s", "# %s"]), ""), "latex": ("\\begin{itemize}", "\\item %s", "\\end{itemize}")}[language]
            short = rng.random() < 0.4
            if opening:
                w.add(opening, "frame", True)
            for _ in range(rng.randint(2, 5)):
                w.add(item.replace("%s", (w.phrase() if short else w.prose(inline, strays)[0]).rstrip(".")), "list", True)
            if closing:
                w.add(closing, "frame", True)
        elif kind == "table":
            grid = w.grid()
            if language == "html":
                head = rng.choice(["td", "th"])
                w.add(rng.choice(["<table>", '<table border="1">']), "frame", True)
                for k, row in enumerate(grid):
                    cell = head if k == 0 else "td"
                    w.add("<tr>" + "".join(f"<{cell}>{c}</{cell}>" for c in row) + "</tr>", "table", True)
                w.add("</table>", "frame", True)
            elif language == "markdown":
                w.add("| " + " | ".join(grid[0]) + " |", "table", True)
                w.add("|" + rng.choice(["---|", ":--|", " --- |"]) * len(grid[0]), "frame", True)
                for row in grid[1:]:
                    w.add("| " + " | ".join(row) + " |", "table", True)
            elif language == "wiki":
                w.add(rng.choice(['{| class="sortable"', "{|"]), "frame", True)
                if rng.random() < 0.4:
                    w.add("|+ " + rng.choice(_TITLES), "heading", True)
                w.add("! " + " !! ".join(grid[0]), "table", True)
                for row in grid[1:]:
                    w.add("|-", "frame", True)
                    w.add("| " + " || ".join(row), "table", True)
                w.add("|}", "frame", True)
            else:
                w.add("\\begin{tabular}{" + rng.choice(["ll", "lrr", "l|c"]) + "}", "frame", True)
                for row in grid:
                    w.add(" & ".join(row).replace("$", "\\$").replace("%", "\\%") + " \\\\", "table", True)
                w.add("\\end{tabular}", "frame", True)
        elif kind == "code":
            code = rng.choice(_CODE)
            if language == "html":
                w.add("<pre><code>" + html.escape(code, quote=False) + "</code></pre>", "code", True)
            else:
                opening, closing = {"markdown": (rng.choice(["```", "```python"]), "```"), "wiki": ('<syntaxhighlight lang="c">' if rng.random() < 0.5 else "<syntaxhighlight>", "</syntaxhighlight>"), "latex": ("\\begin{verbatim}", "\\end{verbatim}")}[language]
                w.add(opening, "frame", True)
                w.add(code, "code", True)
                w.add(closing, "frame", True)
        else:
            f = rng.choice(_FORMULAS)
            if language == "html":
                x, y, z = (rng.choice("abcfghnpqrsvxyzABDEKLNPQSTV") for _ in range(3))
                low, sign = rng.choice(["0", "t", "i", "n", "max"]), rng.choice(["&minus;", "&times;", "+", "&plusmn;", "/"])
                w.add(rng.choice([f"<p>{x}<sub>{low}</sub> = ({y} {sign} {z}) / {y}</p>", f"<p>{x}<sup>2</sup> + {y}<sup>2</sup> &ge; {z}</p>", f"<p>{x}<sub>{low}</sub> {sign} {y} = {z}<sub>{low}</sub></p>"]), "formula", True)
            elif language == "wiki":
                w.add(f"<math>{f}</math>", "formula", True)
            elif language == "latex" and rng.random() < 0.5:
                w.add(f"\\[ {f} \\]", "formula", True)
            else:
                opening, closing = ("$$", "$$") if language == "markdown" else ("\\begin{equation}", "\\end{equation}")
                w.add(opening, "frame", True)
                w.add(f, "formula", True)
                w.add(closing, "frame", True)
    if framed and language in ("html", "latex"):
        w.add({"html": rng.choice(["</body></html>", "</div>", "</html>"]), "latex": "\\end{document}"}[language], "frame", True)
    elif rng.random() < 0.3:
        w.add(rng.choice(_FOOTERS), "paragraph", False)
    lines = w.lines
    if style == "escaped":
        lines = [(html.escape(line, quote=False), kind, True) for line, kind, _ in lines]
    return lines


@lru_cache(maxsize=1)
def trained() -> BlockLabeller:
    """The labeller, fitted on TRAIN_DOCUMENTS synthetic documents by Adam; takes a few seconds, once a process."""
    from gleanery.llm.markup_blocks import INPUTS, PATH_DIMS, WORD_DIMS, sign_places, vectors

    rng = random.Random(SEED)
    documents = [write_document(rng) for _ in range(TRAIN_DOCUMENTS)]
    texts = [[line for line, _, _ in d] for d in documents]
    model = BlockLabeller(INPUTS)
    model.signs = sign_places(texts)
    noise = np.random.default_rng(SEED)
    features = vectors(texts, model.signs)
    order = sorted((k for k in range(len(documents)) if documents[k]), key=lambda k: -len(documents[k]))
    batches = []
    for at in range(0, len(order), 30):
        part = order[at : at + 30]
        lengths = np.array([len(documents[k]) for k in part])
        x = np.zeros((len(part), lengths[0], INPUTS), dtype=np.float32)
        kinds, marked = np.full(x.shape[:2], -1), np.zeros(x.shape[:2], dtype=np.float32)
        for row, k in enumerate(part):
            x[row, : lengths[row]] = features[k]
            kinds[row, : lengths[row]] = [KINDS.index(kind) for _, kind, _ in documents[k]]
            marked[row, : lengths[row]] = [m for _, _, m in documents[k]]
        batches.append((x, lengths, kinds, marked))
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(EPOCHS):
        rng.shuffle(batches)
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for batch in batches:
            x = batch[0].copy()  # the words of other collections are others: noise keeps the network from leaning on them
            x[..., PATH_DIMS : PATH_DIMS + WORD_DIMS] += noise.standard_normal((*x.shape[:2], WORD_DIMS), dtype=np.float32) * WORD_NOISE
            _, grad = model.gradients(x, *batch[1:])
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model
