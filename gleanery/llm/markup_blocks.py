"""Problem 4: markup residue in texts.

Method: recurrent block labeller. A text is a sequence of leaves, its non-blank lines (HTML lines of several blocks are
cut between them), each with the path of elements, environments and fences that are open there. A leaf's vector has
hashed tags of the path, hashed words, its signs (runs of characters that markup uses, with what stands on either side,
in places learned with the network) and its layout. A bidirectional LSTM in numpy, fitted on a bounded number
(block_model.TRAIN_DOCUMENTS) of synthetic documents about other matters, reads the vectors of the whole document and
gives every leaf a kind (paragraph, heading, list, table, code, formula, frame) and a chance of markup. The network
decides: a leaf has markup if its score is above FLAG; nothing checks it afterwards.

clean() uses the kinds: headings, lists, tables, code and formulas are written in one plain notation and marks inside
lines are taken out; formulas inside lines stay as they are. No word of the text is lost: frames are dropped only where
they have no words of their own. Not words of the text are scripts, styles, page titles, comments, names of commands,
environments, templates and their options. Cells of tables are leaves too; clean_cell() writes each in the same
notation, but never drops one, since its place in the grid is its kind.

Defined results: null and blank texts have no leaves and no markup; null cells and rows of a table are empty; a text
or cell without markup is returned as it is, and so are null tables, rows and cells.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.llm import block_model
from gleanery.llm.markup import ENTITY, REFERENCE, TAG, plain_words, unescape
from gleanery.llm.textform import consistent_form
from gleanery.llm.words import WORD

PATH_DIMS, WORD_DIMS, SIGN_DIMS, SHAPE_DIMS = 16, 16, 352, 15
INPUTS = PATH_DIMS + WORD_DIMS + SIGN_DIMS + SHAPE_DIMS
#: The score, a chance of markup of 5 %, from which a leaf counts as marked.
FLAG = -3.0
#: A sign is an entity, a run of one character that markup uses, or a number or dash before a blank at the start.
_SIGN = re.compile(r"&(?:\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|([<>&*_~`#=|{}\\^$%!\[\]])\1*|'{2,}|-{3,}|(?<!\S)[-+](?=\s)|\A\d{1,3}[.)](?=\s)".replace("\\#", "#"))
_OPEN_CLOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(/?)>|```|\$\$|\\(begin|end)\{([A-Za-z*]+)\}|^\{\||^\|\}|\{\{Infobox|^\}\}")
_VOID = frozenset("br hr img input link meta ref p li td tr th".split())
_UNREAD = frozenset(("script", "style"))


class _WordSlots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = k = xxhash.xxh32_intdigest(word) % (2 * WORD_DIMS)
        return k


_SLOTS = _WordSlots()


#: Where an HTML line with several blocks is cut, plain and escaped.
_BLOCK_START = re.compile(r"(?<=\S)[ \t]*(?=<(?:table|caption|tr|ul|ol|li|dl|dt|dd|h[1-6]|p|div|pre|blockquote)\b[^<>]*>)", re.I)
_BLOCK_END = re.compile(r"(</(?:table|caption|tr|ul|ol|li|dl|dt|dd|h[1-6]|p|div|pre|blockquote)>)[ \t]*(?=\S)", re.I)
_ESCAPED_START = re.compile(r"(?<=\S)[ \t]*(?=&lt;(?:table|caption|tr|ul|ol|li|dl|dt|dd|h[1-6]|p|div|pre|blockquote)(?:\s[^<>&]*)?&gt;)", re.I)
_ESCAPED_END = re.compile(r"(&lt;/(?:table|caption|tr|ul|ol|li|dl|dt|dd|h[1-6]|p|div|pre|blockquote)&gt;)[ \t]*(?=\S)", re.I)


def leaves(text: str | None) -> list[str]:
    """The non-blank lines of the consistent form; a line of several HTML blocks is cut between them."""
    if not text:
        return []
    text = consistent_form(text)
    if "</" in text:
        text = _BLOCK_END.sub(r"\1\n", _BLOCK_START.sub("\n", text))
    if "&lt;/" in text:
        text = _ESCAPED_END.sub(r"\1\n", _ESCAPED_START.sub("\n", text))
    return [line for line in text.split("\n") if line and not line.isspace()]


class _NameVectors(dict):
    """name of a structure -> its signed place in a path vector."""

    def __missing__(self, name: str) -> tuple[int, float]:
        if len(self) > 100_000:
            self.clear()
        h = xxhash.xxh32_intdigest(name)
        self[name] = out = (h % PATH_DIMS, 1.0 if h >> 16 & 1 else -1.0)
        return out


_NAMES = _NameVectors()


def paths(lines: list[str]) -> tuple[np.ndarray, list[bool]]:
    """The path of open structures at the start of each line as a sum of the vectors of their names, and whether the
    line is inside a script or style."""
    out = np.zeros((len(lines), PATH_DIMS), dtype=np.float32)
    unread = []
    stack: list[str] = []
    held: Counter = Counter()
    here = np.zeros(PATH_DIMS, dtype=np.float32)

    def push(name: str, sign: float = 1.0) -> None:
        place, value = _NAMES[name]
        here[place] += sign * value

    def opened(name: str) -> None:
        stack.append(name)
        held[name] += 1
        push(name)

    def closed(name: str) -> None:
        while held[name]:
            top = stack.pop()
            held[top] -= 1
            push(top, -1.0)
            if top == name:
                break

    for k, line in enumerate(lines):
        out[k] = here
        unread.append(any(held[name] for name in _UNREAD))
        if "<" in line or "`" in line or "$$" in line or "\\" in line or "{" in line or "|" in line or "}" in line or "&lt;" in line:
            for m in _OPEN_CLOSE.finditer(html.unescape(line) if "&lt;" in line else line):
                t = m.group()
                if m.group(2):
                    name = m.group(2).lower()
                    if not m.group(3) and name not in _VOID:
                        closed(name) if m.group(1) else opened(name)
                elif t in ("```", "$$"):
                    closed(t) if held[t] else opened(t)
                elif m.group(4) == "begin" or t in ("{|", "{{Infobox"):
                    opened(m.group(5) or t)
                else:
                    closed(m.group(5) or ("{|" if t == "|}" else "{{Infobox"))
    return out, unread


_SIGNS = frozenset("<>&*_~`#=|{}\\^$%![]('")


def _beside(c: str) -> str:
    """The class of a character beside a sign: none, letter, digit, blank, another sign or punctuation."""
    return "^" if not c else "a" if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else c if c in _SIGNS else "."


def signs(line: str) -> list[str]:
    """The signs of a line, each with what stands before and behind it."""
    out = []
    for m in _SIGN.finditer(line):
        t, at, end = m.group(), m.start(), m.end()
        if t[0] == "&" and len(t) > 2 and t[-1] == ";":
            if t[1] == "#" or t[1:] in html.entities.html5:
                out.append("&;")
                continue
            t, end = "&", at + 1
        out.append(f"{_beside(line[at - 1 : at])}{'1.' if t[0].isdigit() else t[:6]}{_beside(line[end : end + 1])}")
    return out


def sign_places(documents: list[list[str]]) -> dict[str, int]:
    """The signs of the documents to learn from, the most frequent first, with their places."""
    counts = Counter(x for d in documents for x in {x for line in d for x in signs(_zeros(line))})
    known = sorted((x for x, n in counts.items() if n >= 2), key=lambda x: (-counts[x], x))
    return {x: k for k, x in enumerate(known[:SIGN_DIMS])}


_ZEROS = bytes.maketrans(b"123456789", b"0" * 9)


def _zeros(line: str) -> str:
    """The line with every digit as 0: which figures it has says nothing about its kind."""
    return line.encode("utf-8", "surrogatepass").translate(_ZEROS).decode("utf-8", "surrogatepass")


class _Leaf:
    """What the vector of a leaf takes from its line alone."""

    __slots__ = ("places", "shape", "words")

    def __init__(self, line: str, places: dict[str, int]):
        words = WORD.findall(line.lower())
        self.words = [_SLOTS[w] for w in words]
        self.places = [k for k in map(places.get, signs(line)) if k is not None]
        last, length, first = line.rstrip()[-1:], len(line), line[0]
        self.shape = (length / 200 if length < 400 else 2.0, last in ".!?", first == "•", " | " in line, first == " ", first.isdigit(), first.isupper(), len(words) <= 6, last in ";:)}]", last == ">", first == "<" or line[:4] == "&lt;", not words)


#: Short lines, as in cells, come again and again.
_SHORT, _KEPT = 60, 200_000


def vectors(documents: list[list[str]], places: dict[str, int], kept: dict[str, _Leaf] | None = None) -> list[np.ndarray]:
    """The vectors of the leaves of each document: path, hashed words, signs and layout."""
    kept = {} if kept is None else kept
    n = sum(map(len, documents))
    x = np.zeros((n, INPUTS), dtype=np.float32)
    if not n:
        return [x[:0] for _ in documents]
    slots, counts, shapes, company, found, n_found = [], [], [], [], [], []
    at_signs, at_shape = PATH_DIMS + WORD_DIMS, PATH_DIMS + WORD_DIMS + SIGN_DIMS
    at = 0
    for d in documents:
        if any("<" in s or "`" in s or "$$" in s or "\\" in s or "{" in s or "&lt;" in s for s in d):
            x[at : at + len(d), :PATH_DIMS] = np.clip(paths(d)[0], -8, 8)
        starts = ["", *(line[:2] for line in d), ""]
        sizes = [-9, *(len(line.rstrip()) for line in d)]
        for k, line in enumerate(map(_zeros, d), 1):
            leaf = kept.get(line)
            if leaf is None:
                leaf = _Leaf(line, places)
                if len(line) <= _SHORT and len(kept) < _KEPT:
                    kept[line] = leaf
            slots += leaf.words
            counts.append(len(leaf.words))
            shapes.append(leaf.shape)
            if leaf.places:
                found += leaf.places
                n_found.append((at + k - 1, len(leaf.places)))
            same = starts[k] in (starts[k - 1], starts[k + 1])
            company.append((same, -1 <= sizes[k] - sizes[k - 1] <= 1, same and not line[0].isalnum()))
        at += len(d)
    x[:, at_shape : at_shape + 12] = np.array(shapes, dtype=np.float32)
    x[:, at_shape + 12 :] = np.array(company, dtype=np.float32)
    if found:
        rows, times = np.array(n_found, dtype=np.int64).T
        cells, times = np.unique(np.repeat(rows, times) * SIGN_DIMS + np.array(found, dtype=np.int64), return_counts=True)
        x[cells // SIGN_DIMS, at_signs + cells % SIGN_DIMS] = np.minimum(0.875 + 0.125 * times, 2.0)
    counts = np.array(counts, dtype=np.int64)
    owner = np.repeat(np.arange(n), counts)
    bag = np.bincount(owner * (2 * WORD_DIMS) + np.array(slots, dtype=np.int64), minlength=n * 2 * WORD_DIMS).reshape(n, 2, WORD_DIMS)
    x[:, PATH_DIMS:at_signs] = np.clip((bag[:, 0] - bag[:, 1]) / (3 * np.sqrt(np.maximum(counts, 1)))[:, None], -1, 1)
    return np.split(x, np.cumsum([len(d) for d in documents])[:-1])


#: Leaves that are labelled at a time; a longer document is labelled alone, as a whole.
LEAVES_AT_ONCE = 20_000


def label(model: block_model.BlockLabeller, documents: list[list[str]], kept: dict[str, _Leaf] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Kind index of every leaf of every document, and whether it has markup; ``kept`` keeps what is known of lines."""
    kept = {} if kept is None else kept
    kinds, flags, part, n = [], [], [], 0
    for k, d in enumerate(documents):
        part.append(d)
        n += len(d)
        if n >= LEAVES_AT_ONCE or k == len(documents) - 1:
            for s in model.scores(vectors(part, model.signs, kept)):
                kinds.append(s[:, :-1].argmax(axis=1))
                flags.append(s[:, -1] > FLAG)
            part, n = [], 0
    return kinds, flags


# ---- clean text

_ROW_ENDS = re.compile(r"</?tr\b[^<>]*>|^\s*<t[dh]\b[^<>]*>|</t[dh]\s*>\s*$", re.I)
_CELL_BORDER = re.compile(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", re.I)
_INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*[\\^_][^$\n]*?(?<![\s\\])\$(?![\d$])")
_HELD = "\ue000"


def _plain(text: str) -> str:
    """The words of a piece of a line without marks; formulas inside it stay as they are."""
    if "$" in text and _HELD not in text and (found := _INLINE_MATH.findall(text)):
        parts = plain_words(_INLINE_MATH.sub(_HELD, text)).split(_HELD)
        if len(parts) == len(found) + 1:
            text = "".join(x for pair in zip(parts, [*found, ""]) for x in pair)
    else:
        text = plain_words(text)
    return " ".join(text.split())


def _cells(line: str) -> str:
    """A table row with its cells joined by " | "."""
    line = unescape(line)
    if "<t" in line.lower():
        cells = _CELL_BORDER.split(_ROW_ENDS.sub("", _ROW_ENDS.sub("", line.strip())))
    elif "!!" in line or "||" in line or line[:1] in "!|":
        cells = re.split(r"\|\||!!|\|", line.strip().strip("!|"))
    elif line.rstrip().endswith("\\\\"):
        cells = re.split(r"(?<!\\)&", line.rstrip()[:-2])
    else:
        return _plain(line)
    return " | ".join(map(_plain, cells)).strip()


_FORMULA_MARKS = re.compile(r"</?math>|\\\[|\\\]|\$\$|\\(?:begin|end)\{[A-Za-z*]+\}|</?p\b[^<>]*>|&lt;/?(?:math|p)\b.*?&gt;")
_UNDERLINE = re.compile(r"([=-])\1{2,}\s*$")
#: Lines of frames without words of their own: comments, borders of tables, first and last lines of templates.
_BARE = re.compile(r"%\s|\{\||\|[-}]|\{\{[^|{}]*$|\}\}\s*$")
_BOX_LINE = re.compile(r"\|\s*(\w[\w ]*?)\s*=\s*(.*)$")
_FENCE = re.compile(r"```.*$")


def _frame_words(line: str) -> str:
    """What a frame says itself."""
    text = unescape(line).strip()
    if _BARE.match(text) or _FENCE.match(text):
        return ""
    if m := _BOX_LINE.match(text):
        return f"{m.group(1)} | {_plain(m.group(2))}".rstrip(" |")
    text = _plain(text.removeprefix("|+"))
    return text if WORD.search(text) else ""


def clean(lines: list[str], kinds: np.ndarray, marked: np.ndarray) -> str:
    """Clean text of a document from the kinds and flags of its leaves."""
    out: list[tuple[str, str]] = []
    open_code = False
    unread = paths(lines)[1]
    put = lambda kind, *texts: out.extend((kind, x) for x in texts if x)
    for k, line in enumerate(lines):
        if unread[k]:
            continue
        kind = block_model.KINDS[kinds[k]]
        if open_code and (kind != "code" or not marked[k]):
            put("code", "```")
            open_code = False
        if not marked[k]:
            put(kind, line)
        elif kind == "frame":
            if (m := _UNDERLINE.match(line)) and out and k and not marked[k - 1] and out[-1][1] == lines[k - 1]:
                out[-1] = ("heading", ("# " if m.group(1) == "=" else "## ") + lines[k - 1].strip())
            else:
                put("table" if _BOX_LINE.match(line) else "paragraph", _frame_words(line))
        elif kind == "code":
            text = re.sub(r"</?(?:pre|code|syntaxhighlight)\b[^<>]*>", "", unescape(line))
            if text.strip() and not _FENCE.match(text):
                if not open_code:
                    put("code", "```")
                    open_code = True
                put("code", text)
        elif kind == "heading":
            text = unescape(line).strip()
            level = re.match(r"#+|=+|<h([1-6])|\\((?:sub)*)section", text)
            depth = 1 if not level else int(level.group(1)) if level.group(1) else 1 + (level.group(2) or "").count("sub") if level.group(2) is not None else len(level.group()) - (text[0] == "=")
            text = _plain(re.sub(r"^[#=]+|=+\s*$|^\|\+", "", text))
            put("heading", text and "#" * max(1, min(6, depth)) + " " + text)
        elif kind == "list":
            text = _plain(re.sub(r"^\s*(?:[*#+-]+(?=\s)|\d+[.)]|\\item\b|•)\s*", "", unescape(line)))
            put("list", text and "- " + text)
        elif kind == "table":
            put("table", _cells(line))
        elif kind == "formula":
            text = REFERENCE.sub("", unescape(line))
            text = re.sub(r"<sub>(.*?)</sub>", r"_{\1}", re.sub(r"<sup>(.*?)</sup>", r"^{\1}", text))
            text = TAG.sub("", _FORMULA_MARKS.sub("", text)).strip()
            put("formula", text and "$" + text.strip("$ ") + "$")
        else:
            # a block mark in a line ends a paragraph
            put("paragraph", *map(_plain, plain_words(line).split("\n") if "$" not in line else [line]))
    if open_code:
        put("code", "```")
    text = []
    for k, (kind, line) in enumerate(out):
        if k:
            text.append("\n" if kind == out[k - 1][0] and kind in ("list", "table", "code") else "\n\n")
        text.append(line)
    return "".join(text)


_MATH = re.compile(r"</?math>|\\\[|\\\]|\$\$|&lt;/?math&gt;")
_TITLE_SIGNS = re.compile(r"^\#{1,6} (?=\S)|^={2,6}(?=[^=]+={2,6}\s*$)|(?<=[^=])={2,6}\s*$|^(?:={3,}|-{3,})\s*$")
_KIND = {kind: k for k, kind in enumerate(block_model.KINDS)}


def clean_cell(lines: list[str], kinds: np.ndarray, marked: np.ndarray) -> str | None:
    """Clean text of a table cell; None where its lines have no mark.

    A line alone in its cell is part of a table whatever kind it looks like, or a formula. Lines of a longer cell may
    be lists or code as well; headings and frames are only so in a text.
    """
    if not marked.any():
        return None
    inside = ("list", "code") if len(lines) > 1 else ()
    forms = [int(kinds[k]) if block_model.KINDS[kinds[k]] in inside else _KIND["formula" if _MATH.search(line) else "table"] for k, line in enumerate(lines)]
    plain = [_TITLE_SIGNS.sub("", line).strip() if mark and form == _KIND["table"] else line for line, mark, form in zip(lines, marked, forms)]
    kept = [k for k, line in enumerate(plain) if line]
    text = clean([plain[k] for k in kept], np.array([forms[k] for k in kept], dtype=int), np.array([marked[k] for k in kept], dtype=bool))
    return text if _KIND["code"] in forms else "\n".join(" ".join(line.split()) for line in text.split("\n"))


# ---- operators


def _documents(texts: list[str | None], grids: list | None) -> list[list[str]]:
    """The leaves of each record: those of its text, then its table cells as leaves of their own."""
    out = []
    for k, text in enumerate(texts):
        lines = leaves(text)
        if grids:
            for table in grids[k] or []:
                for row in table or []:
                    lines += [line for cell in row or [] if cell for line in leaves(cell)]
        out.append(lines)
    return out


def marked_records(df: DataFrame, id_col: str, text_col: str, tables_col: str | None = None) -> DataFrame:
    """(id, n_leaves, n_marked): every record with its leaves and those of them that have markup."""
    shared = df.sparkSession.sparkContext.broadcast(block_model.trained())
    columns = [F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")]
    if tables_col:
        columns.append(F.transform(tables_col, lambda t: t.grid).alias("grids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = shared.value, {}
        for batch in batches:
            documents = _documents(batch.column(1).to_pylist(), batch.column(2).to_pylist() if tables_col else None)
            n_marked = [int(f.sum()) for f in label(model, documents, kept)[1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, documents)), pa.int32()), pa.array(n_marked, pa.int32())], names=["id", "n_leaves", "n_marked"])

    return df.select(*columns).mapInArrow(run, "id string, n_leaves int, n_marked int")


def _clean_tables(tables: list | None, kinds: np.ndarray, flags: np.ndarray) -> list | None:
    """The tables of a record with clean cells; kinds and flags are those of the leaves of all its cells in order."""
    out, at = [], 0
    for table in tables or []:
        grid = []
        for row in (table or {}).get("grid") or []:
            cells = []
            for cell in row or []:
                lines = leaves(cell)
                own = slice(at, at := at + len(lines))
                text = clean_cell(lines, kinds[own], flags[own]) if flags[own].any() else None
                cells.append(cell if text is None else text)
            grid.append(cells if row is not None else None)
        out.append(table | {"grid": grid} if table and table["grid"] is not None else table)
    return out if tables is not None else None


def clean_texts(df: DataFrame, id_col: str, text_col: str, tables_col: str | None = None) -> DataFrame:
    """(id, clean, n_marked): the clean text of every record; a record without markup keeps its text.

    With ``tables_col`` the tables of the record too, under that name and in their shape, with clean cells; n_marked
    then counts the leaves of the cells as well.
    """
    shared = df.sparkSession.sparkContext.broadcast(block_model.trained())
    columns = [F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")]
    schema = StructType().add("id", "string").add("clean", "string").add("n_marked", "integer")
    if tables_col:
        columns.append(F.col(tables_col).alias("tables"))
        schema = schema.add(tables_col, df.schema[tables_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = shared.value, {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = len(texts)
            documents = [leaves(t) for t in texts]
            if tables_col:
                tables = batch.column(2).to_pylist()
                documents += _documents([None] * n, [[t and t["grid"] for t in ts or []] for ts in tables])
            kinds, flags = label(model, documents, kept)
            n_marked = [int(f.sum()) for f in flags]
            cleaned = [clean(d, k, f) if m else t for t, d, k, f, m in zip(texts, documents, kinds, flags, n_marked)]
            columns = [batch.column(0), pa.array(cleaned, pa.string())]
            if tables_col:
                columns.append(pa.array([a + b for a, b in zip(n_marked[:n], n_marked[n:])], pa.int32()))
                grids = [_clean_tables(ts, k, f) if m else ts for ts, k, f, m in zip(tables, kinds[n:], flags[n:], n_marked[n:])]
                columns.append(pa.array(grids, batch.column(2).type))
            else:
                columns.append(pa.array(n_marked, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*columns).mapInArrow(run, schema)
