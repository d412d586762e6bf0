"""Problem 9: texts that lost their end.

Method: structural completeness check with a stack automaton. One pass over the tokens of a text keeps a stack of what
is open: tags, comments, fences, formulas, environments, brackets and quotation marks. Page lines, signatures and
closing tags that follow the running text are taken off first. What is open at the end gives a reason that no final
stop takes back:

* broken_character - the last character is a replacement character or half of a pair, or an escape (\\u00, \\x4, a %XX
                     sequence) stops inside a character;
* open_markup      - inside a tag, a comment or an entity, or a fence, formula, environment or element is not closed;
* open_bracket, open_quote - opened in the last block and not closed, as in "(more" and "[truncated";
* open_number      - a currency sign, or an amount that stops at its decimal point or inside a group of three digits.

With nothing open, the end of the last sentence counts:

* marker           - an ellipsis of two or three dots or a closed remark such as "[truncated]" stands where it breaks off;
* no_terminator    - running text that does not end a sentence, or a list entry that ends in a word or sign that needs
                     another one.

Other list entries, table rows, headings, code, formulas, page lines and signatures need no terminator. A last line of
at most HEADING_CHARS characters that stands alone and is not marked as a heading is one if the same line, figures
aside, stands above other text at least as often as it ends a text, whatever the size of the collection. A missing
terminator is held against the source's baseline: where more than half of a source's running texts end without one it
says nothing, unless the text has a length at which the source cuts; at such a length list entries, rows and headings
without a terminator count as cut too. A source cuts at a length if most of its texts of this length end without a
terminator and these are LIMIT_RATIO times as many as at the lengths around it, so many that among as many rows as the
source has chance gives such a length with a probability below LIMIT_CHANCE. Any length can be a limit, but short texts
repeat by themselves: below REPEATS characters texts of the same ending count once. One or two rows at a limit are no
evidence of it, so a small table may hold rows that can't be told.

Defined results: null and blank texts are whole; a null source is a source of its own; rows with a null id are left
out; a repeated id gives a row for each of its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.markup import plain_words
from gleanery.llm.textform import consistent_form
from gleanery.session import checkpointed

LIMIT_RATIO, LIMIT_CHANCE, REPEATS = 8, 1e-4, 200
HEADING_CHARS = 60
SURE = ("broken_character", "marker", "open_markup", "open_bracket", "open_quote", "open_number")

_MARKER = re.compile(r"\s*(?:…|(?<!\.)\.{2,3}|[(\[<](?:more|truncated|cut off|continued|continues|read more|see more|snip)[)\]>]|(?:read|see) more|\[\+?\d+ (?:more )?char(?:acter)?s\])$", re.I)
#: Whole lines that follow the end of the running text.
_FOOTER = re.compile(
    r"[ ]*(?:\[(?!\.\.\.)[^\[\]]*\]|Page \d+(?: of \d+)?|-+ ?(?:END|\d+) ?-+|\*+ (?:denotes|indicates|marks) .*|/s/ .*|</(?:body|html|div|article|section)>(?:</html>)?|&lt;/(?:body|html)&gt;(?:&lt;/html&gt;)?|\\end\{document\})\s*"
)
# Words that cannot end a list entry.
_DANGLING = frozenset(
    "the a an of and or to for in on at by with from as than that which its our their this under between into der die das und oder von mit für auf im zu den dem des "
    "le la les de du des et ou à un une dans par pour sur el los las del y o en por para con una и или в на с по от до за для из".split()
)
_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|```|\$\$|\\\[|\\\]|\\(?:begin|end)\{[A-Za-z*]*\}|\n[ ]*\n|[(){}\[\]“”„«»「」]|(?<!\w)\"|\"(?!\w)", re.S
)
_CODE_ENVIRONMENTS = frozenset(("verbatim", "lstlisting", "equation", "equation*", "align", "align*", "math", "displaymath"))
_ENVIRONMENTS = _CODE_ENVIRONMENTS | {"itemize", "enumerate", "description", "tabular", "table", "figure", "quote", "abstract"}
_CODE_TAGS = frozenset(("pre", "code", "syntaxhighlight", "source", "math", "script", "style"))
#: Elements that must be closed and stand inside one block, and those that hold several.
_SPAN_TAGS = frozenset("a b i em strong u s span font sup sub small".split())
_GROUP_TAGS = frozenset("table ul ol dl blockquote".split())
_FORMULAS = frozenset(("$$", "["))
_CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "」": "「", "”": "“"}
_TERMINATED = re.compile(r"[.!?。？！](?:[)\]}\"'”’»*_~`]|\s)*$")
_OPEN_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]*|/|!-*[^<>]*)?$")
_OPEN_ENTITY = re.compile(r"&(?:#[xX]?[0-9a-fA-F]*|amp|amp;#?\w*|[a-z]{1,6})$")
_OPEN_AMOUNT = re.compile(r"[$€£]$|[$€£]\d{1,3}\.$|\d,\d{0,2}$")
_LIST = re.compile(r"\s*(?:[•*+\-–·]|\d+[.)]|[a-z][.)])\s|\s*(?:<li\b|&lt;li\b|\\item\b)")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|={1,6}[^=]+={1,6}\s*$|[=\-]{3,}\s*$|<h[1-6]\b|&lt;h[1-6]|\\(?:sub)*section)")
#: An escape that stops inside a character: \\u and \\x short of digits, and bytes in %XX that want more.
_OPEN_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{0,3}$|\\x[0-9a-fA-F]?$|(?:%[0-9A-Fa-f]{2})+(?:%[0-9A-Fa-f]?)$|(?:%[89A-Fa-f][0-9A-Fa-f])+$")
_FORMULA = re.compile(r"(?:\$\$|</math>|\\\]|\\end\{[a-z*]+\}|</code>|</pre>|</syntaxhighlight>|```|&lt;/pre&gt;|&lt;/code&gt;)\s*$|<sub>|&lt;sub&gt;")
_CODE_LINE = re.compile(r"(?:[{};]|\)|:)\s*$|^\s*[\w.]+\s*=\s*\S+$|^\s{4,}\S")


def automaton(text: str) -> tuple[list[str], list[str]]:
    """(structures, brackets and quotation marks) that are open at the end of a text.

    A blank line ends a block. Brackets, marks, formulas and elements inside a line that a block leaves open are slips
    of its writer, not the end of the text, so they are dropped there; fences, environments and elements that hold
    several blocks stay open. Nothing is opened or closed inside code and formulas but by their own end.
    """
    structures: list[str] = []
    marks: list[str] = []
    inside = 0  # open structures whose content is no running text

    def opened(name: str, verbatim: bool) -> None:
        nonlocal inside
        structures.append(name)
        inside += verbatim

    def closed(name: str, verbatim: bool) -> None:
        nonlocal inside
        if name in structures:
            del structures[len(structures) - 1 - structures[::-1].index(name)]
            inside -= verbatim

    for m in _TOKENS.finditer(text):
        t = m.group()
        c = t[0]
        if c == "\n":
            marks.clear()
            for name in [x for x in structures if x in _FORMULAS or x in _SPAN_TAGS]:
                closed(name, name in _FORMULAS)
        elif c == "<":
            if t.startswith("<!--"):
                if not t.endswith("-->"):
                    structures.append("comment")
                continue
            name = re.match(r"</?([A-Za-z0-9]+)", t).group(1).lower()
            verbatim = name in _CODE_TAGS
            if not t.endswith("/>") and (verbatim or (not inside and name in _SPAN_TAGS | _GROUP_TAGS)):
                closed(name, verbatim) if t[1] == "/" else opened(name, verbatim)
        elif c == "`" or t == "$$":
            closed(t, True) if t in structures else opened(t, True) if not inside else None
        elif c == "\\":
            name = t[t.index("{") + 1 : -1] if "{" in t else "["
            if name == "[" or name in _ENVIRONMENTS:
                verbatim = name == "[" or name in _CODE_ENVIRONMENTS
                opened(name, verbatim) if t.startswith("\\begin") or t == "\\[" else closed(name, verbatim)
        elif inside:
            continue
        elif t == "“" and "„" in marks:
            marks.remove("„")
        elif t in "([{“„«「":
            marks.append(t)
        elif t == '"':
            marks.remove(t) if t in marks else marks.append(t)
        elif marks and marks[-1] in (("“", "„") if t == "”" else (_CLOSES[t],)):
            marks.pop()
    return structures, marks


def _broken(text: str) -> bool:
    if text[-1] == "\ufffd" or "\ud800" <= text[-1] <= "\udfff":
        return True
    m = _OPEN_ESCAPE.search(text[-64:])  # an escape has at most twelve signs
    if not m:
        return False
    if m.group()[0] == "\\" or not re.fullmatch(r"(?:%[0-9A-Fa-f]{2})+", m.group()):
        return True
    try:
        bytes.fromhex(m.group().replace("%", "")).decode()
        return False
    except UnicodeDecodeError as e:
        return "unexpected end" in e.reason


def ending(text: str | None) -> tuple[str, str | None]:
    """How a text ends, and the last line if it may be a heading.

    A reason of the list above, "whole", "part" for an entry, row or marked heading without terminator, or "heading"
    for a line that stands alone and has no mark of a heading.
    """
    text = consistent_form(text).rstrip() if text else ""
    if not text:
        return "whole", None
    if _broken(text):
        return "broken_character", None
    body = _without_footers(text)
    line = body.rsplit("\n", 1)[-1]
    m = _MARKER.search(line)
    if m:
        before = (body[: len(body) - len(line)] + line[: m.start()]).rstrip()
        if before and not _TERMINATED.search(before.rsplit("\n", 1)[-1]):
            return "marker", None
    reason = _body(body)
    return reason, heading_key(line) if reason == "heading" else None


def _without_footers(text: str) -> str:
    while text:
        above, _, line = text.rpartition("\n")
        if not _FOOTER.fullmatch(line):
            break
        text = above.rstrip()
    return text


def _body(text: str) -> str:
    if not text:
        return "whole"
    line = text.rsplit("\n", 1)[-1]
    structures, marks = automaton(text)
    if structures or _OPEN_TAG.search(line) or _OPEN_ENTITY.search(line):
        return "open_markup"
    if marks:
        return "open_quote" if marks[-1] in "“„«「\"" else "open_bracket"
    if _FORMULA.search(line):
        return "whole"
    plain = plain_words(line).strip()
    is_list = bool(_LIST.match(line))
    is_entry = is_list or " | " in line or line.startswith("|")
    terminated = bool(_TERMINATED.search(plain))
    if _OPEN_AMOUNT.search(plain) and not (is_entry and terminated):
        return "open_number"
    if not plain or terminated:
        return "whole"
    if is_entry:
        return "no_terminator" if is_list and (plain[-1] in ",;(-" or plain.rsplit(None, 1)[-1].lower() in _DANGLING) else "part"
    if _HEADING.match(line):
        return "part"
    return "heading" if stands_alone(text, line) else "no_terminator"


def stands_alone(text: str, line: str) -> bool:
    """Whether the last line of a text is a block of its own and short enough for a heading."""
    return len(line) <= HEADING_CHARS and not line.endswith((",", ";", "$", "€")) and (len(line) == len(text) or not text[: -len(line) - 1].rsplit("\n", 1)[-1].strip())


def heading_key(line: str) -> str:
    return re.sub(r"\d+", "0", plain_words(line).strip().lower())


def headings(text: str | None) -> list[str]:
    """Keys of the lines of a text that stand alone above other text and end no sentence."""
    if not text:
        return []
    blocks = re.split(r"\n[ ]*\n", _without_footers(consistent_form(text).rstrip()))
    return sorted({heading_key(b) for b in map(str.strip, blocks[:-1]) if 0 < len(b) <= HEADING_CHARS and "\n" not in b and not _TERMINATED.search(b)})


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        ends = [ending(t) for t in texts]
        tails = [t[-40:] if t and len(t) < REPEATS and r in ("no_terminator", "part", "heading") else None for t, (r, _) in zip(texts, ends)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([r for r, _ in ends], pa.string()), pa.array([len(t or "") for t in texts], pa.int32()), pa.array([key for _, key in ends], pa.string()), pa.array([headings(t) for t in texts], pa.list_(pa.string())), pa.array(tails, pa.string())],
            names=["id", "source", "reason", "length", "last_line", "headings", "tail"],
        )


BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a statistic of the sources when it is small, as it is unless sources are records themselves."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def limits(lengths: DataFrame) -> DataFrame:
    """(source, length, at_limit) of the lengths at which a source cuts; ``lengths`` has source, length, unended, texts
    (unended rows, repeats of short texts left out) and n.

    What is usual around a length is the larger of the unended texts a length among its four neighbours and within 5 %
    of it, there with one text more. The chance of so many is the Chernoff bound of the Poisson tail.
    """
    of_source = Window.partitionBy("source")
    near, wide = of_source.orderBy("length").rangeBetween(-2, 2), of_source.orderBy("log_length").rangeBetween(-100, 100)
    counted = lengths.withColumn("rows", F.sum("n").over(of_source)).filter("length > 0 and texts > 0").withColumn("log_length", F.round(2000 * F.log("length")).cast("int"))
    others = lambda window: F.sum("texts").over(window) - F.col("texts")
    usual = F.greatest(others(near) / 4.0, (others(wide) + 1) / F.greatest(0.1 * F.col("length"), F.lit(4.0)))
    judged = counted.withColumn("usual", usual)
    chance = F.exp(F.col("texts") - F.col("usual") - F.col("texts") * F.log(F.col("texts") / F.col("usual")))
    found = (F.col("unended") > 0.5 * F.col("n")) & (F.col("texts") >= LIMIT_RATIO * F.col("usual")) & (chance * F.col("rows") < LIMIT_CHANCE)
    return judged.filter(found).select("source", "length", F.lit(True).alias("at_limit"))


def truncated(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, reason, length, truncated): one row per row of ``df``."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text")).filter("id is not null")
    rows = checkpointed(rows.mapInArrow(_endings, f"id {kind}, source string, reason string, length int, last_line string, headings array<string>, tail string"))
    above = rows.select(F.explode("headings").alias("last_line")).groupBy("last_line").agg(F.count("*").alias("n_above"))
    last = rows.filter("reason = 'heading'").groupBy("last_line").agg(F.count("*").alias("n_last"))
    known = _small(last.join(above, "last_line").filter("n_above >= n_last").select("last_line", F.lit(True).alias("known")))
    reason = F.when(F.col("reason") != "heading", F.col("reason")).when(F.col("known"), "part").otherwise("no_terminator")
    rows = rows.join(known, "last_line", "left").select("id", "source", reason.alias("reason"), "length", "tail")
    prose = F.col("reason").isin("whole", "no_terminator")
    unended = F.col("reason").isin("no_terminator", "part")
    baseline = _small(rows.groupBy("source").agg(F.try_divide(F.count_if(F.col("reason") == "no_terminator"), F.count_if(prose)).alias("unended_share")))
    texts = F.when(F.col("length") < REPEATS, F.count_distinct(F.when(unended, F.col("tail")))).otherwise(F.count_if(unended))
    lengths = rows.groupBy("source", "length").agg(F.count_if(unended).alias("unended"), texts.alias("texts"), F.count("*").alias("n"))
    judged = rows.join(baseline, "source", "left").join(_small(limits(lengths)), ["source", "length"], "left")
    at_limit = F.coalesce("at_limit", F.lit(False))
    cut = F.col("reason").isin(*SURE) | ((F.col("reason") == "no_terminator") & ((F.col("unended_share") <= 0.5) | at_limit)) | ((F.col("reason") == "part") & at_limit)
    return judged.select("id", "source", "reason", "length", F.coalesce(cut, F.lit(False)).alias("truncated"))


def source_report(judged: DataFrame) -> DataFrame:
    """Rows, truncated rows and their share by source."""
    return judged.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count_if("truncated").alias("n_truncated"), F.round(F.count_if("truncated") / F.count("*"), 6).alias("truncated_share")
    )
