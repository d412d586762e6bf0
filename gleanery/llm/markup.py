"""Markup of HTML, Markdown, wiki and LaTeX: finding it and taking it out of running text."""

from __future__ import annotations

import html
import re

#: Elements that end a line; the others stand inside one.
BLOCK_TAGS = "address article aside blockquote body br caption center dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
_BLOCK = frozenset(BLOCK_TAGS)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
TAG = re.compile(r"<!--.*?-->|<!?/?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>", re.S)
HIDDEN = re.compile(r"<(script|style|title)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
REFERENCE = re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>.*?</ref>", re.S | re.I)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]")
_WIKI_BOX = re.compile(r"\{\{Infobox[^{}]*\}\}", re.I)
_WIKI_TEMPLATE = re.compile(r"\{\{([^{}|\n]*)((?:\|[^{}\n]*)?)\}\}")
_WIKI_QUOTES = re.compile(r"'{2,5}+(?=\S)|(?<=\S)'{2,5}+")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*\)")
_MD_STRONG = re.compile(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1")
_MD_EMPHASIS = re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])")
_MD_CODE = re.compile(r"`([^`\n]+)`")
_TEX_POINTER = re.compile(r"~?\\(?:ref|eqref|cite|citep|citet|label|index|pageref)\{[^{}]*\}")
_TEX_ENVIRONMENT = re.compile(r"\\begin\{(?:tabular|array|tabularx|longtable)\*?\}(?:\[[^\]]*\])?(?:\{[^{}]*\})*|\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]]*\])?|\\documentclass(?:\[[^\]]*\])?\{[^{}]*\}|\\usepackage(?:\[[^\]]*\])?\{[^{}]*\}")
_TEX_ARGUMENT = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}")
_TEX_LINK = re.compile(r"\\href\{[^{}]*\}(?=\{)")
#: Commands without an argument: switches as in {\\it word}, \\item, \\noindent.
_TEX_SWITCH = re.compile(r"\\[a-zA-Z]+\*?(?![a-zA-Z{])")
_TEX_MATH = re.compile(r"(?<!\\)\$\\[a-zA-Z]+\$")
_TEX_TIE = re.compile(r"(?<=\w)~(?=\s)")
_TEX_ESCAPE = re.compile(r"\\([%$&#_{}])")


def unescape(text: str, rounds: int = 3) -> str:
    """Resolve entities, also those escaped again."""
    for _ in range(rounds):
        if "&" not in text:
            break
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    return text


def tex_words(text: str) -> str:
    """LaTeX commands replaced by their arguments, however deep they are nested; switches are taken out."""
    text = _TEX_TIE.sub("", text)
    text = _TEX_ENVIRONMENT.sub("\n", _TEX_MATH.sub("", _TEX_LINK.sub("", _TEX_POINTER.sub("", text))))
    inner = _TEX_ARGUMENT.sub(r"\1", text)
    while inner != text:  # a round for each level; every round takes a command away
        text, inner = inner, _TEX_ARGUMENT.sub(r"\1", inner)
    return _TEX_ESCAPE.sub(r"\1", _TEX_SWITCH.sub("", text))


def _tag(m: re.Match) -> str:
    name = m.group(1)
    return "\n" if name and name.lower() in _BLOCK else ""


def plain_words(text: str) -> str:
    """The text without markup, for comparing words; layout and structure are not kept."""
    if "&" in text:
        text = unescape(text)
    if "<" in text:
        if "<ref" in text:
            text = REFERENCE.sub("", text)
        text = TAG.sub(_tag, HIDDEN.sub("\n", text))
    if "\\" in text or "~" in text:
        text = tex_words(text)
    if "[" in text:
        text = _MD_LINK.sub(r"\1", _WIKI_LINK.sub(r"\1", text))
    if "{{" in text:
        text = _WIKI_TEMPLATE.sub(lambda m: m.group(2).rpartition("|")[2], _WIKI_BOX.sub("\n", text))
    if "''" in text:
        text = _WIKI_QUOTES.sub("", text)
    if "**" in text or "__" in text or "~~" in text:
        text = _MD_STRONG.sub(r"\2", text)
    if "*" in text:
        text = _MD_EMPHASIS.sub(r"\1", text)
    if "`" in text:
        text = _MD_CODE.sub(r"\1", text)
    return text
