"""An exact check of lines for markup, to compare the labeller with."""

import html.entities
import re

from gleanery.llm.markup import ENTITY

#: The marks of each language, in a line.
MARKS = {
    "comment": r"<!--",
    "tag": r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>",
    "entity": r"&(?:\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});",
    "fence": r"^```",
    "code": r"`[^`\n]+`",
    "hashes": r"^\#{1,6}\ (?=\S)",
    "strong": r"\*\*(?=\S)[^\n]*?\S\*\*|__(?=\S)[^\n]*?\S__(?!\w)|~~(?=\S)[^\n]*?\S~~",
    "emphasis": r"(?<![\w*])\*(?=[^\s*])[^*\n]*?[^\s*]?\*(?![\w*])",
    "link": r"!?\[[^\[\]\n]*\]\([^()\s]*\)",
    "bars": r"^\|(?=.*\|\s*$)|^\|[-:| ]+$",
    "underline": r"^(?:={3,}|-{3,})\s*$",
    "display": r"\$\$",
    "wikihead": r"^={2,6}[^=\n]+={2,6}\s*$",
    "wikitable": r"^(?:\{\||\|[-}+]|!\ )|\|\|",
    "quotes": r"'{2,5}(?=[^\s'])",
    "wikilink": r"\[\[[^\[\]\n]*\]\]",
    "template": r"\{\{[^{}\n]*(?:\}\}|$)|^\}\}\s*$",
    "command": r"\\[A-Za-z]+|\\[\[\]()]",
    "escape": r"\\[%$&\#_{}]|\\\\\s*$",
    "tie": r"(?<=\w)~(?=\s|\\)",
    "remark": r"^%\ \S",
    "math": r"\$\\[A-Za-z]+",
    "script": r"(?<=\w)[_^]\{",
    "bullet": r"^(?:[*+-]|1[.)])\ (?=\S)",
}
_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in MARKS.items()), re.X)
#: Where a mark inside a line can start.
_STARTS = re.compile(r"[<&`*_~!\[$'{}\\|^]")
_SIGNS = re.compile(r"[<`*~\[{}\\_^]")
_NEEDS_COMPANY = frozenset(("bullet",))
_WEAK = frozenset(("script",))


def marks(line: str) -> dict[str, int]:
    """How many marks of each family a line has."""
    out: dict[str, int] = {}
    # no mark can be in a line without one of these
    if line[0] in "|=!%+#-1" or _SIGNS.search(line) or ("&" in line and ENTITY.search(line)) or "''" in line or "||" in line or "$$" in line:
        upto = 0
        for at in (0, *(m.start() for m in _STARTS.finditer(line, 1))):
            if at >= upto and (m := _ANY.match(line, at)):
                out[m.lastgroup] = out.get(m.lastgroup, 0) + 1
                upto = m.end()
    return out


def has_mark(lines: list[str], k: int, own: dict[str, int] | None = None) -> bool:
    """The exact check of a line in its document; ``own`` are its marks where they are known."""
    for family in marks(lines[k]) if own is None else own:
        if family in _WEAK:
            continue
        if family == "entity":
            names = re.findall(r"&([A-Za-z][A-Za-z0-9]*);", lines[k])
            if "&#" in lines[k] or any(name + ";" in html.entities.html5 for name in names):
                return True
        elif family in _NEEDS_COMPANY:
            sign = lines[k][:2]
            if (k and lines[k - 1][:2] == sign) or (k + 1 < len(lines) and lines[k + 1][:2] == sign):
                return True
        elif family == "underline":
            if k and abs(len(lines[k].rstrip()) - len(lines[k - 1].rstrip())) <= 1:
                return True
        else:
            return True
    return False
