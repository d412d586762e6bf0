"""Problem 3: one consistent form for texts that look the same.

Three steps, in this order:

1. compatibility normalisation (full-width, ligature and presentation forms become ordinary characters, combining
   accents are composed, every blank inside a line becomes a space) and deletion of ignorable characters;
2. each token is reduced to its visual skeleton, and the skeleton is expanded to a lattice of all letters that share
   each shape, of the scripts that the skeleton of the text shows beyond doubt;
3. a Viterbi search finds the reading with the best score: character bigrams of the script, SWITCH for every change of
   script inside the token, and CONTEXT once for a token in the script of its line. The bigrams can win over the line.

The search sees only the skeleton of the token, its line and its text, so two texts that look the same always get the
same reading, whichever characters they were stored with. A text that shows no script but Latin is its skeleton, so
texts in Latin letters alone are their own form.

Kept apart, because a reader sees the difference: letter case, punctuation, missing accents, raised and lowered
digits, fractions, circled signs, and the layout of lines.

Defined results: null gives null; the empty text stays empty; a text of ignorable characters only becomes empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE = SCRIPTS = range(5)

# Fixed values, a selection of the single-letter entries of the Unicode confusables data (UTS 39) that differ in script
# only: letters that share one shape, as Latin, Cyrillic, Greek, Armenian and Cherokee ("." where the script has none).
SHAPES = """
a а α . .
b . . . Ꮟ
c с . . .
d ԁ . . Ꮷ
e е . . .
g . . ց .
h һ . հ Ꮒ
i і ι . Ꭵ
j ј ϳ յ .
l ӏ . . .
n . . ո .
o о ο օ .
p р ρ . .
q ԛ . զ .
s ѕ . . .
u . υ ս .
v ѵ ν . .
w ԝ . . .
x х . . .
y у . . Ꭹ
A А Α . Ꭺ
B В Β . Ᏼ
C С . . Ꮯ
D . . . Ꭰ
E Е Ε . Ꭼ
F . Ϝ . .
G Ԍ . . Ꮐ
H Н Η . Ꮋ
I І Ι . .
J Ј Ϳ . Ꭻ
K К Κ . Ꮶ
L . . . Ꮮ
M М Μ . Ꮇ
N . Ν . .
O О Ο Օ .
P Р Ρ . Ꮲ
Q Ԛ . . .
R . . . Ꭱ
S Ѕ . Տ Ꮪ
T Т Τ . Ꭲ
U . . Ս .
V Ѵ . . Ꮩ
W Ԝ . . Ꮃ
X Х Χ . .
Y У Υ . Ꮍ
Z . Ζ . Ꮓ
"""
#: Letters of one script that share a shape.
ALIASES = {"ɑ": "a", "ɡ": "g", "Ӏ": "I"}
LATTICE: dict[str, list[tuple[int, str]]] = {}
SKELETON: dict[int, str] = {ord(c): shape for c, shape in ALIASES.items()}
#: Shapes that the alphabets of today's Cyrillic or Greek share with Latin; they say nothing about the script.
SHARED: set[str] = set()
for _line in SHAPES.split("\n"):
    _letters = _line.split()
    if _letters:
        LATTICE[_letters[0]] = [(script, c) for script, c in enumerate(_letters) if c != "."]
        for _c in _letters[1:]:
            if _c != ".":
                SKELETON[ord(_c)] = _letters[0]
                if 0x391 <= ord(_c) <= 0x3C9 or 0x410 <= ord(_c) <= 0x458:
                    SHARED.add(_letters[0])

#: Plain text in each script from which the bigram scores are counted.
SAMPLES = {
    LATIN: "the company and its subsidiaries report revenue for the fiscal year ended in march net income rose because "
    "prices were higher while costs of materials fell our largest customers renewed contracts on better terms according "
    "to the notes of these statements operating segments include services products leases taxes interest equity debt "
    "der konzern und die umsatz stieg nach dem werk geschlossen wurde le chiffre affaires est selon les comptes la "
    "empresa los ingresos netos aumentaron según se explica en las notas access copy space cases pays types axis echo",
    CYRILLIC: "чистый долг компании вырос на фоне роста цен и составил главным образом за счёт спроса валовая маржа "
    "сегмента превысила план операционная прибыль изменилась из за курсовых разниц себестоимость продаж снизилась после "
    "закрытия склада портфель заказов площадки без учёта выплат как указано в примечании средняя численность сократилась "
    "с учётом покупки объём поставок выручка группы резерв по гарантии и о у а с со по не на от до за при",
    ARMENIAN: "ընկերությունը և նրա դուստր ընկերությունները հայտարարեցին եկամուտներ տարվա համար զուտ շահույթը աճեց գների պատճառով",
    GREEK: "η εταιρεία και οι θυγατρικές της ανακοίνωσαν έσοδα για το έτος που έληξε τα κέρδη αυξήθηκαν λόγω των τιμών "
    "ενώ το κόστος των υλικών μειώθηκε σύμφωνα με τις σημειώσεις των οικονομικών καταστάσεων ο όμιλος",
}
#: Log-scores: of a change of script inside a token, of a letter that the sample of its script does not have (of an
#: older or rarer alphabet), and of a whole token in the script of its line.
SWITCH, FOREIGN, CONTEXT = -8.0, -10.0, 4.0


class _CharTable(dict):
    """Compatibility normalisation by character, filled on demand, for str.translate."""

    def __missing__(self, o: int):
        self[o] = out = self.form(chr(o))
        return out

    @staticmethod
    def form(c: str):
        if c in "\n\r":
            return c
        category = unicodedata.category(c)
        if category in ("Zl", "Zp"):
            return "\n"
        if category == "Zs" or c in "\t\v\f":
            return " "
        if category == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(c) <= 0xFE0F or 0x180B <= ord(c) <= 0x180F or 0xE0100 <= ord(c) <= 0xE01EF:
            return None
        if c in "‐‑":
            return "-"
        how = unicodedata.decomposition(c)
        if how.startswith(("<wide>", "<narrow>", "<noBreak>", "<compat>", "<small>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")):
            plain = unicodedata.normalize("NFKC", c)
            if plain.strip() == plain:
                return plain
        return c


_CHARS = _CharTable()
#: Anything here may need work; texts without it are already in the consistent form.
_SUSPECT = re.compile("[^\n -~¡-§©-¬®°-³¶·¹-İĴ-ľŁ-ňŊ-ž‒-―‘-”•€]")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ\u0530-\u058f\u13a0-\u13ff\u1f00-\u1fffɑɡ]")
_MARKS = re.compile("[̀-ͯ҃-҇]")
_TOKEN = re.compile("(?:[^\\W\\d_][̀-ͯ҃-҇]*)+")


def _script(c: str) -> int | None:
    """The script that a letter of a skeleton shows; None for shared shapes and other characters."""
    o = ord(c)
    if c in SHARED:
        return None
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return LATIN if c.isalpha() else None
    if 0x400 <= o < 0x530:
        return CYRILLIC
    if 0x530 <= o < 0x590:
        return ARMENIAN
    if 0x13A0 <= o < 0x1400:
        return CHEROKEE
    return GREEK if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else None


_LETTERS = 40  # of an alphabet, with its borders, for smoothing


@lru_cache(maxsize=1)
def bigrams() -> list[dict[str, float]]:
    """Log-probabilities of the next letter by script: of pairs that the sample has, under one letter those of other
    letters of the sample, and under "" that of a letter foreign to the sample."""
    out = []
    for script in SCRIPTS:
        pairs: Counter = Counter()
        first: Counter = Counter()
        for word in unicodedata.normalize("NFD", SAMPLES.get(script, "")).lower().split():
            letters = ["^", *(c for c in word if not unicodedata.combining(c)), "$"]
            for a, b in zip(letters, letters[1:]):
                pairs[a + b] += 1
                first[a] += 1
        scores = {ab: log((n + 0.5) / (first[ab[0]] + 0.5 * _LETTERS)) for ab, n in pairs.items()}
        scores |= {a: log(0.5 / (n + 0.5 * _LETTERS)) for a, n in first.items()}
        if pairs:
            scores |= {"$": _UNKNOWN, "": FOREIGN}
        out.append(scores)
    return out


_UNKNOWN = log(1 / _LETTERS)


def _gram(grams: list[dict[str, float]], script: int | None, a: str, b: str) -> float:
    if script is None:
        return 0.0
    known = grams[script]
    score = known.get(a + b)
    if score is None:
        score = known.get(a, _UNKNOWN) if b in known else known.get("", _UNKNOWN)
    return score


@lru_cache(maxsize=200_000)
def read_token(skeleton: str, around: int, scripts: tuple[int, ...]) -> str:
    """The best reading of a decomposed skeleton in a line of the script ``around``, from the letters of ``scripts``."""
    letters = [c for c in skeleton if not unicodedata.combining(c)]
    grams = bigrams()
    bonus = CONTEXT / len(letters)
    best: dict[tuple[int | None, str], tuple[float, str]] = {(None, "^"): (0.0, "")}
    for c in letters:
        options = [(script, x) for script, x in LATTICE.get(c, ()) if script in scripts] or [(_script(c), c)]
        here = {}
        for script, x in options:
            low = x.lower()
            score, path = max(
                (s + (_gram(grams, script, a, low) if before in (None, script) or script is None else SWITCH + (_UNKNOWN if low in grams[script] else grams[script].get("", _UNKNOWN))), p) for (before, a), (s, p) in best.items()
            )
            here[script, low] = (score + (bonus if script == around else 0.0), path + x)
        best = here
    _, path = max((s + _gram(grams, script, a, "$"), p) for (script, a), (s, p) in best.items())
    chosen = iter(path)
    return unicodedata.normalize("NFC", "".join(c if unicodedata.combining(c) else next(chosen) for c in skeleton))


def _read_lines(text: str) -> str:
    skeleton = unicodedata.normalize("NFD", text).translate(SKELETON)
    shown = {c: script for c in set(skeleton) if (script := _script(c)) is not None}
    scripts = tuple(sorted(set(shown.values())))
    if scripts in ((), (LATIN,)):
        return unicodedata.normalize("NFC", skeleton)
    lines = skeleton.split("\n")
    whole: Counter = Counter()
    found = []
    for line in lines:
        own: Counter = Counter()
        tokens = list(_TOKEN.finditer(line))
        for m in tokens:
            votes = Counter(shown[c] for c in m.group() if c in shown)
            if votes:
                own[votes.most_common(1)[0][0]] += 1
        whole.update(own)
        found.append((own, tokens))
    order = lambda votes: max(SCRIPTS, key=lambda s: (votes[s], -s))
    default = order(whole)
    for k, (own, tokens) in enumerate(found):
        around = order(own) if own else default
        line, parts, at = lines[k], [], 0
        for m in tokens:
            # names of tags, entities and commands are Latin wherever they stand
            name = line[m.start() - 1 : m.start()] in ("<", "/", "&", "\\", ";")
            parts += [line[at : m.start()], read_token(m.group(), LATIN if name else around, (LATIN,) if name else scripts)]
            at = m.end()
        lines[k] = "".join([*parts, line[at:]])
    return unicodedata.normalize("NFC", "\n".join(lines))


def consistent_form(text: str | None) -> str | None:
    """The consistent form of one text; null stays null."""
    if text is None or not _SUSPECT.search(text):
        return text
    text = text.translate(_CHARS)
    if _MARKS.search(text):
        text = unicodedata.normalize("NFC", text)
    if _FOREIGN.search(text):
        text = _read_lines(text)
    return text


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        forms = [consistent_form(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=["id", "form"])


def consistent_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form): the consistent form of every text, one row per input row."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_forms, f"id {df.schema[id_col].dataType.simpleString()}, form string")


def _form_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, form_keys, raw_keys = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is not None and t is not None:
                ids.append(i)
                form_keys.append(xxhash.xxh3_128_digest(consistent_form(t).encode("utf-8", "surrogatepass")))
                raw_keys.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(form_keys, pa.binary()), pa.array(raw_keys, pa.binary())], names=["id", "form_key", "raw_key"])


def form_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form_key, raw_key): 128-bit keys of the consistent form and of the stored text, one row per id.

    Rows with a null id or text have no key; a repeated id counts once.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(_form_keys, "id string, form_key binary, raw_key binary")
    return rows.groupBy("id").agg(F.min(F.struct("form_key", "raw_key")).alias("k")).select("id", "k.form_key", "k.raw_key")


def look_alike_pairs(keys: DataFrame) -> DataFrame:
    """(id_a, id_b): records of equal consistent form whose stored texts differ, the smaller id first.

    ``keys`` comes from form_keys, with or without a grouping column ``table_name``; it is read several times, so it
    should be checkpointed. Forms of one stored text are dropped by an aggregate that combines before the shuffle, so
    a hot group of exact copies moves no rows. Stored texts are paired as classes; their records meet only those of
    another class, so every row that a join makes is a row of the result.
    """
    group = [c for c in ("table_name", "form_key") if c in keys.columns]
    varied = keys.groupBy(*group).agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi")).filter("lo <> hi").select(*group)
    members = keys.join(varied, group)
    classes = members.select(*group, "raw_key").distinct()
    linked = classes.withColumnRenamed("raw_key", "raw_a").join(classes.withColumnRenamed("raw_key", "raw_b"), group).filter("raw_a < raw_b")
    a = members.withColumnsRenamed({"raw_key": "raw_a", "id": "id_1"})
    b = members.withColumnsRenamed({"raw_key": "raw_b", "id": "id_2"})
    pairs = linked.join(a, [*group, "raw_a"]).join(b, [*group, "raw_b"])
    return pairs.select(*[c for c in group if c == "table_name"], F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))
