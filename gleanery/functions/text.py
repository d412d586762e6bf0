"""Text functions as Column expressions. The five tokenisers differ on purpose; none replaces another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python's str.strip and \\s take for white space, for use inside a character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The token patterns, spelled with brackets so that they serve Java's and Python's dialect alike.
TOKEN = "[a-z0-9]+(?:[.][0-9]+)?"
BUDGET_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"
CONTENT_TOKEN = "[a-z0-9]+(?:[.,][0-9]+)*"
NUMBER = r"[$]?[0-9][0-9,]*(?:[.][0-9]+)?%?"
YEAR = r"(?i)\b(?:fiscal\s+(?:year\s+)?|FY\s*)?((?:19|20)[0-9]{2})\b"

# Words that retrieval leaves out.
STOPWORDS = "a an and are as at be by for from had has have how in is it its of on or that the their to was were what when which who why with".split()
# Words that claim checking leaves out.
CHECK_STOPWORDS = "a an and are as at be by for from had has have in is it its of on or that the their to was were with we our this these those".split()
# Abbreviations whose point ends no sentence.
ABBREVIATIONS = r"Inc|Corp|Ltd|LLC|Co|No|Nos|vs|etc|approx|est|Mr|Ms|Dr|Jr|Sr|U\.S|Item|Note|Fig"


def _without(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def normalize_whitespace(text: Column) -> Column:
    """NBSP to space, line ends to LF, runs of blanks to one, three or more LF to two, ends stripped."""
    text = F.regexp_replace(F.regexp_replace(text, r"\xa0", " "), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t\f\x0B]+", " "), r"\n{3,}", "\n\n"))


def retrieval_tokens(text: Column) -> Column:
    """Lower-case words and decimals without stopwords, in order, repeats kept."""
    return _without(all_matches(F.lower(text), TOKEN), STOPWORDS)


def plain_tokens(text: Column) -> Column:
    """The same with stopwords: for embedding, budgets of contexts and shingles."""
    return all_matches(F.lower(text), TOKEN)


def budget_tokens(text: Column) -> Column:
    """Words and single signs, for budgets of chunks."""
    return all_matches(text, BUDGET_TOKEN)


def content_tokens(text: Column) -> Column:
    """Distinct words for claim checking; "4,218" is one of them."""
    return F.array_distinct(_without(all_matches(F.lower(text), CONTENT_TOKEN), CHECK_STOPWORDS))


def answer_terms(text: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(text), "[a-z0-9]+"))


def numbers(text: Column) -> Column:
    """Distinct numeric literals without signs and thousands separators."""
    return F.array_distinct(F.transform(all_matches(text, NUMBER), lambda n: F.regexp_replace(n, "[$%,]", "")))


def years(text: Column) -> Column:
    return F.array_distinct(all_matches(text, YEAR, 1))


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def shingles(tokens: Column, size: int = 4) -> Column:
    """Distinct runs of ``size`` tokens; fewer tokens are one run; none give none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (size - 1)), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).when(F.size(tokens) < size, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 when both are empty, 0 when one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def protect_points(text: Column) -> Column:
    """Points of abbreviations and decimals replaced by U+0001; the signs that mark places, where a text has them itself,
    are replaced by blanks first, so offsets stay."""
    text = F.translate(text, "\x01\x02\x03", "   ")
    text = F.regexp_replace(text, rf"(?i)(^|[^\p{{L}}\p{{N}}_])({ABBREVIATIONS})\.", "$1$2\x01")
    return F.regexp_replace(text, r"(?<=\p{Nd})\.(?=\p{Nd})", "\x01")


def sentence_parts(text: Column) -> Column:
    """Sentences and the blanks between them, in turn: together they are the text."""
    return F.split(F.regexp_replace(protect_points(text), f"(?<=[.!?])([{WS}]+)", "\x02$1\x03"), "[\x02\x03]")


def claims(text: Column) -> Column:
    """Sentences as strings; the next one must begin with a capital, a quotation mark or a bracket."""
    parts = F.split(protect_points(text), rf"(?<=[.!?])[{WS}]+(?=[A-Z(\"'\[])")
    return F.filter(F.transform(parts, lambda p: strip(F.translate(p, "\x01", "."))), lambda p: p != "")


INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"


def drop_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


@F.pandas_udf(StringType())
def nfkc(texts):
    """Compatibility normalisation, for which there is no built-in function."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def strip_invisible(text: Column) -> Column:
    return nfkc(drop_invisible(text))


def neutralise_boundaries(text: Column) -> Column:
    """Forged delimiters of the passage envelope in square brackets."""
    return F.regexp_replace(text, r"(?i)</?(passage|system|instructions?)>", "[$1]")


# Patterns of the four techniques.
_OBJECTS = "(?:instructions?|prompts?|context|directions?|guidance|rules?|messages?)"
INJECTIONS = {
    "imperative_override": rf"(?i)\b(?:ignore|disregard|forget|override|bypass)\b(?:\W+\w+){{0,4}}?\W+(?:{_OBJECTS})\b|\bsupersedes?\b(?:\W+\w+){{0,3}}?\W+(?:{_OBJECTS})\b|\byou are now\b|\bnew instructions?\b|"
    r"\bsystem (?:notice|prompt|message)\b|\bact as (?:a|an|the)?\s*\w+\b|\bfrom now on\b|\bonly (?:permitted|allowed|valid) (?:response|answer|reply)\b|\bnote to automated (?:systems?|agents?|assistants?)\b",
    "forged_boundary": r"(?i)(?:^|\n)\s*(?:-{3,}|={3,}|#{2,})\s*(?:end|begin|start)\s+of\b|</?(?:passage|system|instructions?)>",
    "invisible_characters": INVISIBLE,
    "url_exfiltration": r"(?i)!\[[^\]]*\]\(https?://[^)]+\)|https?://\S+\?[^\s)]*=",
}


def detect_injection(text: Column) -> Column:
    """Techniques that a text shows, in the order of INJECTIONS."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in INJECTIONS.items())))


def fixed_width_parts(text: Column, width: int = 48) -> Column:
    """A text cut every ``width`` characters; the empty text has no parts."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(width))
    return F.filter(F.transform(starts, lambda i: F.substr(text, i, F.lit(width))), lambda p: p != "")


def passages(chunk_ids: Column, texts: Column) -> Column:
    """The indexed envelope of retrieved passages; a sentinel when there are none."""
    each = F.transform(F.arrays_zip(chunk_ids.alias("i"), texts.alias("t")), lambda p, k: F.concat(F.lit('<passage index="'), k.cast("string"), F.lit('" id="'), p["i"], F.lit('">\n'), p["t"], F.lit("\n</passage>")))
    return F.when(F.size(chunk_ids) == 0, F.lit("(no passages retrieved)")).otherwise(F.array_join(each, "\n\n"))
