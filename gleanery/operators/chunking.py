"""Chunkers: DataFrame of documents to DataFrame of chunks with exact spans.

Documents have doc_id, text, sections and doc_tables. Sentence windows are plain windows over a table of sentences; the
others carry offsets or state from piece to piece and run per document in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators.parsing import content_start, section_at, tables_overlapping

_TOKEN = re.compile(r"\w+|[^\w\s]")
# What ends a sentence.
_PROTECT = re.compile(rf"\b(?:{T.ABBREVIATIONS})\.", re.I)
_DECIMAL = re.compile(r"(?<=\d)\.(?=\d)")
_END = re.compile(r"(?<=[.!?])\s+")
_EMBED = re.compile(T.TOKEN)


def _placed(parts: DataFrame, key: str) -> DataFrame:
    """Offsets of parts that tile a text: key, pos, part, base."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.col("base")
    return parts.withColumn("char_start", start.cast("int")).withColumn("char_end", (F.col("char_start") + F.length("part")).cast("int"))


def sentences(texts: DataFrame, key: str, base: Column | None = None) -> DataFrame:
    """(key, sentence_no, char_start, char_end) of every sentence; ``base`` is added to the offsets."""
    parts = texts.select(key, (F.lit(0) if base is None else base).alias("base"), F.posexplode(T.sentence_parts(F.col("text"))).alias("pos", "part"))
    kept = _placed(parts, key).filter((F.col("pos") % 2 == 0) & (T.strip(F.col("part")) != ""))
    return kept.withColumn("sentence_no", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("int"))


def _bodies(documents: DataFrame, exclude_front_matter: bool) -> DataFrame:
    start = content_start(F.col("sections")) if exclude_front_matter else F.lit(0)
    return documents.select("doc_id", start.alias("base"), F.substr("text", start + 1).alias("text"))


def _chunk_id(strategy: str, key: str) -> Column:
    return T.stable_id(F.col("doc_id"), F.lit(strategy), F.lit(key), F.col("char_start").cast("string"), F.col("char_end").cast("string"))


def sentence_window(documents: DataFrame, width: int = 2, exclude_front_matter: bool = True) -> DataFrame:
    """A chunk for every sentence: the sentence is embedded, it and ``width`` neighbours on each side are returned."""
    bodies = _bodies(documents, exclude_front_matter)
    found = sentences(bodies, "doc_id", F.col("base"))
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-width, width)
    made = found.select("doc_id", F.col("sentence_no").alias("chunk_index"), F.col("char_start").alias("focus_start"), F.col("char_end").alias("focus_end"), F.min("char_start").over(frame).alias("char_start"), F.max("char_end").over(frame).alias("char_end"))
    key = F.concat_ws(":", F.col("focus_start").cast("string"), F.col("focus_end").cast("string"))
    return made.withColumn("chunk_id", T.stable_id(F.col("doc_id"), F.lit("sentence_window"), key, F.col("char_start").cast("string"), F.col("char_end").cast("string")))


# ---- per document: spans are (start, end), pieces also carry what is embedded


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def sentence_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    part = text[start:end]
    marked = _DECIMAL.sub("\0", _PROTECT.sub(lambda m: m.group().replace(".", "\0"), part))
    cuts = [(m.start(), m.end()) for m in _END.finditer(marked)]
    spans, at = [], 0
    for a, b in [*cuts, (len(part), len(part))]:
        if part[at:a].strip():
            spans.append((start + at, start + a))
        at = b
    return spans


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), start + len(part.rstrip())


def pack(text: str, spans: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Neighbouring spans merged while the text from the first to the last stays within the budget."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and count_tokens(text[out[-1][0] : b]) <= budget:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


SEPARATORS = ("\n\n", "\n", ". ", " ")


def _divide(text: str, start: int, end: int, budget: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans within the budget, cut at the coarsest separator that does."""
    if count_tokens(text[start:end]) <= budget or not separators:
        return [(start, end)]
    out, at, separator = [], start, separators[0]
    while at < end:
        cut = text.find(separator, at, end)
        stop = end if cut < 0 else cut + len(separator)
        if text[at:stop].strip():
            out += _divide(text, at, stop, budget, separators[1:])
        at = stop
    return out


def recursive_spans(text: str, start: int, end: int, size: int = 512, overlap: int = 50) -> list[tuple[int, int]]:
    """Pieces merged to the size; whole pieces at the end of a chunk, within the overlap, begin the next."""
    pieces = _divide(text, start, end, size, SEPARATORS)
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for piece in pieces:
        if held and count_tokens(text[held[0][0] : piece[1]]) > size:
            out.append((held[0][0], held[-1][1]))
            tail: list[tuple[int, int]] = []
            for previous in reversed(held):
                if count_tokens(text[previous[0] : held[-1][1]]) > overlap:
                    break
                tail.insert(0, previous)
            held = tail if tail and count_tokens(text[tail[0][0] : piece[1]]) <= size else []
        held.append(piece)
    if held:
        out.append((held[0][0], held[-1][1]))
    return [s for s in (_trimmed(text, a, b) for a, b in out) if s[0] < s[1]]


def structure_spans(text: str, regions: list[tuple[int, int]], tables: list[tuple[int, int]], size: int = 512) -> list[tuple[int, int, bool]]:
    """(start, end, holds a table): regions are never crossed, tables never cut, paragraphs packed to the size."""
    out: list[tuple[int, int, bool]] = []
    for start, end in regions:
        atoms: list[tuple[int, int, bool]] = []
        at = start
        for a, b in sorted(t for t in tables if start <= t[0] and t[1] <= end):
            if a >= at:
                atoms += [(*s, False) for s in _paragraphs(text, at, a)] + [(a, b, True)]
                at = b
        atoms += [(*s, False) for s in _paragraphs(text, at, end)]
        held: tuple[int, int, bool] | None = None
        for a, b, is_table in atoms:
            if held and count_tokens(text[held[0] : b]) <= size:
                held = (held[0], b, held[2] or is_table)
            else:
                if held:
                    out.append(held)
                held = (a, b, is_table)
        if held:
            out.append(held)
    return out


def _paragraphs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    spans, at = [], start
    for m in re.finditer(r"\n\s*\n", text[start:end]):
        spans.append(_trimmed(text, at, start + m.start()))
        at = start + m.end()
    spans.append(_trimmed(text, at, end))
    return [s for s in spans if s[0] < s[1]]


def _vector(text: str, dim: int = 512) -> np.ndarray:
    import hashlib

    v = np.zeros(dim)
    counts: dict[str, int] = {}
    for t in _EMBED.findall(text.lower()):
        counts[t] = counts.get(t, 0) + 1
    for t, n in counts.items():
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, key=b"0").digest(), "big")
        v[h % dim] += (1.0 if h >> 63 else -1.0) * (1.0 + np.log(n))
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def semantic_spans(text: str, start: int, end: int, percentile: float = 25.0, ceiling: int = 1024) -> list[tuple[int, int]]:
    """Sentences joined until their neighbour is among the least similar pairs, or the ceiling is reached."""
    spans = sentence_spans(text, start, end)
    if len(spans) < 2:
        return [_trimmed(text, start, end)] if text[start:end].strip() else []
    vectors = [_vector(text[a:b]) for a, b in spans]
    near = [float(a @ b) for a, b in zip(vectors, vectors[1:])]
    cut = sorted(near)[min(len(near) - 1, int(len(near) * percentile / 100.0))]
    out, first = [], spans[0][0]
    for k, similarity in enumerate(near):
        if similarity <= cut or count_tokens(text[first : spans[k + 1][1]]) > ceiling:
            out.append((first, spans[k][1]))
            first = spans[k + 1][0]
    out.append((first, spans[-1][1]))
    return out


def _regions(text: str, sections: list | None, start: int) -> list[tuple[int, int]]:
    return [(s["char_start"], s["char_end"]) for s in sections or [] if s] or [(start, len(text))]


def _recursive(text, sections, tables, start, size=512, overlap=50):
    return [(a, b, a, b, f"{size}", False) for a, b in recursive_spans(text, start, len(text), size, overlap)]


def _structure(text, sections, tables, start, size=512):
    return [(a, b, a, b, f"{size}", t) for a, b, t in structure_spans(text, _regions(text, sections, start), tables, size)]


def _parent(text, sections, tables, start, parent=1024, child=128):
    out = []
    for a, b, t in structure_spans(text, _regions(text, sections, start), tables, parent):
        out += [(a, b, c, d, f"{c}:{d}", t) for c, d in pack(text, sentence_spans(text, a, b), child)]
    return out


def _fixed(text, sections, tables, start, size=512, overlap=50):
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and below the size {size}")
    tokens = [m.span() for m in _TOKEN.finditer(text, start)]
    windows = [(tokens[k][0], tokens[min(k + size, len(tokens)) - 1][1]) for k in range(0, len(tokens), size - overlap)]
    return [(a, b, a, b, str(size), False) for a, b in windows]


def _semantic(text, sections, tables, start, percentile=25.0, ceiling=1024):
    return [(a, b, a, b, f"{percentile}", False) for a, b in semantic_spans(text, start, len(text), percentile, ceiling)]


def _by_document(documents: DataFrame, strategy: str, make: Callable, exclude_front_matter: bool = True, **knobs) -> DataFrame:
    rows = documents.select(
        "doc_id",
        "text",
        F.transform("sections", lambda s: F.struct(s["char_start"].alias("char_start"), s["char_end"].alias("char_end"))).alias("sections"),
        F.transform("doc_tables", lambda t: F.struct(t["char_start"].alias("char_start"), t["char_end"].alias("char_end"))).alias("doc_tables"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, sections, tables in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if text is None:
                    continue
                start = min((s["char_start"] for s in sections or []), default=0) if exclude_front_matter else 0
                spans = [(t["char_start"], t["char_end"]) for t in tables or []]
                for k, (a, b, c, d, key, has_table) in enumerate(make(text, sections, spans, start, **knobs)):
                    out.append((doc_id, k, a, b, c, d, key, has_table, count_tokens(text[a:b]), text[a:b]))
            columns = list(zip(*out)) or [()] * 10
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "chunk_index", "char_start", "char_end", "focus_start", "focus_end", "key", "has_table", "n_tokens", "text"])

    made = rows.mapInArrow(run, "doc_id string, chunk_index int, char_start int, char_end int, focus_start int, focus_end int, key string, has_table boolean, n_tokens int, text string")
    return made.withColumn("chunk_id", T.stable_id(F.col("doc_id"), F.lit(strategy), F.col("key"), F.col("char_start").cast("string"), F.col("char_end").cast("string"))).drop("key")


def fixed(documents: DataFrame, size: int = 512, overlap: int = 50, exclude_front_matter: bool = True) -> DataFrame:
    """Windows of ``size`` tokens, each starting size - overlap after the one before, while there are tokens."""
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and below the size {size}")
    return _by_document(documents, "fixed", _fixed, exclude_front_matter, size=size, overlap=overlap).drop("focus_start", "focus_end", "has_table", "text")


CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "fixed": fixed,
    "sentence_window": sentence_window,
    "recursive": partial(_by_document, strategy="recursive", make=_recursive),
    "structure": partial(_by_document, strategy="structure", make=_structure),
    "parent_document": partial(_by_document, strategy="parent_document", make=_parent),
    "semantic": partial(_by_document, strategy="semantic", make=_semantic),
}


def described(made: DataFrame, documents: DataFrame, chunker: str) -> DataFrame:
    """Chunks with the metadata of their document and their own: company, fiscal_year, form_type, section, chunker,
    contains_table. The section is the first that holds the start of the chunk."""
    m = F.col("metadata")
    own = documents.select("doc_id", m["company"].alias("company"), F.expr("try_cast(metadata['fiscal_year'] as int)").alias("fiscal_year"), m["form_type"].alias("form_type"), "sections", "doc_tables")
    tables = F.size(tables_overlapping(F.coalesce("doc_tables", F.array()), F.col("char_start"), F.col("char_end"))) > 0
    joined = made.join(own, "doc_id").withColumns({"section": section_at(F.col("sections"), F.col("char_start"))["section_name"], "chunker": F.lit(chunker), "contains_table": F.coalesce(tables, F.lit(False))})
    return joined.drop("sections", "doc_tables")


def build_chunker(name: str, **knobs) -> Callable[[DataFrame], DataFrame]:
    """A chunker by name; an unknown one is an error that names the known ones."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; known: {', '.join(sorted(CHUNKERS))}")
    return partial(CHUNKERS[name], **knobs)
