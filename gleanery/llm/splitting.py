"""Problem 2: cutting oversized items at natural boundaries, with overlap.

Method: pointer doubling. The natural boundaries of an item (ends of sections, tables, paragraphs, lines of tables and
sentences) are its possible cuts; a stretch without any for longer than the limit is cut where sentences are joined by
a semicolon, and one still too long at least every half of the overlap, at blanks where there are any. Every boundary is joined to its farthest legal successor: the piece that starts there ends at the
last boundary within LIMIT, and the next piece starts at the first boundary within OVERLAP of that end. Squaring the
successor table again and again gives the number of pieces from every boundary and then all cuts of all items of a
batch at once, in as many steps as the number of pieces has bits.

Defined results: null texts have no item; null or empty sections and tables have none of their kind; offsets outside
the text are clipped, a null or reversed range is no item; a section without an order is an item without a number; an
item within the limit is one piece; an empty one has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.repeats import settled

LIMIT, OVERLAP = 2000, 200
#: Ends of paragraphs and sentences (with the blanks behind them), and lines of tables and lists.
_BREAK = re.compile(r"\n[ ]*\n\s*|(?<=[.!?])[\"')\]”’]*\s+|(?<=[;:])\n|\n(?=[^\n]* \| )|\n(?=\s*[•*\-])|\n(?=Item \d)")
#: Sentences joined by a semicolon are parted only where a sentence is too long without.
_CLAUSE = re.compile(r"(?<=;)\s+(?=[A-ZÀ-Þ])")
_FAR = np.int64(1) << np.int64(40)


def boundaries(text: str, marks: list[int], limit: int, overlap: int) -> np.ndarray:
    """Sorted offsets, from 0 to the length, at which pieces may start and end; no step is above ``limit``."""
    n = len(text)
    cuts = {0, n, *(m for m in marks if 0 < m < n), *(m.end() for m in _BREAK.finditer(text))}
    cuts = sorted(c for c in cuts if c <= n)
    out = [0]
    step = max(1, overlap // 2)
    for c in cuts[1:]:
        inner = [m.end() for m in _CLAUSE.finditer(text, out[-1], c)] if c - out[-1] > limit else []
        for stop in [*inner, c]:
            if stop - out[-1] > limit:
                while stop - out[-1] > step:
                    at = out[-1] + step
                    out.append(max(text.rfind(" ", out[-1] + 1, at) + 1, 0) or at)
            if stop > out[-1]:
                out.append(stop)
    return np.array(out, dtype=np.int64)


def all_pieces(items: list[np.ndarray], limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece number, start, end) of every piece of every item, from the boundaries of each."""
    items = [b for b in items]
    counts = np.array([len(b) for b in items], dtype=np.int64)
    if not len(counts):
        return (np.empty(0, dtype=np.int64),) * 4
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(items)), counts)
    local = np.concatenate(items)
    place = local + owner * _FAR  # the items side by side, too far apart for a piece to span two
    last = first + counts - 1
    # the join: every boundary to the end of its piece, and that end to the start of the next one, which is near
    # enough to it to overlap and to the boundary behind it to get further
    end = np.minimum(np.searchsorted(place, place + limit, "right") - 1, last[owner])
    behind = place[np.minimum(end + 1, last[owner])]
    follow = np.searchsorted(place, np.maximum(place[end] - overlap, behind - limit), "left")
    follow = np.maximum(follow, np.arange(len(place)) + 1)
    done = end == last[owner]
    tables = [np.where(done, last[owner], np.minimum(follow, end))]
    left = np.where(np.arange(len(place)) == last[owner], 0, 1)  # pieces from a boundary on, within 2^k steps
    while True:
        jump = tables[-1]
        more = left[jump]
        if not more.any():
            break
        left = left + more
        tables.append(jump[jump])
    pieces = left[first]
    item = np.repeat(np.arange(len(items)), pieces)
    number = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[item]
    for k, jump in enumerate(tables):
        at = np.where(number >> k & 1 == 1, jump[at], at)
    return item, number, local[at], local[end[at]]


def _items(text: str | None, sections: list | None, tables: list | None) -> Iterator[tuple[str, int, int, int]]:
    """(kind, number, start, end) of the items of a document."""
    if text is None:
        return
    n = len(text)
    yield "document", 0, 0, n
    for kind, parts in (("section", sections), ("table", tables)):
        for k, part in enumerate(parts or []):
            if part and part["char_start"] is not None and part["char_end"] is not None:
                start, end = max(0, part["char_start"]), min(n, part["char_end"])
                number = part["section_order"] if kind == "section" else k
                if start <= end:
                    yield kind, number, start, end


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, numbers, starts, ends, cuts = [], [], [], [], [], []
            columns = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for k, (text, sections, tables) in enumerate(columns):
                items = list(_items(text, sections, tables))
                if not items:
                    continue
                marks = sorted({x for kind, _, a, b in items if kind != "document" for x in (a, b)})
                whole = boundaries(text, marks, limit, overlap)
                for kind, number, start, end in items:
                    rows.append(k)
                    kinds.append(kind)
                    numbers.append(number)
                    starts.append(start)
                    ends.append(end)
                    inside = whole[np.searchsorted(whole, start, "right") : np.searchsorted(whole, end, "left")]
                    cuts.append(np.concatenate([[start], inside, [end]]) if end > start else np.array([start], dtype=np.int64))
            item, number, a, b = all_pieces(cuts, limit, overlap)
            row = np.array(rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row[item])),
                    pa.array(kinds, pa.string()).take(pa.array(item)),
                    pa.array(numbers, pa.int32()).take(pa.array(item)),
                    pa.array((np.array(ends, dtype=np.int64) - np.array(starts, dtype=np.int64))[item].astype(np.int32)),
                    pa.array(number.astype(np.int32)),
                    pa.array(a.astype(np.int32)),
                    pa.array(b.astype(np.int32)),
                ],
                names=["doc_id", "item_kind", "item_no", "item_chars", "piece_no", "char_start", "char_end"],
            )

    return run


def latest(filings: DataFrame) -> DataFrame:
    """One row per doc_id, the one ingested last."""
    last = F.max_by(F.struct("text", "sections", "doc_tables"), "ingested_at").alias("d")
    rows = filings.select("doc_id", "text", "sections", "doc_tables", "ingested_at")
    return settled(rows, "doc_id", lambda same: same.groupBy("doc_id").agg(last, F.max("ingested_at").alias("ingested_at")).select("doc_id", "d.*", "ingested_at")).drop("ingested_at")


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, item_kind, item_no, item_chars, piece_no, char_start, char_end): all pieces of all items.

    ``documents`` has doc_id, text, sections and doc_tables, one row per document. Offsets count from the start of the
    document's text.
    """
    if not 0 <= overlap < limit:
        raise ValueError(f"overlap {overlap} must be at least 0 and below the limit {limit}")
    rows = documents.select(
        "doc_id",
        "text",
        F.transform("sections", lambda s: F.when(s.isNotNull(), F.struct(s.section_order.alias("section_order"), s.char_start.alias("char_start"), s.char_end.alias("char_end")))).alias("sections"),
        F.transform("doc_tables", lambda t: F.when(t.isNotNull(), F.struct(t.char_start.alias("char_start"), t.char_end.alias("char_end")))).alias("doc_tables"),
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_split(limit, overlap), f"doc_id {kind}, item_kind string, item_no int, item_chars int, piece_no int, char_start int, char_end int")


def oversized(split: DataFrame) -> DataFrame:
    """(doc_id, item_kind, item_no): the items that were cut."""
    return split.filter("piece_no = 1").select("doc_id", "item_kind", "item_no").distinct()
