"""Problem 8: evaluation passages inside a collection of texts.

Method: the word runs of N consecutive words of all passages form a hash set that is broadcast; every window of N words
of every text is looked up in it; hits are verified word by word and joined to the longest shared run of each item.
Words are runs of letters or digits of the lower-cased text in its consistent form, after entities (also escaped
twice), tags and other markup are taken out, so neither layout nor markup inside a passage hides it.

Scale: passages of at most BROADCAST_CHARS characters in all, counted before, are broadcast; texts are scanned once
where they lie and nothing but hits leaves a task. A larger set is never gathered: its runs of N words stay a table,
and only a bit map of FILTER_BITS bits of their hashes is broadcast. Windows of texts that pass it are joined with the
runs by hash, and each (text, item) so found is verified with the two texts at hand.

Defined results: null texts hold nothing; null passages and passages of fewer than N words leak nowhere; a passage is
reported once for each row of the collection that holds it; items of equal text are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.markup import plain_words
from gleanery.llm.textform import consistent_form
from gleanery.llm.words import WORD, run_hashes, word_hashes
from gleanery.session import checkpointed

N = 15
BROADCAST_CHARS = 8_000_000
FILTER_BITS = 22


def plain_form(text: str) -> str:
    """The text in its consistent form, without markup.

    Signs of markup can be look-alikes themselves, and entities can stand for look-alike letters, hence both orders.
    """
    return consistent_form(plain_words(consistent_form(text)))


class Passages:
    """The hash set of some passages."""

    def __init__(self, items: list[tuple[object, str]], n: int = N):
        self.n = n
        self.ids = [i for i, _ in items]
        self.words = [WORD.findall(plain_form(p).lower()) for _, p in items]
        grams, owner, at = [], [], []
        with np.errstate(over="ignore"):
            for k, words in enumerate(self.words):
                if len(words) >= n:
                    h = run_hashes(word_hashes(" ".join(words)), n)
                    grams.append(h)
                    owner.append(np.full(len(h), k))
                    at.append(np.arange(len(h)))
        self.grams = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, dtype=np.int64)
        self.at = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.owner, self.at = self.grams[order], self.owner[order], self.at[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.grams & np.uint64((1 << FILTER_BITS) - 1)] = True

    def runs(self, form: str) -> list[tuple[int, int, int, int]]:
        """(item index, longest shared run, its first word in the text, its first word in the passage) of a plain form."""
        if not len(self.grams):
            return []
        words = word_hashes(form)
        if len(words) < self.n:
            return []
        with np.errstate(over="ignore"):
            windows = run_hashes(words, self.n)
        hits = np.flatnonzero(self.filter[windows & np.uint64((1 << FILTER_BITS) - 1)])
        if not len(hits):
            return []
        low = np.searchsorted(self.grams, windows[hits], "left")
        high = np.searchsorted(self.grams, windows[hits], "right")
        if not (high > low).any():
            return []
        text = WORD.findall(form.lower())
        best: dict[int, tuple[int, int, int]] = {}
        ends: dict[tuple[int, int], int] = {}
        for w, a, b in zip(hits.tolist(), low.tolist(), high.tolist()):
            for g in range(a, b):
                item, at = int(self.owner[g]), int(self.at[g])
                if ends.get((item, w - at), -1) >= w:
                    continue  # inside a run on this diagonal that is known
                passage = self.words[item]
                length = 0
                while at + length < len(passage) and w + length < len(text) and passage[at + length] == text[w + length]:
                    length += 1
                if length >= self.n:
                    ends[item, w - at] = w + length - self.n
                    if length > best.get(item, (0,))[0]:
                        best[item] = (length, w, at)
        return [(item, *found) for item, found in best.items()]


def _fits(passages: DataFrame, limit: int) -> bool:
    """Whether the passages may be broadcast."""
    return (passages.agg(F.sum(F.length("passage"))).first()[0] or 0) <= limit


def _passages(items: DataFrame, item_col: str, passage_col: str) -> DataFrame:
    return items.select(F.col(item_col).alias("item_id"), F.col(passage_col).alias("passage")).filter("item_id is not null and passage is not null")


def _windows(n: int, passing: np.ndarray | None = None):
    """(key, gram) of the distinct word runs of texts, of those alone that pass a bit map where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, grams = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = word_hashes(plain_form(text))
                if len(words) >= n:
                    with np.errstate(over="ignore"):
                        own = np.unique(run_hashes(words, n))
                    if passing is not None:
                        own = own[passing[own & np.uint64((1 << FILTER_BITS) - 1)]]
                    at.append(np.full(len(own), k))
                    grams.append(own)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(grams).view(np.int64))], names=["key", "gram"])

    return run


def _candidates(texts: DataFrame, passages: DataFrame, n: int) -> DataFrame:
    """(key, item_key): distinct pairs of a text and a passage that share the hash of a run; both have key and text."""
    item_grams = checkpointed(passages.mapInArrow(_windows(n), "key long, gram long"))
    places = item_grams.select(F.expr(f"cast(gram & {(1 << FILTER_BITS) - 1} as int)").alias("place")).distinct()
    passing = np.zeros(1 << FILTER_BITS, dtype=bool)
    for row in places.toLocalIterator():  # at most 2^FILTER_BITS places, whatever the number of passages
        passing[row.place] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(passing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _windows(n, np.unpackbits(shared.value).astype(bool))(batches)

    hits = texts.mapInArrow(run, "key long, gram long")
    return hits.join(item_grams.withColumnRenamed("key", "item_key"), "gram").select("key", "item_key").distinct()


def _joined(rows: DataFrame, passages: DataFrame, n: int) -> DataFrame:
    """(key, text, item_id, passage) of the candidates; ``rows`` has key and text."""
    texts = rows.select("key", "text").dropDuplicates(["key"])
    keyed = passages.select(F.xxhash64("item_id", "passage").alias("item_key"), "item_id", "passage")
    pairs = _candidates(texts, keyed.select(F.col("item_key").alias("key"), F.col("passage").alias("text")), n)
    return pairs.join(keyed, "item_key").join(texts, "key").select("key", "text", "item_id", "passage")


def _keyed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def leaks(texts: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, n: int = N, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(id, item_id, run_words, passage_words, span): a row for each item that a text holds n or more words of."""
    kinds = texts.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    found = f"item_id {kinds[1]}, run_words int, passage_words int, span string"
    passages = _passages(items, item_col, passage_col)
    if not _fits(passages, broadcast_chars):
        rows = _keyed(texts, id_col, text_col).filter("text is not null")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, text, item, passage in zip(*(c.to_pylist() for c in batch.columns)):
                    one = Passages([(item, passage)], n)
                    for _, length, _, first in one.runs(plain_form(text)):
                        out.append({"key": key, "item_id": item, "run_words": length, "passage_words": len(one.words[0]), "span": " ".join(one.words[0][first : first + length])})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.int64()), ("item_id", batch.column(2).type), ("run_words", pa.int32()), ("passage_words", pa.int32()), ("span", pa.string())]))

        verified = _joined(rows, passages, n).mapInArrow(verify, f"key long, {found}")
        return rows.select("key", "id").join(verified, "key").select("id", "item_id", "run_words", "passage_words", "span")
    shared = texts.sparkSession.sparkContext.broadcast(Passages([(r.item_id, r.passage) for r in passages.collect()], n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at, item_ids, runs, sizes, spans = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for item, length, _, first in known.runs(plain_form(text)):
                    at.append(k)
                    item_ids.append(known.ids[item])
                    runs.append(length)
                    sizes.append(len(known.words[item]))
                    spans.append(" ".join(known.words[item][first : first + length]))
            if at:
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column(0).take(pa.array(at)), "item_id": item_ids, "run_words": pa.array(runs, pa.int32()), "passage_words": pa.array(sizes, pa.int32()), "span": pa.array(spans, pa.string())}
                )

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.mapInArrow(scan, f"id {kinds[0]}, {found}")


def without_spans(text: str | None, passages: Passages) -> str | None:
    """The plain form of a text without the words of any shared run; null stays null."""
    if text is None:
        return None
    form = plain_form(text)
    while found := passages.runs(form):  # the longest run of each item a round; every round takes words away
        places = list(WORD.finditer(form))
        cuts = sorted((places[first].start(), places[first + length - 1].end()) for _, length, first, _ in found)
        parts, at = [], 0
        for start, end in cuts:
            parts.append(form[at : max(at, start)])
            at = max(at, end)
        form = "".join([*parts, form[at:]])
    return form


def cleaned(texts: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, n: int = N, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(id, text, removed): every text; the ones that held passages in their plain form without the shared runs."""
    kind = texts.schema[id_col].dataType.simpleString()
    passages = _passages(items, item_col, passage_col)
    if not _fits(passages, broadcast_chars):
        rows = _keyed(texts, id_col, text_col)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [Passages([(None, p) for p in own], n) for own in batch.column(2).to_pylist()]
                pairs = list(zip(batch.column(1).to_pylist(), found))
                hit = [bool(p.runs(plain_form(t))) for t, p in pairs]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([without_spans(t, p) if h else t for (t, p), h in zip(pairs, hit)], pa.string()), pa.array(hit)], names=["key", "clean", "removed"])

        # the passages of a text are bounded by the text, which holds a run of each
        held = _joined(rows.filter("text is not null"), passages, n).groupBy("key").agg(F.any_value("text").alias("text"), F.collect_set("passage").alias("passages"))
        cuts = held.mapInArrow(cut, "key long, clean string, removed boolean").filter("removed")
        return rows.join(cuts, "key", "left").select("id", F.when(F.col("removed"), F.col("clean")).otherwise(F.col("text")).alias("text"), F.coalesce("removed", F.lit(False)).alias("removed"))
    shared = texts.sparkSession.sparkContext.broadcast(Passages([(r.item_id, r.passage) for r in passages.collect()], n))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hit = [bool(t) and bool(known.runs(plain_form(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([without_spans(t, known) if h else t for t, h in zip(texts, hit)], pa.string()), pa.array(hit)], names=["id", "text", "removed"])

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(clean, f"id {kind}, text string, removed boolean")


def item_report(found: DataFrame) -> DataFrame:
    """By item: in how many texts it leaked, its longest run and the largest share of the passage in one text."""
    return found.groupBy("item_id").agg(
        F.countDistinct("id").alias("n_texts"), F.max("run_words").alias("longest_run"), F.round(F.max(F.col("run_words") / F.col("passage_words")), 6).alias("largest_share")
    )
