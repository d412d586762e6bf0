"""Retrieval over batches of queries: every operator takes all queries as a DataFrame and keeps query_id as a key.

Corpora have chunk_id and text; queries have query_id and query; hits have query_id, chunk_id, rank and score. Ties of
the score, rounded to nine places so that the order of summation does not matter, go to the smaller chunk_id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

K1, B = 1.5, 0.75
RRF_K, FETCH_DEPTH = 60, 50
PROXIMITY_WINDOW, PROXIMITY_BONUS = 40, 0.25
#: Sides up to so many rows are broadcast after they were counted; larger ones are left to the optimizer.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side whose size is checked first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_statistics(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, totals): term, chunk_id, tf, length of every posting; number of chunks and average length."""
    tokens = corpus.select("chunk_id", T.retrieval_tokens(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens"))
    postings = tokens.select("chunk_id", "length", F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    totals = tokens.agg(F.count("*").alias("n_chunks"), F.avg("length").alias("average_length"))
    return postings, totals


def bm25(corpus: DataFrame, queries: DataFrame, where: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk with a positive score.

    Statistics cover the whole corpus; ``where`` only limits the candidates. A term repeated in the query counts again.
    Postings of terms that no query has are dropped before anything is joined or counted.
    """
    asked = queries.select("query_id", F.explode(T.retrieval_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    vocabulary = asked.select("term").distinct()
    bounded = vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # the bound of the frequencies too
    hint = F.broadcast if bounded else (lambda df: df)
    tokens = corpus.withColumn("tokens", T.retrieval_tokens(F.col("text"))).withColumn("length", F.size("tokens"))
    totals = tokens.agg(F.count("*").alias("n_chunks"), F.avg("length").alias("average_length"))
    candidate = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    exploded = tokens.select("chunk_id", "length", candidate.alias("candidate"), F.explode("tokens").alias("term")).join(hint(vocabulary), "term", "left_semi")
    postings = exploded.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.first("candidate").alias("candidate"))
    frequencies = hint(postings.groupBy("term").agg(F.count("*").alias("df")))
    ratio = F.when(F.col("average_length") > 0, F.col("length") / F.col("average_length")).otherwise(1.0)
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * ratio))
    weighted = postings.filter("candidate").join(frequencies, "term").crossJoin(F.broadcast(totals)).select("term", "chunk_id", weight.alias("weight"))
    scored = asked.join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))
    return scored.filter("score > 0")


def _query_blocks(queries: DataFrame, block: int, collect=DataFrame.collect) -> Iterator:
    """Rows of a stated set of queries, in blocks of about ``block``."""
    n = max(1, -(-queries.count() // block))
    for number in range(n):
        yield collect(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number) if n > 1 else queries)


def _gathered(rows: DataFrame) -> DataFrame:
    """Two tasks a core at most, as every task gives away the k best hits of every query."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _fits(wanted: tuple[list, list], companies: list, years: list) -> np.ndarray:
    """Queries x chunks: whether the metadata of a chunk fits the filters of a query; what is missing is no mismatch."""
    fits = np.ones((len(wanted[0]), len(companies)), dtype=bool)
    for own, actual in zip(wanted, (companies, years)):
        codes = {v: i for i, v in enumerate(dict.fromkeys(v for v in (*own, *actual) if v is not None))}
        w, a = (np.array([-1 if v is None else codes[v] for v in values], dtype=np.int32) for values in (own, actual))
        fits &= (w[:, None] == a[None, :]) | (w < 0)[:, None] | (a < 0)[None, :]
    return fits


def _best_fitting(found: DataFrame, k: int) -> DataFrame:
    """Of each query the k best hits that fit, or of all where none does."""
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "fits").orderBy(F.round("score", 9).desc(), "chunk_id"))).filter(F.col("place") <= k)
    return best.withColumn("any_fit", F.max("fits").over(Window.partitionBy("query_id"))).filter(F.col("fits") | ~F.col("any_fit"))


def _described() -> list[Column]:
    return [F.lower("company").alias("company"), F.col("fiscal_year").cast("string").alias("year")]


class _Running:
    """The k best hits of each query that a task has seen, by score to nine places, ties to the smaller id.

    Hits that can still be among them wait, and are sorted with those held once there are as many as these.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.least = np.full(n, -np.inf)  # the score that a hit must reach once there are k
        self.names: list = []
        # of the hits held and waiting: query, score to nine places, place of the id in names, score
        self.hits: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: list, possible: np.ndarray | None = None, first: int = 0) -> None:
        """Scores of queries x hits, the queries from ``first`` on; hits that are not possible do not count."""
        if not scores.size:
            return
        near = scores >= (self.least[first : first + len(scores)] - 1e-9)[:, None]  # what rounds to the least counts too
        if possible is not None:
            near &= possible
        if scores.shape[1] > self.k and np.count_nonzero(near) > near.size // 8:
            top = np.partition(np.where(near, scores, -np.inf), -self.k, axis=1)[:, -self.k]
            near &= scores >= (top - 2e-9)[:, None]  # ties of the last place stay; the ids decide among them
        q, j = np.nonzero(near)
        if not len(q):
            return
        own = scores[q, j]
        used, places = np.unique(j, return_inverse=True)
        self.hits.append(((q + first).astype(np.int32), np.round(own, 9), places + len(self.names), own))
        self.names += [ids[i] for i in used.tolist()]
        self.waiting += len(q)
        if self.waiting > max(self.n * self.k, 65_536):
            self._settle()

    def _settle(self) -> None:
        if not self.waiting:
            return
        q, rounded, places, own = map(np.concatenate, zip(*self.hits))
        order = np.empty(len(self.names), dtype=np.int64)
        order[sorted(range(len(self.names)), key=lambda i: (self.names[i] is not None, self.names[i]))] = np.arange(len(self.names))
        by = np.lexsort((order[places], -rounded, q))
        q = q[by]
        local = np.arange(len(q)) - np.searchsorted(q, q)
        kept, last = local < self.k, local == self.k - 1
        self.least[q[last]] = rounded[by[last]]
        by = by[kept]
        used, places = np.unique(places[by], return_inverse=True)
        self.names = [self.names[i] for i in used.tolist()]
        self.hits, self.waiting = [(q[kept], rounded[by], places, own[by])], 0

    @property
    def best(self) -> list[list[tuple[float, object, float]]]:
        """Of each query (-score to nine places, id, score), best first."""
        self._settle()
        out: list[list] = [[] for _ in range(self.n)]
        for hits in self.hits:
            for q, rounded, place, own in zip(*(part.tolist() for part in hits)):
                out[q].append((-rounded, self.names[place], own))
        return out

    def rows(self, query_ids: list, kinds: tuple[str, str], fits: bool) -> pa.RecordBatch:
        self._settle()
        q, _, places, own = self.hits[0] if self.hits else [np.array([], dtype=np.int64)] * 4
        ids = pa.array(query_ids, pa_type(kinds[1])).take(pa.array(q)), pa.array(self.names, pa_type(kinds[0])).take(pa.array(places))
        return pa.RecordBatch.from_arrays([*ids, pa.array(own, pa.float64()), pa.array(np.full(len(q), fits))], names=["query_id", "chunk_id", "score", "fits"])


#: Queries and hits of one matrix of scores in a task.
MATRIX_QUERIES, MATRIX_HITS = 4096, 512
#: Terms are added by a product of matrices where a batch would meet more cells of theirs than that, the commonest first.
COMMON_CELLS, COMMON_TERMS = 1500, 1024


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int, where: Column | None = None, filters: DataFrame | None = None, block: int = 32_768) -> DataFrame:
    """(query_id, chunk_id, rank, score): the k best chunks of every query, as top_k(bm25(...)) gives them.

    The postings join of a common term with every query that has it grows with both sides. Here the queries are a
    stated set, taken in blocks of ``block``: a first pass counts the frequencies of their terms, summed in each task
    before the shuffle; a second joins the postings of a batch of chunks with the queries of each term and adds the
    weights to a queries x chunks matrix, those of the commonest terms as a product of matrices. A task keeps the k best
    of each query and gives them away once, at its end; no scored pair is shuffled.

    ``filters`` (query_id, company, fiscal_year) limits each query to the chunks of its metadata, as filtered() does:
    a query that no chunk with a positive score matches gets its unfiltered ranking.
    """
    context = corpus.sparkSession.sparkContext
    kinds = corpus.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    candidate = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    described = _described() if filters is not None else [F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("year")]
    rows = corpus.select("chunk_id", "text", candidate.alias("candidate"), *described)
    asked = queries.select("query_id", T.retrieval_tokens(F.col("query")).alias("terms"))
    if filters is not None:
        asked = asked.join(filters.select("query_id", *_described()), "query_id", "left")
    n_chunks, average, found = None, None, None
    for part in _query_blocks(asked, block):
        if not part:
            continue
        ids, query_terms = [r.query_id for r in part], [Counter(r.terms or ()) for r in part]
        known = {t: j for j, t in enumerate(sorted({t for c in query_terms for t in c}))}
        vocabulary = context.broadcast(known)

        def count(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary) -> Iterator[pa.RecordBatch]:
            places, totals, n, length = vocabulary.value, Counter(), 0, 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    tokens = _tokens(text)
                    n, length = n + 1, length + len(tokens)
                    totals.update({places[t] for t in tokens if t in places})
            yield pa.RecordBatch.from_pydict({"place": pa.array([-2, -1, *totals], pa.int32()), "n": pa.array([length, n, *totals.values()], pa.int64())})

        counted = {r.place: r.n for r in corpus.select("text").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block
        if n_chunks is None:
            n_chunks = counted.get(-1, 0)
            average = counted.get(-2, 0) / n_chunks if n_chunks else 0.0
        idf = np.zeros(len(known))
        meets = np.zeros(len(known))
        for j, df in counted.items():
            if j >= 0:
                idf[j] = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
                meets[j] = df / n_chunks * MATRIX_HITS
        parts = []
        for at in range(0, len(part), MATRIX_QUERIES):
            having: dict[int, tuple[list, list]] = {}
            for i, c in enumerate(query_terms[at : at + MATRIX_QUERIES]):
                for t, n in c.items():
                    own = having.setdefault(known[t], ([], []))
                    own[0].append(i)
                    own[1].append(n)
            met = {j: len(own[0]) * meets[j] for j, own in having.items()}
            common = sorted((j for j in met if met[j] > COMMON_CELLS), key=lambda j: (-met[j], j))[:COMMON_TERMS]
            parts.append((at, min(MATRIX_QUERIES, len(part) - at), {j: (np.array(own), np.array(times, dtype=float)) for j, (own, times) in having.items()}, common))
        names = ([r.company for r in part], [r.year for r in part]) if filters is not None else None
        shared = context.broadcast((ids, parts, idf, average, names))

        def score(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary, shared=shared) -> Iterator[pa.RecordBatch]:
            places = vocabulary.value
            ids, parts, idf, average, names = shared.value
            running = _Running(len(ids), k), _Running(len(ids), k)
            products = []
            for _, size, having, common in parts:
                product = np.zeros((size, len(common)))
                for column, j in enumerate(common):
                    product[having[j][0], column] = having[j][1]
                products.append((product, frozenset(common)))
            for whole in batches:
                for at in range(0, whole.num_rows, MATRIX_HITS):  # bounds the matrix
                    batch = whole.slice(at, MATRIX_HITS)
                    n = batch.num_rows
                    postings: dict[int, tuple[list, list]] = {}
                    lengths = np.zeros(n)
                    for c, text in enumerate(batch.column(1).to_pylist()):
                        tokens = _tokens(text)
                        lengths[c] = len(tokens)
                        for j, tf in Counter([places[t] for t in tokens if t in places]).items():
                            chunks, tfs = postings.setdefault(j, ([], []))
                            chunks.append(c)
                            tfs.append(tf)
                    damping = K1 * (1 - B + B * (lengths / average if average else 1.0))
                    weights = {}
                    for j, (chunks, tfs) in postings.items():
                        chunks, tfs = np.array(chunks), np.array(tfs, dtype=float)
                        weights[j] = chunks, idf[j] * tfs * (K1 + 1) / (tfs + damping[chunks])
                    allowed = np.array(batch.column(2).to_pylist(), dtype=bool)
                    chunk_ids = batch.column(0).to_pylist()
                    described = (batch.column(3).to_pylist(), batch.column(4).to_pylist()) if names is not None else None
                    for (first, size, having, common), (product, by_product) in zip(parts, products):
                        of_common = np.zeros((len(common), n))
                        for row, j in enumerate(common):
                            if j in weights:
                                of_common[row, weights[j][0]] = weights[j][1]
                        scores = product @ of_common
                        for j, (chunks, own) in weights.items():
                            if j in having and j not in by_product:
                                asking, times = having[j]
                                scores[asking[:, None], chunks] += np.outer(times, own)
                        possible = (scores > 0) & allowed
                        if names is None:
                            running[0].add(scores, chunk_ids, possible, first)
                        else:
                            fits = _fits(tuple(own[first : first + size] for own in names), *described)
                            running[0].add(scores, chunk_ids, fits & possible, first)
                            running[1].add(scores, chunk_ids, ~fits & possible, first)
            yield running[0].rows(ids, kinds, True)
            if names is not None:
                yield running[1].rows(ids, kinds, False)

        scored = _gathered(rows).mapInArrow(score, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double, fits boolean")
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        return top_k(rows.limit(0).select(F.lit(None).cast(kinds[1]).alias("query_id"), "chunk_id", F.lit(0.0).alias("score")), k)
    if filters is not None:
        found = _best_fitting(found, k)
    return top_k(found.select("query_id", "chunk_id", "score"), k)


def pa_type(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]


_TOKEN = re.compile(T.TOKEN)
_STOP = frozenset(T.STOPWORDS)


def _tokens(text: str | None) -> list[str]:
    return [t for t in _TOKEN.findall(text.lower()) if t not in _STOP] if text else []


def dense(index: DataFrame, queries: DataFrame, k: int, block: int = 16_384, filters: DataFrame | None = None) -> DataFrame:
    """Exhaustive cosine search: (query_id, chunk_id, rank, score).

    ``index`` has chunk_id and vector, ``queries`` query_id and vector, of one dimension. The queries are a stated set
    and are taken in blocks of ``block``; each block is one broadcast matrix, each batch of the index one product with
    it, and a task gives away the k best of each query once, at its end.

    ``filters`` (query_id, company, fiscal_year) limits each query to the chunks of its metadata before any cut, as
    filtered() does; the index then has company and fiscal_year too. A query that no chunk fits gets its unfiltered
    ranking, so the k best others leave the task as well.
    """
    kinds = index.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    context = index.sparkSession.sparkContext
    rows = index.select("chunk_id", "vector", *(_described() if filters is not None else ()))
    asked = queries.select("query_id", "vector")
    if filters is not None:
        asked = asked.join(filters.select("query_id", *_described()), "query_id", "left")
    best = None
    for part in _query_blocks(asked, block, lambda df: df.toArrow()):  # as numbers, not as Python's objects
        ids, matrix = part.column("query_id").to_pylist(), _matrix(part.column("vector").combine_chunks())
        shared = context.broadcast((ids, matrix, (part.column("company").to_pylist(), part.column("year").to_pylist()) if filters is not None else None))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, wanted = shared.value
            running = _Running(len(ids), k), _Running(len(ids), k)
            for whole in batches:
                whole = whole.filter(whole.column(1).is_valid())
                for at in range(0, whole.num_rows if len(ids) else 0, MATRIX_HITS):  # bounds the matrix
                    batch = whole.slice(at, MATRIX_HITS)
                    part = _matrix(batch.column(1))
                    if part.shape[1] != matrix.shape[1]:
                        raise ValueError(f"index of dimension {part.shape[1]}, queries of {matrix.shape[1]}")
                    names = batch.column(0).to_pylist()
                    described = (batch.column(2).to_pylist(), batch.column(3).to_pylist()) if wanted is not None else None
                    for first in range(0, len(ids), MATRIX_QUERIES):
                        scores = matrix[first : first + MATRIX_QUERIES] @ part.T
                        if wanted is None:
                            running[0].add(scores, names, None, first)
                        else:
                            fits = _fits(tuple(own[first : first + MATRIX_QUERIES] for own in wanted), *described)
                            running[0].add(scores, names, fits, first)
                            running[1].add(scores, names, ~fits, first)
            yield running[0].rows(ids, kinds, True)
            if wanted is not None:
                yield running[1].rows(ids, kinds, False)

        found = _gathered(rows).mapInArrow(search, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double, fits boolean")
        best = found if best is None else best.unionByName(found)
    if filters is not None:
        best = _best_fitting(best, k)
    return top_k(best.select("query_id", "chunk_id", "score"), k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    lengths = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1 or vectors.null_count:
        raise ValueError(f"vectors of dimensions {lengths.tolist()}")
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), int(lengths[0]) if len(lengths) else 0)


def reciprocal_rank_fusion(*rankings: DataFrame, weights: tuple[float, ...] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score): sum of weight / (k + rank) over the rankings."""
    weights = weights or (1.0,) * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("one weight for each ranking")
    parts = [r.select("query_id", "chunk_id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def lexical_rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): coverage of the query's distinct terms, rarity counted among the query's candidates,
    and a bonus for terms that stand close together. A group is the candidates of one query, at most the depth.
    """
    passages = hits.select("query_id", "chunk_id").join(corpus.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    kinds = hits.schema["query_id"].dataType.simpleString(), hits.schema["chunk_id"].dataType.simpleString()

    def score(group: pd.DataFrame) -> pd.DataFrame:
        terms = list(dict.fromkeys(_tokens(group["query"].iloc[0])))
        tokens = [_tokens(t) for t in group["text"]]
        present = [set(t) for t in tokens]
        idf = {t: np.log(1 + len(group) / (1 + sum(t in p for p in present))) for t in terms}
        total, out = sum(idf.values()), []
        for own, has in zip(tokens, present):
            matched = [t for t in terms if t in has]
            if not matched:
                out.append(0.0)
                continue
            places = [k for k, t in enumerate(own) if t in idf]
            near = max(0.0, 1 - (places[-1] - places[0]) / PROXIMITY_WINDOW) * PROXIMITY_BONUS if len(places) > 1 else 0.0
            out.append(round(sum(idf[t] for t in matched) / total + near, 6))
        return pd.DataFrame({"query_id": group["query_id"], "chunk_id": group["chunk_id"], "score": out})

    return passages.groupBy("query_id").applyInPandas(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


SUFFIX = r"(?i)\b(inc|corp|corporation|co|ltd|llc|plc|company)\b\.?"


def company_aliases(corpus: DataFrame) -> DataFrame:
    """(alias, company): the full name, its first word if longer than three letters, and its head without legal form.

    An alias of several companies goes to one of them only: a full name before a head, then the smaller name.
    """
    names = corpus.select(T.strip(F.col("company")).alias("company")).filter("company <> ''").distinct()
    head = T.strip(F.translate(F.regexp_replace("company", SUFFIX, ""), ",", " "))
    first = F.lower(F.element_at(F.split(head, r"\s+"), 1))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.lower("company").alias("alias")), F.struct(F.lit(1).alias("kind"), F.when(F.length(first) > 3, first).alias("alias")), F.struct(F.lit(2).alias("kind"), F.lower(head).alias("alias")))
    every = names.select("company", F.explode(kinds).alias("a")).select("company", "a.kind", "a.alias").filter("alias is not null and alias <> ''")
    return every.groupBy("alias").agg(F.min(F.struct(F.least("kind", F.lit(1)), "company")).alias("m")).select("alias", F.col("m.company").alias("company"))


def extract_filters(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, company, fiscal_year): null where the query names none or more than one.

    An alias is looked for anywhere in the query. Candidates come from an equi-join of the query's runs of up to three
    letters with the first three letters of the alias.
    """
    lowered = queries.select("query_id", F.lower("query").alias("q"), T.years(F.col("query")).alias("years"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1))), lambda i: F.substr(F.col("q"), i, F.lit(n)))
    grams = F.array_distinct(F.concat(runs(1), runs(2), runs(3)))
    candidates = lowered.select("query_id", "q", F.explode(grams).alias("gram")).join(small(aliases.withColumn("gram", F.substring("alias", 1, 3))), "gram")
    named = candidates.filter(F.col("q").contains(F.col("alias"))).groupBy("query_id").agg(F.collect_set("company").alias("companies"))
    joined = lowered.join(named, "query_id", "left")
    return joined.select("query_id", F.when(F.size("companies") == 1, F.col("companies")[0]).alias("company"), F.when(F.size("years") == 1, F.col("years")[0].cast("int")).alias("fiscal_year"))


def metadata_matches(company: Column, fiscal_year: Column) -> Column:
    """Filter values of a query against a chunk's columns c_company and c_fiscal_year; missing metadata is no mismatch."""
    same = lambda wanted, actual: wanted.isNull() | actual.isNull() | (F.lower(wanted.cast("string")) == F.lower(actual.cast("string")))
    return same(company, F.col("c_company")) & same(fiscal_year, F.col("c_fiscal_year"))


def filtered(scored: DataFrame, filters: DataFrame, metadata: DataFrame, k: int) -> DataFrame:
    """Top k of the chunks that match a query's filters; of all chunks for a query whose filters match none.

    The filter comes before the cut, so it never costs a query its answer. ``metadata`` has chunk_id, company,
    fiscal_year.
    """
    described = metadata.select("chunk_id", F.col("company").alias("c_company"), F.col("fiscal_year").alias("c_fiscal_year"))
    judged = scored.join(filters, "query_id", "left").join(described, "chunk_id").withColumn("matches", metadata_matches(F.col("company"), F.col("fiscal_year")))
    judged = judged.withColumn("any_match", F.max("matches").over(Window.partitionBy("query_id")))
    kept = judged.filter(F.col("matches") | ~F.col("any_match"))
    return top_k(kept.select("query_id", "chunk_id", "score"), k)


def add_to_index(index: DataFrame, chunks: DataFrame, embedder=None) -> DataFrame:
    """Chunks that the index does not know yet, with their vectors where there is an embedder (text to vector); repeats
    among the new ones are kept as they are."""
    fresh = chunks.join(index.select("chunk_id"), "chunk_id", "left_anti")
    return fresh if embedder is None else fresh.withColumn("vector", embedder(F.col("text")))
