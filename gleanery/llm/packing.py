"""Problem 7: filling containers of fixed capacity with texts of varying token counts.

Method: hierarchical multi-length packing over the histogram of lengths. A text above the capacity is cut into full
containers and a rest; no other text is divided. Every text is routed to the shortest of several contexts (the
capacity, its half, quarter and eighth) that holds it. Each tier is packed by itself, the longest first: a container of
the tier for context c holds capacity / c windows of c tokens, and every window opens with a text of this tier. The
gaps of its windows together are then filled from shorter tiers: with one text or two that fill them to the last token
where there are such, else with the longest that fits, over again; only where the shorter tiers have nothing that fits,
from the tier itself. A pattern so found is taken as many times as the counts allow. The tiers' containers, in order,
are dealt to step groups in turn, to and fro, so all groups hold like shares of each tier and pattern and their
attention cost is balanced.

Scale: the plan is made from at most CAPACITY counts, whatever the number of texts. Texts find their place by their
rank among those of equal length, counted in hashed buckets so that a length shared by a third of all texts is not
ranked in one task. The vocabulary, of at most VOCABULARY_BYTES, is read once on the driver and broadcast.

Defined results: a null or empty text has no tokens and is put into container 0 as a piece of no length; a null id is
an id like any other; an empty table gives no containers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import checkpointed

CAPACITY = 2048
GROUP_WINDOWS = 64
BUCKET_ROWS = 20_000
CONTEXTS = (2048, 1024, 512, 256)
VOCABULARY_BYTES = 1 << 26
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every row; ``vocabulary`` is a path that the driver can read."""
    content = Path(vocabulary).read_bytes()
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of {len(content)} bytes, above {VOCABULARY_BYTES}")
    shared = df.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(shared.value).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {df.schema[id_col].dataType.simpleString()}, n_tokens long")


def contexts_of(capacity: int, contexts: tuple[int, ...] = CONTEXTS) -> list[int]:
    """The contexts that fit a capacity, the longest, which is the capacity itself, first."""
    return sorted({capacity, *(c for c in contexts if c < capacity)}, reverse=True)


def _fill(left: np.ndarray, taken: dict[int, int], gap: int, upper: int) -> int:
    """The next length of at most ``upper`` for a gap: one that fills it alone, the longer of two that do, else the longest."""
    top = min(gap, upper)
    free = left[: top + 1].copy()
    for length, n in taken.items():
        if length <= top:
            free[length] -= n
    lengths = np.flatnonzero(free[1:] > 0) + 1
    if not len(lengths):
        return 0
    if lengths[-1] == gap:
        return gap
    other = gap - lengths
    fits = (other <= top) & (other <= lengths)
    fits[fits] = free[other[fits]] > (other[fits] == lengths[fits])
    return int(lengths[fits][-1] if fits.any() else lengths[-1])


def plan(counts: dict[int, int], capacity: int = CAPACITY, contexts: tuple[int, ...] = CONTEXTS) -> tuple[np.ndarray, list[int]]:
    """Slots for every length, and the number of containers of each tier.

    A slot row is (length, first rank, end rank, first container, offset): the text of rank r goes to container
    first container + r - first rank, at the offset. Containers are numbered tier by tier, the longest first.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    slots, containers, sizes = [], 0, contexts_of(capacity, contexts)
    of_tier = []
    for context, shorter in zip(sizes, [*sizes[1:], 0]):
        first = containers
        while left[shorter + 1 : context + 1].any():
            pattern: list[int] = []
            taken: dict[int, int] = {}
            gap = capacity

            def put(length: int) -> None:
                nonlocal gap
                pattern.append(length)
                taken[length] = taken.get(length, 0) + 1
                gap -= length

            for _ in range(capacity // context):  # each window opens with the longest text of the tier
                own = [int(k) for k in np.flatnonzero(left[shorter + 1 : min(context, gap) + 1])[::-1] + shorter + 1 if left[k] > taken.get(int(k), 0)]
                if own:
                    put(own[0])
            while gap and (length := _fill(left, taken, gap, shorter) or _fill(left, taken, gap, context)):
                put(length)
            times = min(left[length] // n for length, n in taken.items())
            offset = 0
            for length in pattern:
                slots.append((length, used[length], used[length] + times, containers, offset))
                used[length] += times
                left[length] -= times
                offset += length
            containers += int(times)
        of_tier.append(containers - first)
    return np.array(slots, dtype=np.int64).reshape(-1, 5), of_tier


def pack(counted: DataFrame, capacity: int = CAPACITY, contexts: tuple[int, ...] = CONTEXTS) -> DataFrame:
    """(id, piece_no, token_start, token_end, container_id, container_offset, context, step_group) of every text.

    ``counted`` has id and n_tokens; context is the tier of the container.
    """
    kind = counted.schema["id"].dataType.simpleString()
    full = F.expr(f"n_tokens div {capacity}").cast("int")
    rest = (F.col("n_tokens") % capacity).cast("int")
    starts = F.when(F.col("n_tokens") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(rest > 0, full).otherwise(full - 1)))
    items = counted.select("id", "n_tokens", F.explode(starts).alias("piece_no"))
    items = items.select("id", "piece_no", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("size"))
    items = checkpointed(items)
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    empty = histogram.pop(0, 0)
    slots, of_tier = plan(histogram, capacity, contexts)
    sizes, ends = np.array(contexts_of(capacity, contexts)), np.cumsum(of_tier)
    n_buckets = 1 + (max([*histogram.values(), empty]) if histogram or empty else 0) // BUCKET_ROWS
    items = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(n_buckets)).cast("int"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("size", "bucket").agg(F.count("*").alias("n")).select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("size", "bucket").orderBy("id", "piece_no")
    ranked = items.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["size", "bucket"]).select("id", "piece_no", "size", (F.col("rank") + F.col("before")).alias("rank"))
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = slots[order]
    n_groups = max(1, -(-int(ends[-1]) // GROUP_WINDOWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots[:, 0] * (np.int64(1) << np.int64(44)) + slots[:, 1]
        for batch in batches:
            piece = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            size = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(slots):
                k = np.maximum(np.searchsorted(keys, size * (np.int64(1) << np.int64(44)) + rank, "right") - 1, 0)
                window = np.where(size > 0, slots[k, 3] + rank - slots[k, 1], 0)
                offset = np.where(size > 0, slots[k, 4], 0)
            else:
                window = offset = np.zeros(len(size), dtype=np.int64)
            turn, seat = window // n_groups, window % n_groups
            group = np.where(turn % 2 == 0, seat, n_groups - 1 - seat)
            context = sizes[np.minimum(np.searchsorted(ends, window, "right"), len(sizes) - 1)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(piece * capacity + size), pa.array(window), pa.array(offset.astype(np.int32)), pa.array(context), pa.array(group)],
                names=["id", "piece_no", "token_start", "token_end", "container_id", "container_offset", "context", "step_group"],
            )

    return ranked.mapInArrow(place, f"id {kind}, piece_no int, token_start long, token_end long, container_id long, container_offset int, context int, step_group long")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """By tier, and for all of them with a null context: containers, tokens, the share of unused places, and how far
    the step groups are apart in containers of the tier and in attention cost (squared text lengths), as a share of
    the mean."""
    size = F.col("token_end") - F.col("token_start")
    containers = packed.groupBy("container_id", "context", "step_group").agg(F.sum(size).alias("tokens"), F.sum(size * size).alias("cost"))
    groups = containers.groupBy("step_group", "context").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count("*").alias("containers"))
    every = groups.unionByName(groups.groupBy("step_group").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("containers").alias("containers")), allowMissingColumns=True)
    n_groups = packed.agg((F.max("step_group") + 1).alias("n_groups"))
    # a group without containers of a tier has no row
    least = lambda c: F.when(F.count("*") < F.first("n_groups"), 0).otherwise(F.min(c))
    return every.crossJoin(F.broadcast(n_groups)).groupBy("context").agg(
        F.sum("containers").alias("n_containers"),
        F.sum("tokens").alias("n_tokens"),
        F.round(1 - F.sum("tokens") / (F.sum("containers") * capacity), 6).alias("unused_share"),
        (F.max("containers") - least("containers")).alias("containers_apart"),
        F.round((F.max("cost") - least("cost")) * F.first("n_groups") / F.sum("cost"), 4).alias("cost_apart"),
    )
