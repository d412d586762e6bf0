"""Problem 1: records that share most of their word runs, without comparing every pair.

Method: covering locality-sensitive hashing. A record's set of word runs is sketched by SYMBOLS min-hash symbols, so
that two records of similarity s differ in a share 1 - s of the symbols on average. The symbols are split into groups
of GROUP positions. Each position of a group carries a vector of F_2^2 other than zero, and each mask of the group,
one for each non-zero v of F_2^2, keeps the positions whose vector has an odd product with v. For any single differing
position some v is orthogonal to its vector, so some mask of the group leaves it out: two records that differ in at
most one symbol of any group agree under one of its masks and meet in that table. By the pigeonhole principle every
pair within Hamming distance RADIUS = 2 * GROUPS - 1 is certain to meet; beyond it pairs meet with a chance that falls
with the distance (in all 0.9997 at similarity 0.7, 0.985 at 0.6).

Scale: records of equal run sets are one class and take part once, so a hot group of copies costs one representative.
Only keys and class numbers are shuffled to find candidates. Keys of more than about HOT classes, recognised by a
hashed share of one SAMPLE-th of the classes, are cut into blocks of BLOCK classes, and each pair of blocks is a task's
work of its own; the share decides on the cut alone, every class takes part. Run sets are read a second time, for the
classes in a candidate pair alone: their ids, hashed to at most BUCKETS numbers, are broadcast to drop most other texts
before the shuffle. The similarity of each candidate is computed exactly, in a grid of cells of about CELL pairs: a run
set goes once to each cell where it has a pair, not once to each pair, so many variants of one text cost no square of
their sets. The name of a table is part of the hash of a class and of its keys, so records of different tables never
meet.

Defined results: null texts and texts without letters or digits belong to no class and no pair; a text of fewer words
than a run is one run; a repeated id counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.words import mix, shingle_set
from gleanery.session import checkpointed

GROUP = 6  # symbols in a group: two for each non-zero vector of F_2^2
GROUPS = 12
SYMBOLS = GROUP * GROUPS
RADIUS = 2 * GROUPS - 1
BUCKETS = 1 << 20
HOT, SAMPLE, BLOCK = 4096, 32, 2048
CELL, TASK_CELLS, MOST_TASKS = 5_000, 1, 20_000
BROADCAST_KEYS = 1_000_000
#: The vectors of F_2^2 at the positions of a group, and the masks: one row for each v, true where <vector, v> = 1.
VECTORS = [(0, 1), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1)]
MASKS = np.array([[(v[0] * a + v[1] * b) % 2 == 1 for a, b in VECTORS] for v in ((0, 1), (1, 0), (1, 1))])

_rng = np.random.default_rng(20)
_SEEDS = _rng.integers(1, 2**32, size=(2, SYMBOLS), dtype=np.uint64).astype(np.uint32)
_SEEDS[0] |= np.uint32(1)


def symbols(runs: np.ndarray) -> np.ndarray:
    """The min-hash symbols of a non-empty set of run hashes."""
    low = (runs ^ (runs >> np.uint64(32))).astype(np.uint32)
    out = np.full(SYMBOLS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(low), 4096):
        h = low[k : k + 4096, None] * _SEEDS[0] + _SEEDS[1]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """A row of keys for each signature, one for each (group, mask): equal where all symbols that the mask keeps are."""
    groups = signatures.reshape(-1, GROUPS, GROUP).astype(np.uint64)
    keys = np.zeros((len(groups), GROUPS, len(MASKS)), dtype=np.uint64)
    for m, mask in enumerate(MASKS):
        for k in np.flatnonzero(mask):
            keys[:, :, m] = mix(keys[:, :, m] * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, k] + np.uint64(1))
    tables = np.arange(GROUPS * len(MASKS), dtype=np.uint64).reshape(keys.shape[1:])
    return mix(keys ^ (tables << np.uint64(56))).reshape(len(groups), GROUPS * len(MASKS))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                kept, classes, sizes, signatures, tables = [], [], [], [], []
                for k, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                    runs = shingle_set(text, size)
                    if len(runs):
                        kept.append(k)
                        tables.append(xxhash.xxh3_64_intdigest(name))
                        classes.append(xxhash.xxh3_64_intdigest(runs.tobytes(), seed=tables[-1]))
                        sizes.append(len(runs))
                        signatures.append(symbols(runs))
                keys = table_keys(np.array(signatures, dtype=np.uint32).reshape(-1, SYMBOLS)) ^ np.array(tables, dtype=np.uint64)[:, None]
                offsets = np.arange(len(kept) + 1, dtype=np.int32) * (GROUPS * len(MASKS))
                kept = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(kept),
                        batch.column(1).take(kept),
                        pa.array(np.array(classes, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(sizes, dtype=np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["table_name", "id", "class_id", "n_runs", "keys"],
                )

    return run


def _run_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class_id", "runs"])

    return run


def _compare(threshold: float):
    """The pairs of one cell whose run sets reach the threshold."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        known = {c: np.frombuffer(r, dtype=np.uint64) for c, r in zip(sets.column("class_id").to_pylist(), sets.column("runs").to_pylist())}
        shares = np.zeros(pairs.num_rows)
        for k, (a, b) in enumerate(zip(pairs.column("class_a").to_pylist(), pairs.column("class_b").to_pylist())):
            x, y = known[a], known[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            shares[k] = both / (len(x) + len(y) - both)
        near = pa.array(np.flatnonzero(shares >= threshold))
        return pa.table({"class_a": pairs.column("class_a").take(near), "class_b": pairs.column("class_b").take(near), "similarity": pa.array(shares).take(near)})

    return run


def _met(keyed: DataFrame, threshold: float, hot: int = HOT, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(class_a, class_b), possibly repeated: classes of like size that share a key; ``keyed`` has class_id, n_runs, key."""
    like = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    shared = keyed.filter(F.pmod(F.xxhash64("class_id"), F.lit(sample)) == 0).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * sample >= hot)
    crowded = checkpointed(shared.select("key", F.ceil(F.col("n") * sample / block).cast("int").alias("blocks")))
    n_crowded = crowded.count()
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_KEYS else crowded
        placed = keyed.join(crowded, "key").withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(1)), "blocks").cast("int"))
        keyed = keyed.join(crowded, "key", "left_anti")
    a, b = F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")
    left = keyed.select("key", a, F.col("n_runs").alias("n_a"))
    right = keyed.select("key", b, F.col("n_runs").alias("n_b"))
    met = left.join(right, "key").filter((F.col("class_a") < F.col("class_b")) & like).select("class_a", "class_b")
    if not n_crowded:
        return met
    left = placed.select("key", a, F.col("n_runs").alias("n_a"), F.col("block").alias("row"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("col"))
    right = placed.select("key", b, F.col("n_runs").alias("n_b"), F.col("block").alias("col"), F.explode(F.sequence(F.lit(0), "block")).alias("row"))
    cut = left.join(right, ["key", "row", "col"]).filter(((F.col("row") < F.col("col")) | (F.col("class_a") < F.col("class_b"))) & (F.col("class_a") != F.col("class_b")) & like)
    return met.unionByName(cut.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")))


class NearDuplicates:
    """Near-duplicate records of one or several tables.

    ``records`` has table_name, id and text; pairs are sought within a table_name. ``members`` (table_name, id,
    class_id) gives the class of equal run sets of every record; ``links`` (class_a, class_b, similarity) the pairs of
    different classes whose similarity reaches the threshold.
    """

    def __init__(self, records: DataFrame, threshold: float = 0.8, run_size: int = 5):
        rows = records.select("table_name", F.col("id").cast("string").alias("id"), "text").filter("table_name is not null and id is not null and text is not null")
        signed = rows.mapInArrow(_signatures(run_size), "table_name string, id string, class_id long, n_runs int, keys array<long>")
        signed = checkpointed(signed)
        self.members = signed.groupBy("table_name", "id").agg(F.min("class_id").alias("class_id"))
        # one record stands for its class
        classes = signed.groupBy("class_id").agg(F.min_by(F.struct("n_runs", "keys"), F.struct("table_name", "id")).alias("r")).select("class_id", "r.*")
        keyed = classes.select("class_id", "n_runs", F.explode("keys").alias("key"))
        self.candidates = candidates = checkpointed(_met(keyed, threshold).distinct())
        wanted = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
        standing = signed.select("class_id", "table_name", "id").join(wanted, "class_id").groupBy("class_id").agg(F.min(F.struct("table_name", "id")).alias("r")).select("class_id", "r.*")
        standing = checkpointed(standing)
        bucket = F.pmod(F.xxhash64("table_name", "id"), F.lit(BUCKETS))
        near = rows.withColumn("bucket", bucket).join(F.broadcast(standing.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")
        texts = near.join(standing, ["table_name", "id"]).select("class_id", "text")
        sets = texts.mapInArrow(_run_sets(run_size), "class_id long, runs binary").dropDuplicates(["class_id"])
        side = max(1, int(np.ceil(np.sqrt(candidates.count() / CELL))))
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        pairs = candidates.withColumn("cell", place("class_a") * side + place("class_b"))
        wanted_in = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id"), F.col("cell").alias("at")).distinct()
        placed = wanted_in.join(sets, "class_id")
        tasks = min(MOST_TASKS, max(1, side * side // TASK_CELLS))  # grows with the pairs, so the work of a task does not
        pairs, placed = pairs.repartition(tasks, "cell"), placed.repartition(tasks, "at")
        self.links = pairs.groupBy("cell").cogroup(placed.groupBy("at")).applyInArrow(_compare(threshold), "class_a long, class_b long, similarity double")

    def record_classes(self) -> DataFrame:
        """One row per record: its class, the number of records in the class and of linked other classes."""
        ends = self.links.select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
        links = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
        copies = self.members.groupBy("class_id").agg(F.count("*").alias("n_copies"))
        return self.members.join(copies.join(links, "class_id", "left").na.fill(0, ["n_links"]), "class_id")

    def record_pairs(self) -> DataFrame:
        """(table_name, id_a, id_b): every pair of records, of one class or of linked classes; the smaller id first."""
        a = self.members.select("table_name", F.col("id").alias("id_1"), F.col("class_id").alias("class_a"))
        b = self.members.select(F.col("id").alias("id_2"), F.col("class_id").alias("class_b"))
        copied = self.members.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
        linked = self.links.select("class_a", "class_b").unionByName(copied)
        pairs = linked.join(a, "class_a").join(b, "class_b").filter("class_a <> class_b or id_1 < id_2")
        return pairs.select("table_name", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))
