"""Packing documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens (only the last piece of
a document may be shorter); a full piece is a sequence of its own.  The other
pieces are dealt by a hash into blocks of about ``BLOCK`` pieces.  Each block
is worked on by ``ISLANDS`` islands, groups of rows with a population of
solutions of their own.  A solution is a list of sequences; crossover injects
the other parent's well-filled sequences whole, drops the sequences that hold
a piece twice, and best-fits the displaced pieces in falling order of length.
After every epoch an island's elite also goes to the next island, by an
exchange of rows.  Each block keeps the best of its islands; sequences left
under ``TIGHT`` full are opened and packed again in new blocks, round by round, until
their pieces have been one block or a round closes hardly any.

Defined results: NULL text is empty (the end id only); rows equal in all
columns are separate documents; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.near_dedup import _ROWS as _TEXTS
from tidemark.llm.near_dedup import _small_batches
from tidemark.llm.tokens import blocks, encoder, gives_back, vocabulary
from tidemark.session import materialize

BLOCK = 4096
ISLANDS = 2
POPULATION = 4
EPOCHS = 2
GENERATIONS = 4
TIGHT = 0.9995
SHRINKS = 0.9  # rounds go on while they close a tenth of the open pieces

Solution = list[tuple[int, list[int]]]  # of each sequence: its tokens and its pieces


def _pieces(path: str, end_id: int, capacity: int, dtype: str):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        for batch in batches:
            for b in blocks(batch, "text"):
                ids, ends = enc.encode(b.column("text"))
                n = -(-np.diff(ends) // capacity)  # the end id makes at least one piece of each
                doc = np.repeat(np.arange(b.num_rows), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                first = ends[doc] + start
                last = np.minimum(first + capacity, ends[doc + 1])
                data = [ids[i:j] for i, j in zip(first, last)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(last - first, pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()),
                     pa.array([x.astype(dtype).tobytes() for x in data], pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return run


def cut(docs: DataFrame, capacity: int = 4096, text: str = "text", doc_id: str = "doc_id",
        vocabulary_path: str | None = None, end_id: int = 1, vocabulary_size: int = 49408) -> DataFrame:
    """Pieces of all documents, written once: ``uid`` (unique), ``doc_id``,
    ``piece``, ``start``, ``length``, ``ids_crc32`` (of 32-bit ids), ``ids``
    (little-endian, 16 or 32 bit, as the vocabulary needs)."""
    dtype = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = narrow.mapInArrow(_pieces(vocabulary_path or vocabulary(), end_id, capacity, dtype),
                               "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    with _small_batches(docs.sparkSession, _TEXTS):
        return materialize(pieces.withColumn("uid", F.monotonically_increasing_id()))


# --- one island ---

def best_fit(bins: Solution, pieces: list[int], length: list[int], capacity: int) -> Solution:
    """Put each piece where it leaves the least room, else into a new sequence."""
    room = sorted((capacity - fill, k) for k, (fill, _) in enumerate(bins))
    bins = [(fill, list(held)) for fill, held in bins]
    for p in pieces:
        size = length[p]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k] = (bins[k][0] + size, bins[k][1])
            bins[k][1].append(p)
        else:
            left, k = capacity, len(bins)
            bins.append((size, [p]))
        if left > size:
            insort(room, (left - size, k))
    return bins


def fitness(bins: Solution, capacity: int) -> tuple[float, float]:
    """Fewer sequences first, then the unevenness of their filling."""
    return -len(bins), sum((fill / capacity) ** 2 for fill, _ in bins)


def crossover(a: Solution, b: Solution, length: list[int], capacity: int, rng: np.random.Generator) -> Solution:
    """``a`` with some of the best-filled sequences of ``b`` injected whole."""
    well = sorted(range(len(b)), key=lambda k: -b[k][0])[:max(1, len(b) // 2)]
    chosen = [b[k] for k in rng.permutation(well)[:max(1, len(b) // 8)]]
    injected = {p for _, held in chosen for p in held}
    kept, displaced = list(chosen), []
    for fill, held in a:
        if injected.isdisjoint(held):
            kept.append((fill, held))
        else:
            displaced += [p for p in held if p not in injected]
    displaced.sort(key=lambda p: -length[p])
    return best_fit(kept, displaced, length, capacity)


def mutate(a: Solution, length: list[int], capacity: int, rng: np.random.Generator) -> Solution:
    """Open the emptiest sequences and a few others and best-fit their pieces."""
    order = sorted(range(len(a)), key=lambda k: a[k][0])
    opened = {*order[:2], *rng.integers(0, len(a), max(1, len(a) // 20)).tolist()}
    loose = [p for k in opened for p in a[k][1]]
    loose.sort(key=lambda p: -length[p])
    return best_fit([x for k, x in enumerate(a) if k not in opened], loose, length, capacity)


def evolve(length: list[int], population: list[Solution], capacity: int, seed) -> list[Solution]:
    """``POPULATION`` solutions after ``GENERATIONS`` steps, the best first."""
    rng = np.random.default_rng(seed)
    falling = sorted(range(len(length)), key=lambda p: -length[p])
    while len(population) < POPULATION:  # best fit decreasing, then the same with noise in the order
        order = falling if not population else sorted(
            falling, key=dict(zip(falling, (-np.array(length)[falling] * rng.uniform(0.7, 1.3, len(falling))).tolist())).get)
        population.append(best_fit([], order, length, capacity))
    floor = -(-sum(length) // capacity)
    ranked = sorted(population, key=lambda s: fitness(s, capacity), reverse=True)[:POPULATION]
    for _ in range(GENERATIONS):
        if len(ranked[0]) == floor:  # no solution has fewer sequences
            break
        children = [crossover(ranked[i], ranked[j], length, capacity, rng)
                    for i, j in (rng.choice(len(ranked), 2, replace=False) for _ in range(2))]
        children.append(mutate(ranked[0], length, capacity, rng))
        ranked = sorted(ranked + children, key=lambda s: fitness(s, capacity), reverse=True)[:POPULATION]
    return ranked


def _offer(solutions: list[Solution], uid: np.ndarray, length: list[int], block: int, island: int, origin: int) -> pd.DataFrame:
    """Solutions as rows: one a piece and solution."""
    out = []
    for k, s in enumerate(solutions):
        held = [p for _, h in s for p in h]
        out.append(pd.DataFrame({
            "block": block, "island": island, "origin": origin, "solution": k, "uid": uid[held],
            "length": np.array(length, np.int64)[held],
            "seq": np.repeat(np.arange(len(s)), [len(h) for _, h in s])}))
    return pd.concat(out)


def _taken(rows: pd.DataFrame) -> tuple[np.ndarray, list[int], list[Solution]]:
    """The rows' pieces and the solutions that came with them."""
    rows = rows.sort_values(["origin", "solution", "seq", "uid"], kind="stable")
    uid, first, index = np.unique(rows["uid"].to_numpy(), return_index=True, return_inverse=True)
    length = rows["length"].to_numpy()[first].tolist()
    solutions: list[Solution] = []
    for _, own in rows.assign(p=index)[rows["seq"].to_numpy() >= 0].groupby(["origin", "solution"], sort=True):
        solutions.append([(sum(length[p] for p in held), held) for held in own.groupby("seq")["p"].agg(list)])
    return uid, length, solutions


_ROWS = "block long, island int, origin int, solution int, uid long, length long, seq int"


def _epoch(capacity: int, seed: int, epoch: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, island = int(rows["block"].iloc[0]), int(rows["island"].iloc[0])
        uid, length, solutions = _taken(rows)
        ranked = evolve(length, solutions, capacity, [seed, epoch, block, island])
        if last:
            return _offer(ranked[:1], uid, length, block, island, island)
        stay = _offer(ranked[:2], uid, length, block, island, island)
        return pd.concat([stay, stay[stay["solution"] == 0].assign(island=(island + 1) % ISLANDS)])
    return run


def _best(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        uid, length, solutions = _taken(rows)
        best = max(solutions, key=lambda s: fitness(s, capacity))
        out = []
        for fill, held in best:
            sizes = np.array(length)[held]
            out.append(pd.DataFrame({"uid": uid[held], "length": sizes, "sequence_id": uid[held].min(), "fill": fill,
                                     "offset": np.cumsum(sizes) - sizes}))
        return pd.concat(out)
    return run


def _evolved(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """``uid, length`` -> ``uid, length, sequence_id, fill, offset``."""
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, round(items.count() / BLOCK))
    rows = items.select(
        F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(n_blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("origin"),
        F.lit(0).alias("solution"), "uid", "length", F.lit(-1).alias("seq"))
    for epoch in range(EPOCHS):
        rows = (rows.repartition(tasks, "block", "island").groupBy("block", "island")
                .applyInPandas(_epoch(capacity, seed, epoch, epoch == EPOCHS - 1), _ROWS))
    return (rows.repartition(tasks, "block").groupBy("block")
            .applyInPandas(_best(capacity), "uid long, length long, sequence_id long, fill long, offset long"))


def pack(pieces: DataFrame, capacity: int = 4096, seed: int = 23) -> DataFrame:
    """Pieces of :func:`cut` with ``sequence_id`` and ``offset``."""
    loose = pieces.where(F.col("length") < capacity).select("uid", "length")
    tight = F.col("fill") >= TIGHT * capacity
    placed, n_open = [], None
    while True:
        done = materialize(_evolved(loose, capacity, seed + len(placed)))
        left = done.where(~tight).count()
        # pieces in sequences that aren't tight meet others in the next round's blocks
        last = left == 0 or (n_open is not None and (n_open <= BLOCK or left > SHRINKS * n_open))
        placed.append((done if last else done.where(tight)).select("uid", "sequence_id", "offset"))
        if last:
            break
        n_open = left
        loose = materialize(done.where(~tight).select("uid", "length"))
    placed = reduce(DataFrame.unionByName, placed)
    return (pieces.join(placed, "uid", "left")
            .withColumn("sequence_id", F.coalesce("sequence_id", "uid"))
            .withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long")))
