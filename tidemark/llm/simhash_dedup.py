"""Near-duplicate groups by SimHash fingerprints and vantage-point trees.

A document's fingerprint has 64 bits: bit ``i`` is 1 if bit ``i`` is set in over
half the XXH64 values (seed 42) of its ``SHINGLE``-word shingles, repeats
included (words end at ASCII white space, A-Z lower-cased).  Fingerprints link
at ``RADIUS`` or fewer differing bits; a group is a connected component.

1. Where texts are read, each becomes its fingerprint; equal fingerprints are
   one class.  Only fingerprints travel from here on.
2. Two fingerprints within 4 bits are within 1 bit in one of three thirds of
   their bits at least.  Each third has a vantage-point tree under its Hamming
   distance, which is a metric.  All nodes of a level share a vantage point and
   a radius (the median distance), so a tree is one short list whatever the
   number of rows, and its leaf is a row's string of inside/outside decisions.
   Points are chosen on a sample of ``SAMPLE`` fingerprints, which only shapes
   the shards: every fingerprint is routed, and the search is exact.
3. A fingerprint lives in one leaf (shard) of each tree.  By the triangle
   inequality its neighbours lie inside if ``d - 1 <= radius`` and outside if
   ``d + 1 > radius``; branches that fail are pruned, where both hold it visits
   both.  A pair with different homes meets in the later one, so visits to
   earlier leaves are left out.
4. Shards are compared whole, on all 64 bits.  A shard with more than ``BLOCK``
   inhabitants is split into blocks, which its visitors all pass.  A task
   streams its visitors past one block and passes on links that join what it
   hasn't joined yet, so a family of m leaves it as about m links, not m².
5. Union-find over the links.

Defined results: NULL, empty and white-space-only texts have fingerprint zero
and link like any other; texts of fewer words have their whole sequence as one
shingle; rows that share an identifier each have their row; a row without
identifier links others but gives no ``component_id`` (NULL if no row of its
group has one); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clear_name
from tidemark.llm.near_dedup import components
from tidemark.llm.tokens import blocks
from tidemark.session import materialize

SHINGLE = 4
RADIUS = 4  # differing bits of a link
SEED = 42
SAMPLE = 4096  # fingerprints that shape the trees
LEAF = 1024  # inhabitants of a shard that are aimed at, or the square root of all if that is more
BLOCK = 4096  # inhabitants that a task holds at a time
_BLOCK_BYTES = 2 << 20  # of text that a worker takes apart at a time
_CHUNK = 1 << 21  # distances that are held at a time
_BITS = 100_000  # hashes whose bits are held at a time


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64 majority bits of the shingles' XXH64."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(size, len(words))
    starts = np.concatenate([[0], ends[:len(words) - size] + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _BITS):
        ones += np.unpackbits(h[k:k + _BITS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch, "text", _BLOCK_BYTES):
            held = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(held.view(np.int64))],
                                             ["row", "doc_id", "fp"])


class Tree(NamedTuple):
    """A vantage-point tree over ``width`` bits from ``shift`` on; one vantage
    point and radius a level."""
    shift: int
    width: int
    points: np.ndarray
    radii: np.ndarray

    def distances(self, fps: np.ndarray) -> np.ndarray:
        part = (fps >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)
        return np.bitwise_count(part[:, None] ^ self.points[None, :]).astype(np.int16)

    def homes(self, fps: np.ndarray) -> np.ndarray:
        """The leaf that each fingerprint lives in."""
        outside = self.distances(fps) > self.radii
        return (outside.astype(np.int64) << np.arange(len(self.points))).sum(axis=1)

    def visits(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """``(index, leaf)``: the later leaves that may hold a neighbour within ``reach``."""
        far = self.distances(fps)
        at, leaf = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for level, radius in enumerate(self.radii):
            d = far[at, level]
            inside, outside = d - reach <= radius, d + reach > radius
            at, leaf = np.concatenate([at[inside], at[outside]]), np.concatenate([leaf[inside], leaf[outside] | (1 << level)])
        later = leaf > self.homes(fps)[at]
        return at[later], leaf[later]


def thirds(radius: int) -> tuple[list[tuple[int, int]], int]:
    """``(shift, width)`` of the parts of 64 bits, and how far two
    fingerprints within ``radius`` are at most in one of them."""
    edges = [0, 21, 42, 64]
    return [(a, b - a) for a, b in zip(edges, edges[1:])], radius // 3


def plant(sample: np.ndarray, n: int, shift: int, width: int) -> Tree:
    """A tree for ``n`` fingerprints.  Vantage points come from the sample, each
    as close as can be to half the bits away from those before it, so that
    levels decide independently of each other."""
    levels = max(0, ceil(log2(max(n, 1) / max(LEAF, n ** 0.5))))
    part = np.unique((sample >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    points: list[np.uint64] = []
    radii: list[int] = []
    uneven = np.zeros(len(part))
    held = (sample >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    for _ in range(min(levels, len(part))):
        best = int(np.argmin(uneven))
        points.append(part[best])
        radii.append(int(np.median(np.bitwise_count(held ^ part[best]))))
        uneven = np.maximum(uneven, np.abs(2.0 * np.bitwise_count(part ^ part[best]) - width))
    return Tree(shift, width, np.array(points, np.uint64), np.array(radii, np.int16))


_PLACED = "tree int, leaf long, visits boolean, fp long"


def _route(batches: Iterator[pa.RecordBatch], forest: list[Tree], reach: int, visiting: bool) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in its home of each tree and, if ``visiting``, where else it must look."""
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for k, tree in enumerate(forest):
            step = max(1, 50_000 >> max(0, len(tree.points) // 3 - 2))
            for a in range(0, len(fps), step):
                own = fps[a:a + step]
                parts = [(np.arange(len(own)), tree.homes(own), False)]
                if visiting:
                    parts.append((*tree.visits(own, reach), True))
                for at, leaf, visits in parts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), k, np.int32)), pa.array(leaf), pa.array(np.full(len(at), visits)),
                        pa.array(own[at].view(np.int64))], ["tree", "leaf", "visits", "fp"])


class Shard:
    """One block of a leaf: its inhabitants, and which of them are joined."""

    def __init__(self, radius: int):
        self.radius = radius
        self.parts: list[np.ndarray] = []
        self.fps = np.zeros(0, np.uint64)
        self.joined = np.zeros(0, np.int64)
        self.links: list[tuple[int, int]] = []

    def _look(self, fps: np.ndarray, first: int | None) -> None:
        """Compare ``fps`` with the inhabitants; ``first``: they are inhabitants
        themselves from this place on, and only earlier ones count."""
        step = max(1, _CHUNK // max(1, len(self.fps)))
        for a in range(0, len(fps), step):
            near = np.bitwise_count(fps[a:a + step, None] ^ self.fps[None, :]) <= self.radius
            for r in np.flatnonzero(near.any(axis=1)):
                hits = np.flatnonzero(near[r])
                if first is not None:
                    hits = hits[hits < first + a + r]
                    if not len(hits):
                        continue
                groups, one = np.unique(self.joined[hits], return_index=True)
                fp = int(fps[a + r])
                self.links += [(fp, int(self.fps[h])) for h in hits[one]]
                if first is not None:
                    self.joined[first + a + r] = groups[0]
                if len(groups) > 1:
                    self.joined[np.isin(self.joined, groups[1:])] = groups[0]

    def settle(self) -> None:
        """All inhabitants have come: compare them with each other."""
        if self.parts:
            self.fps = np.concatenate(self.parts)
            self.parts = []
            self.joined = np.arange(len(self.fps))
            self._look(self.fps, 0)

    def take(self, fps: np.ndarray, visits: np.ndarray) -> None:
        if not visits.all():
            self.parts.append(fps[~visits])
        if visits.any():
            self.settle()
            self._look(fps[visits], None)

    def drain(self) -> pa.RecordBatch:
        out = np.array(self.links, np.uint64).reshape(-1, 2).view(np.int64)
        self.links = []
        return pa.RecordBatch.from_arrays([pa.array(out.max(axis=1)), pa.array(out.min(axis=1))], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``tree, leaf, blk, visits`` -> links that join."""
    shard, place = Shard(radius), None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tree", "leaf", "blk")], axis=1)
        visits = batch.column("visits").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy().view(np.uint64)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            here = tuple(keys[a].tolist())
            if here != place:
                shard.settle()
                if shard.links:
                    yield shard.drain()
                shard, place = Shard(radius), here
            shard.take(fps[a:b], visits[a:b])
        if shard.links:
            yield shard.drain()
    shard.settle()
    yield shard.drain()


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` whose components are
    those of all pairs within ``radius`` bits."""
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    n = fps.count() if len(sample) == SAMPLE else len(sample)
    parts, reach = thirds(radius)
    forest = [plant(sample, n, shift, width) for shift, width in parts]
    homes = fps.mapInArrow(partial(_route, forest=forest, reach=reach, visiting=False), _PLACED)
    crowded = materialize(homes.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
                          .select("tree", "leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blk")))
    placed = fps.mapInArrow(partial(_route, forest=forest, reach=reach, visiting=True), _PLACED)
    if crowded.take(1):  # in the plan only where some shard is
        placed = placed.join(crowded, ["tree", "leaf"], "left").withColumn("n_blk", F.coalesce("n_blk", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("n_blk")).cast("int")
        last = F.when(F.col("visits"), F.col("n_blk") - 1).otherwise(own)
        placed = (placed.withColumn("own", own).withColumn("blk", F.explode(F.sequence(F.lit(0), last)))
                  .withColumn("visits", F.col("visits") | (F.col("blk") < F.col("own"))))
    else:
        placed = placed.withColumn("blk", F.lit(0))
    return (placed.select("tree", "leaf", "blk", "visits", "fp").repartition("tree", "leaf", "blk")
            .sortWithinPartitions("tree", "leaf", "blk", "visits")
            .mapInArrow(partial(_compare, radius=radius), "a long, b long").distinct())


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None, size: int = SHINGLE,
           radius: int = RADIUS) -> DataFrame:
    """``row`` (the given column, else a number), ``doc_id``, ``fp`` (the
    fingerprint as a signed long), ``component_id`` (smallest identifier of the
    group), one row per document."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
                         (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    signed = materialize(narrow.mapInArrow(partial(_fingerprints, size=size), "row long, doc_id long, fp long"))
    classes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = materialize(components(materialize(linked(classes.select("fp"), radius))))
    rooted = classes.join(found.select(F.col("doc_id").alias("fp"), F.col("component_id").alias("root")), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    # classes that stand alone need no second look
    least = rooted.where("root <> fp").groupBy("root").agg(F.min("least").alias("m"))
    roots = rooted.where("root = fp").join(least, "root", "left").select("root", F.least("least", "m").alias("component_id"))
    ids = materialize(rooted.select("fp", "root").join(roots, "root").select("fp", "component_id"))
    return signed.join(ids, "fp").select("row", "doc_id", "fp", "component_id")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group (the smallest identifier), all columns kept.
    Rows of groups without any identifier all stay."""
    from tidemark.llm.common import numbered
    row = clear_name("_row", docs.columns)
    whole = numbered(docs, row)
    found = groups(whole, text, doc_id, row, **options)
    first = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias(row)).select(row)
    keep = first.unionByName(found.where("component_id is null").select(F.col("row").alias(row)))
    return whole.join(keep, row, "left_semi").select(docs.columns)
