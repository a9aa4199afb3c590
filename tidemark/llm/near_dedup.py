"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct shingles of ``size`` words (words end
at ASCII white space, A-Z lower-cased); two documents are linked when
intersection >= ``threshold`` % of union.  A group is a connected component.

1. Where texts are read, each becomes a signature (SuperMinHash: the shingles
   of a document take places by correlated permutations in rounds of rising
   rank; a document stops at the first round that can't lower its signature),
   ``bands`` band keys of ``BAND`` places, its set's size and a digest of its words.
2. Texts of equal words are one class; only its smallest document goes on.
3. In each band bucket every member is paired with the bucket's centres
   (``CENTRES``, smallest under differing orders): pairs grow with the bucket, not
   its square.  Pairs whose signatures agree in too few places for the
   threshold (by five standard deviations) are dropped, the others are verified
   on the full shingle sets.
4. Union-find over verified links by alternating large-star and small-star
   steps.
5. Members of a bucket that are in different components by then may still be
   linked.  Buckets that hold several components are cut into blocks of
   ``SIDE`` members, those of a component that fills one by itself apart from the rest, so that
   its members meet others but not each other; a task compares two blocks by signatures,
   each pair in the first bucket it shares.  Only members with a partner to be verified get their
   shingle sets, in that bucket; tasks compare the blocks again and pass on
   only links that join components.  So no link between texts
   that share a bucket is lost, whatever the centres were, and no pairs are
   written out.

With ``BANDS`` bands a link of similarity 0.85 misses all buckets with
probability below 1e-6; with 36, one of 0.80 does so too.

Defined results: NULL or white-space-only texts have the empty set and stand
alone; links join identifiers, so rows that share one are linked through it;
a row without identifier stays (``kept``) if no row with one has its words,
and links nothing else; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import clear_name, numbered
from tidemark.llm.tokens import blocks, gives_back
from tidemark.session import let_go, materialize

SHINGLE = 3
THRESHOLD = 85
BAND, BANDS = 5, 24
PLACES = BAND * BANDS
CENTRES = 3
SIDE = 128  # members of one block in step 5
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)  # splitmix64
_WORDS = 250_000  # word hashes that a worker keeps
_BLOCK_BYTES = 1 << 20  # of text that a worker takes apart at a time
BATCH_BYTES = 4 << 20  # of what goes to a worker at a time
_ROWS = 2000  # texts, pairs in Python at a time


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingles(held: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit shingle hashes; fewer words make one shingle."""
    if not held:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > _WORDS:
        _HASHES.clear()
    h = np.array([_HASHES[w] for w in held], np.uint64)
    size = min(size, len(h))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        x = _mix(x * STEP + h[k:len(h) - size + 1 + k])
    return np.unique(x)


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures of many sets at once, one row a set.

    In round ``j`` a shingle takes the next place of its own random
    permutation and offers ``j + r``, ``r`` uniform: here the integer ``j`` in
    the upper and ``r`` in the lower 32 bits.  A set is done when its largest
    value is below ``j + 1``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    sig = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = np.tile(np.arange(places, dtype=np.uint8), (len(x), 1))
    for j in range(places):
        if not len(x):
            break
        r = _mix(x + np.uint64((j + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF))
        pick = j + ((r >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        here = np.arange(len(x))
        place = order[here, pick]
        order[here, pick] = order[:, j]
        np.minimum.at(sig.reshape(-1), doc * places + place, (np.uint64(j) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF)))
        done = sig.max(axis=1) < (np.uint64(j + 1) << np.uint64(32))
        stay = ~done[doc]
        if not stay.all():
            x, doc, order = x[stay], doc[stay], order[stay]
    return sig


def _bands(sig: np.ndarray) -> np.ndarray:
    """Band keys, one column a band."""
    bands = sig.shape[1] // BAND
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * BAND, (b + 1) * BAND):
            x = _mix(x * STEP + sig[:, k])
        out[:, b] = x
    return out.view(np.int64)


_SIGNED = "row long, doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"
_PER_TURN = 100_000  # shingles whose permutations are held at a time


@gives_back
def _sign(batches: Iterator[pa.RecordBatch], size: int = SHINGLE, n_bands: int = BANDS) -> Iterator[pa.RecordBatch]:
    places = n_bands * BAND
    for batch in batches:
        for b in blocks(batch, "text", _BLOCK_BYTES):
            held = [words(t) for t in b.column("text").to_pylist()]
            sets = [shingles(w, size) for w in held]
            sig = np.zeros((len(sets), places), np.uint64)
            turn = np.cumsum([len(s) for s in sets]) // _PER_TURN
            for t in np.unique(turn):
                own = np.flatnonzero(turn == t)
                sig[own] = superminhash([sets[k] for k in own], places)
            bands = _bands(sig)
            yield pa.RecordBatch.from_arrays([
                b.column("row"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in held], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * n_bands, pa.int32()), pa.array(bands.ravel())),
                pa.array([s.tobytes() for s in _mix(sig).astype(np.uint8)], pa.binary())],
                ["row", "doc_id", "n_shingles", "digest", "bands", "sig"])


def least_agreement(threshold: int = THRESHOLD, places: int = PLACES) -> int:
    """Places that two linked documents share but for five standard deviations."""
    t = threshold / 100
    return max(1, int(places * (t - 5 * (t * (1 - t) / places) ** 0.5)))


@gives_back
def _agreeing(batches: Iterator[pd.DataFrame], threshold: int, places: int) -> Iterator[pd.DataFrame]:
    """Pairs whose one-byte signatures and set sizes allow a link."""
    for pairs in batches:
        if len(pairs):
            a, b = (np.frombuffer(b"".join(pairs[c]), np.uint8).reshape(-1, places) for c in ("sig_a", "sig_b"))
            n, m = pairs["n_a"].to_numpy(), pairs["n_b"].to_numpy()
            may = (((a == b).sum(axis=1) >= least_agreement(threshold, places))
                   & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)))
            yield pairs.loc[may, ["a", "b"]]


@gives_back
def _linked(batches: Iterator[pa.RecordBatch], size: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Exact: 100 |A and B| >= threshold |A or B| on full sets of shingles."""
    def full(text: bytes) -> set[tuple[bytes, ...]]:
        w = words(text)
        n = min(size, len(w))
        return set(zip(*(w[k:len(w) - n + 1 + k] for k in range(n)))) if w else set()

    held: dict[int, set] = {}  # a centre's set serves many pairs
    for pairs in batches:
        out = []
        for b, text_a, text_b in zip(pairs.column("b").to_pylist(), pairs.column("text_a"), pairs.column("text_b")):
            if b not in held:
                held = {b: full(text_b.as_py())}
            x, y = full(text_a.as_py()), held[b]
            common = len(x & y)
            out.append(100 * common >= threshold * (len(x) + len(y) - common))
        yield pairs.select(["a", "b"]).filter(pa.array(out, pa.bool_()))


_MEMBER = ("rep", "component", "n_shingles", "sig", "bands")


@gives_back
def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch, "text", _BLOCK_BYTES):
            held = [shingles(words(t), size).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held, pa.binary())], ["rep", "held"])


def _side(members: pa.ListScalar, n_bands: int) -> dict[str, np.ndarray | list]:
    m = members.values
    out = {k: m.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("rep", "component", "n_shingles")}
    out["sig"] = np.frombuffer(b"".join(m.field("sig").to_pylist()), np.uint8).reshape(-1, n_bands * BAND)
    out["bands"] = m.field("bands").flatten().to_numpy().reshape(-1, n_bands)
    if m.type.get_field_index("held") >= 0:
        out["held"] = [np.frombuffer(x, np.uint64) for x in m.field("held").to_pylist()]
    return out


def _hits(x: dict, k: int, y: dict, band: int, threshold: int, least: int) -> np.ndarray:
    """Members of ``y`` in another component that member ``k`` of ``x`` may be linked with by
    sizes and signatures, and shares no bucket with before this one."""
    n, m = x["n_shingles"][k], y["n_shingles"]
    same = y["bands"] == x["bands"][k]
    first = x["bands"][k][same.argmax(axis=1)] == band  # pairs are judged in the first bucket they share
    return np.flatnonzero(first & (y["component"] != x["component"][k])
                          & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
                          & ((y["sig"] == x["sig"][k]).sum(axis=1) >= least))


@gives_back
def _may_link(batches: Iterator[pa.RecordBatch], threshold: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    """Two blocks of one bucket, without sets -> the members that have a partner there to be verified."""
    least = least_agreement(threshold, n_bands * BAND)
    for batch in batches:
        bands, reps = [], []
        for r in range(batch.num_rows):
            x, y = (_side(batch.column(c)[r], n_bands) for c in ("m_a", "m_b"))
            band = batch.column("band")[r].as_py()
            found: set[int] = set()
            for k in range(len(x["rep"])):
                hits = _hits(x, k, y, band, threshold, least)
                if len(hits):
                    found.add(int(x["rep"][k]))
                    found.update(y["rep"][hits].tolist())
            reps += found
            bands += [band] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(bands, pa.int64()), pa.array(reps, pa.int64())], ["band", "rep"])


@gives_back
def _blocks_link(batches: Iterator[pa.RecordBatch], threshold: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    """Two blocks of one bucket -> links between different components, one
    for each two components that meet here."""
    least = least_agreement(threshold, n_bands * BAND)
    for batch in batches:
        links: list[tuple[int, int]] = []
        for r in range(batch.num_rows):
            x, y = (_side(batch.column(c)[r], n_bands) for c in ("m_a", "m_b"))
            band = batch.column("band")[r].as_py()
            comp = {c: c for c in (*x["component"].tolist(), *y["component"].tolist())}
            for k in range(len(x["rep"])):
                n, m = x["n_shingles"][k], y["n_shingles"]
                hits = _hits(x, k, y, band, threshold, least)
                for h in hits:
                    one, other = comp[int(x["component"][k])], comp[int(y["component"][h])]
                    if one == other:
                        continue
                    common = len(np.intersect1d(x["held"][k], y["held"][h], assume_unique=True))
                    if 100 * common >= threshold * (int(n) + int(m[h]) - common):
                        links.append((int(x["rep"][k]), int(y["rep"][h])))
                        comp = {c: one if now == other else now for c, now in comp.items()}
        yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in links], pa.int64()),
                                          pa.array([min(p) for p in links], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links ``a, b``: ``doc_id``, ``component_id``
    (the smallest identifier), for every identifier in a link.

    Large-star links every larger neighbour of a node to the smallest of its
    neighbourhood, small-star every smaller one; links become stars in a
    number of rounds that grows with the logarithm of the largest component.
    Minima are aggregated before the exchange; no neighbourhood is gathered.
    Large-star's aggregate also tells which nodes are open, so the end needs no
    exchange of its own; its links are not made distinct, as it has no more than it read."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        near = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") < F.col("a")).alias("below"),
                                     F.count_if(F.col("b") > F.col("a")).alias("above"))
        # done when every link points to a smallest document: nobody has two links, or is pointed to and points on
        wide = materialize(both.join(near, "a").where("b > a or below > 1").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b"), F.expr("b > a").alias("up"),
            F.expr("below > 1 or (below > 0 and above > 0)").alias("open")))
        if not wide.agg(F.max("open")).first()[0]:
            let_go(wide)
            break
        let_go(edges)
        up = wide.where("up").select("a", "b")
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        out = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
        edges = materialize(out.where("a <> b").distinct())
        let_go(wide)
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id")).union(edges.select("b", "b").distinct())


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 8):
    """For jobs whose rows are whole blocks or texts: few of them in Python at a time."""
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Pairs ``a, b`` that are linked; each text travels to its pairs."""
    pairs = materialize(pairs)
    side = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    centre = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    whole = pairs.join(side, "a").join(centre, "b")
    return whole.mapInArrow(partial(_linked, size=size, threshold=threshold), "a long, b long")


def _meetings(members: DataFrame, *columns: str) -> DataFrame:
    """``band``, ``m_a``, ``m_b``: each two blocks of a bucket that hold different components, and
    each block of several components with itself, where it lies; only blocks of a bucket that has
    several are exchanged.  Blocks of one component (``of``) meet those of others alone: the left
    side has them only where a bucket holds several large components."""
    open_ = materialize(members.groupBy("band", "larges", "rest", "of", "blk").agg(F.collect_list(F.struct(*columns)).alias("m")))
    alone = open_.where("of is null").select("band", F.col("m").alias("m_a"), F.col("m").alias("m_b"))
    several = open_.where((F.col("larges") > 0) | (F.col("rest") > SIDE))
    one, other = (several.select("band", "larges", *[F.col(c).alias(f"{c}_{side}") for c in ("of", "blk", "m")]) for side in "ab")
    meet = F.when(F.col("of_a").isNull(), F.col("of_b").isNotNull() | (F.col("blk_a") < F.col("blk_b"))).otherwise(
        F.col("of_a") < F.col("of_b"))
    return alone.unionByName(one.where("of_a is null or larges > 1").drop("larges").join(other.drop("larges"), "band")
                             .where(meet).select("band", "m_a", "m_b"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None, size: int = SHINGLE,
                threshold: int = THRESHOLD, n_bands: int = BANDS) -> DataFrame:
    """``row`` (the given column, else a number), ``doc_id``, ``n_shingles``,
    ``component_id``, ``kept``, one row per document."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
                         (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    with _small_batches(docs.sparkSession, _ROWS):
        signed = materialize(narrow.mapInArrow(partial(_sign, size=size, n_bands=n_bands), _SIGNED))
    narrow = narrow.drop("row")
    # rows of equal words have equal signatures: any of them stands for the class
    classes = materialize(signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")]))
    reps = classes.drop("digest")

    members = reps.select("rep", F.explode("bands").alias("band"))
    orders = [F.min("rep")] + [F.min_by("rep", F.xxhash64(F.lit(k), "rep")) for k in range(1, CENTRES)]
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.array(*orders).alias("centres")).where("n > 1")
    buckets = materialize(buckets)
    members = materialize(members.join(buckets.select("band"), "band", "left_semi"))
    # whole texts of the documents that share a bucket: the only time that texts are exchanged as such
    texts = materialize(narrow.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    pairs = (members.join(buckets, "band").select("rep", F.explode("centres").alias("centre")).where("rep <> centre")
             .select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct())

    def signatures(side: str) -> DataFrame:
        return reps.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("n_shingles").alias(f"n_{side}"))

    pairs = materialize(pairs)
    near = pairs.join(signatures("a"), "a").join(signatures("b"), "b").mapInPandas(
        partial(_agreeing, threshold=threshold, places=n_bands * BAND), "a long, b long")
    with _small_batches(docs.sparkSession, _ROWS):
        links = materialize(_verified(near, texts, size, threshold))
    let_go(pairs)
    found = materialize(components(links))
    let_go(links)

    # step 5: buckets that hold several components
    located = members.join(found, F.col("rep") == F.col("doc_id"), "left").select(
        "band", "rep", F.coalesce("component_id", "rep").alias("component"))
    located = materialize(located)
    let_go(members)
    own = materialize(located.groupBy("band", "component").agg(F.count(F.lit(1)).alias("own")))
    large = F.col("own") >= SIDE
    mixed = own.groupBy("band").agg(
        F.count(F.lit(1)).alias("components"), F.count_if(large).alias("larges"),
        F.sum(F.when(large, 0).otherwise(F.col("own"))).alias("rest")).where("components > 1").drop("components")
    # blocks of one large component, and blocks of what is left of the bucket
    blocks_of_side = F.ceil(F.when(large, F.col("own")).otherwise(F.col("rest")) / SIDE)
    members = materialize(located.join(own.join(mixed, "band"), ["band", "component"]).select(
        "band", "rep", "component", "larges", "rest", F.when(large, F.col("component")).alias("of"),
        F.pmod(F.xxhash64("rep"), blocks_of_side).alias("blk")))
    let_go(located)
    let_go(own)
    may = partial(_may_link, threshold=threshold, n_bands=n_bands)
    link = partial(_blocks_link, threshold=threshold, n_bands=n_bands)
    with _small_batches(docs.sparkSession):
        # by signatures first: a set is wanted in the buckets where its document has a partner, most often one or none
        wanted = materialize(_meetings(members.join(reps, "rep"), *_MEMBER).mapInArrow(may, "band long, rep long").distinct())
        if wanted.take(1):
            held = (texts.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
                    .mapInArrow(partial(_sets, size=size), "rep long, held binary"))
            whole = members.join(wanted, ["band", "rep"], "left_semi").join(reps.join(held, "rep"), "rep")
            more = materialize(_meetings(whole, *_MEMBER, "held").mapInArrow(link, "a long, b long"))
            if more.take(1):  # found groups are stars already
                stars = found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
                found = materialize(components(stars.unionByName(more)))

    # a document's component: its class's, by its smallest document
    by_class = materialize(classes.select("digest", "rep").join(found, F.col("rep") == F.col("doc_id"), "left").select(
        "digest", F.coalesce("component_id", "rep").alias("class_id")))
    out = signed.select("row", "doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    return out.select("row", "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group, all columns kept.  Rows without
    identifier that no identifier's words equal all stay."""
    row = clear_name("_row", docs.columns)
    whole = numbered(docs, row)
    kept = near_groups(whole, text, doc_id, row, **options).where("kept")
    # rows may share an identifier: the first stays
    first = kept.where("component_id is not null").groupBy("component_id").agg(F.min("row").alias(row)).select(row)
    keep = first.unionByName(kept.where("component_id is null").select(F.col("row").alias(row)))
    return whole.join(keep, row, "left_semi").select(docs.columns)
