"""Alignment of two tokenizers' tokens over the same bytes, by merge path.

Vocabulary A is byte-level BPE (``tokenizers`` file), B is sentencepiece BPE
with byte fallback, which puts a space before the text; A reads that space too.
Byte offsets where a token of A and one of B both end cut a text's tokens into
groups.  The last tokens before a cut are linked: their bytes end together.

1. A worker encodes whole texts.  A text's ends in A and in B are two sorted
   lists.  A diagonal ``d`` of their merge is the place where ``d`` ends have been
   passed in both together; a binary search finds it without looking at
   what lies before.  Diagonals every ``WORK`` ends cut the merge into pieces of
   equal work.
2. A text of one piece is merged where it was read.  The pieces of longer texts
   are rows that Spark deals out evenly; each is merged by itself and yields the
   overlaps (common ends) in it.  A group that runs over a piece's border is closed
   by a later piece: the pieces' closing marks, put together in order, give the
   text's groups.  No piece needs another one's result.
3. Links are counted over the corpus.  One of two linked tokens ends with the
   other, so there can't be more different pairs than (token, token that is its
   suffix) exist: :func:`most_pairs` computes that bound from the vocabularies
   (under half a million for the default ones) whatever the corpus.  Counts up
   to that number of pairs are sent to the tasks.

Defined results: texts that are NULL, empty or that A or B don't reproduce byte
by byte (B drops U+2581, say) have no tokens, links or groups; rows that share
an identifier, or have none, each have their row; every row counts in the corpus; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.near_dedup import _small_batches
from tidemark.llm.tokens import _byte_alphabet, blocks, gives_back, vocabulary
from tidemark.session import materialize

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORK = 32_768  # ends of a piece
_BLOCK_BYTES = 1 << 19  # of text that a worker encodes, or of ids that it reads, at a time
_ROWS, _PIECES = 1000, 32  # texts, pieces in Python at a time
_SPACE = "▁"


class Bytewise:
    """Byte-level BPE of a ``tokenizers`` file.  Where ids follow the merges,
    tiktoken runs the same merges three times faster; else the library itself does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        special = {t["id"] for t in held["added_tokens"]}
        back = {c: b for b, c in _byte_alphabet().items()}
        words = {i: w for w, i in held["model"]["vocab"].items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
        self.bytes = [words[i].encode() if i in special else bytes(back[c] for c in words[i]) for i in range(len(words))]
        merges = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        first = len(words) - len(special) - len(merges)
        in_order = all(words.get(first + k) == a + b for k, (a, b) in enumerate(merges))
        plain = held["normalizer"] is None and held["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if in_order and plain:
            import public_tokenizers
            import tiktoken
            ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
            self.encode = tiktoken.Encoding("bytewise", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids


class Pieces:
    """sentencepiece with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(w[3:5], 16)]) if model.is_byte(i) else w.replace(_SPACE, " ").encode() for i, w in enumerate(names)]
        self.encode = partial(model.encode, num_threads=1)


_KEPT: dict[tuple[str, str], tuple[Bytewise, Pieces]] = {}


def vocabularies(a_path: str, b_path: str) -> tuple[Bytewise, Pieces]:
    """One pair per Python worker, kept across tasks."""
    if (a_path, b_path) not in _KEPT:
        _KEPT[a_path, b_path] = Bytewise(a_path), Pieces(b_path)
    return _KEPT[a_path, b_path]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of tokens there are of which one ends with the other."""
    in_a, in_b = Counter(a), Counter(b)
    return (sum(in_a[t[k:]] for t in b for k in range(len(t)))
            + sum(in_b[t[k:]] for t in a for k in range(1, len(t))))


def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """``(i, j)``: piece ``k`` of the merge has ``a[i[k]:i[k+1]]`` and
    ``b[j[k]:j[k+1]]``, about ``work`` entries; equal entries are in one piece."""
    d = np.arange(work, len(a) + len(b), work)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at, left = np.minimum(mid, len(a) - 1), np.clip(d - mid - 1, 0, len(b) - 1)
        first = open_ & (a[at] <= b[left])
        low, high = np.where(first, mid + 1, low), np.where(open_ & ~first, mid, high)
    i, j = low, d - low
    both = (i > 0) & (j < len(b))
    both[both] = a[i[both] - 1] == b[j[both]]
    j = j + both
    return np.concatenate([[0], i, [len(a)]]).astype(np.int64), np.concatenate([[0], j, [len(b)]]).astype(np.int64)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merge of one piece: marks of the entries that both lists have."""
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if len(a) and len(b):
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        in_b = a[at] == b
        in_a[at[in_b]] = True
    return in_a, in_b


_MARKS = ["closes_a", "closes_b"]
_ALIGNED = "row long, doc_id long, a binary, b binary, closes_a binary, closes_b binary"


def _binary(parts: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if p is None else p.tobytes() for p in parts], pa.binary())


@gives_back
def _encode(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, work: int) -> Iterator[pa.RecordBatch]:
    """Ids of both vocabularies (32 bits, little-endian), and closing marks (a bit a token) unless a text has several pieces."""
    one, other = vocabularies(a_path, b_path)
    size_a, size_b = (np.array([len(t) for t in v.bytes], np.int64) for v in (one, other))
    for batch in batches:
        for block in blocks(batch, "text", _BLOCK_BYTES):
            texts = block.column("text").to_pylist()
            in_b = other.encode([t or "" for t in texts])
            out: list[list] = [[], [], [], []]
            for text, b_ids in zip(texts, in_b):
                whole = b" " + (text or "").encode()
                a_ids = one.encode(" " + text) if text and b"".join(map(other.bytes.__getitem__, b_ids)) == whole else []
                if not a_ids or b"".join(map(one.bytes.__getitem__, a_ids)) != whole:
                    a_ids = b_ids = []
                a, b = np.array(a_ids, "<u4"), np.array(b_ids, "<u4")
                marks: tuple = (None, None)
                if len(a) + len(b) <= work:
                    marks = tuple(np.packbits(m, bitorder="little") for m in common_ends(np.cumsum(size_a[a]), np.cumsum(size_b[b])))
                for held, x in zip(out, (a, b, *marks)):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([block.column("row"), block.column("doc_id"), *map(_binary, out)],
                                             ["row", "doc_id", "a", "b", *_MARKS])


@gives_back
def _cut(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, work: int) -> Iterator[pa.RecordBatch]:
    """Texts of several pieces -> one row a piece, with the ends in it."""
    size_a, size_b = (np.array([len(t) for t in v.bytes], np.int64) for v in vocabularies(a_path, b_path))
    for batch in batches:
        for r in range(batch.num_rows):
            a, b = (np.cumsum(size[np.frombuffer(batch.column(c)[r].as_py(), "<u4")]) for c, size in (("a", size_a), ("b", size_b)))
            i, j = merge_path(a, b, work)
            n = len(i) - 1
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column("row")[r].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()),
                _binary([a[x:y] for x, y in zip(i, i[1:])]), _binary([b[x:y] for x, y in zip(j, j[1:])])],
                ["row", "piece", "ends_a", "ends_b"])


@gives_back
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece by itself: a byte for each end, 1 where a group closes."""
    for batch in batches:
        held = [common_ends(*(np.frombuffer(e, np.int64) for e in ends))
                for ends in zip(batch.column("ends_a").to_pylist(), batch.column("ends_b").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("piece"),
                                          *(_binary([h[k] for h in held]) for k in (0, 1))], ["row", "piece", *_MARKS])


@gives_back
def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a text's pieces in order -> marks of the text."""
    for batch in batches:
        whole = [[np.packbits(np.frombuffer(b"".join(p[c] for p in parts), bool), bitorder="little") for c in _MARKS]
                 for parts in batch.column("pieces").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(_binary([w[k] for w in whole]) for k in (0, 1))], ["row", *_MARKS])


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None, a_path: str | None = None,
          b_path: str | None = None, work: int = WORK) -> DataFrame:
    """``row`` (the given column, else a number), ``doc_id``, ``a``, ``b`` (token ids, little-endian 32 bits) and
    ``closes_a``, ``closes_b``: a bit a token (lowest first), 1 for a group's last token."""
    paths = {"a_path": a_path or vocabulary(A_FILE), "b_path": b_path or vocabulary(B_FILE)}
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    with _small_batches(docs.sparkSession, _ROWS):
        encoded = materialize(narrow.mapInArrow(partial(_encode, work=work, **paths), _ALIGNED), compression="zstd")
    # whole texts of several pieces: the table's footers show whether there are any
    long = encoded.where(F.col("closes_a").isNull())
    pieces = long.select("row", "a", "b").mapInArrow(partial(_cut, work=work, **paths),
                                                     "row long, piece long, ends_a binary, ends_b binary")
    merged = pieces.repartition("row", "piece").mapInArrow(_merge, "row long, piece long, closes_a binary, closes_b binary")
    with _small_batches(docs.sparkSession, _PIECES):
        stitched = materialize(merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("piece", *_MARKS))).alias("pieces"))
                               .mapInArrow(_stitch, "row long, closes_a binary, closes_b binary"))
    return encoded.where(F.col("closes_a").isNotNull()).unionByName(long.drop(*_MARKS).join(stitched, "row"))


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of a text, and the places after each group's last token."""
    for a, b, closes_a, closes_b in zip(*(batch.column(c) for c in ("a", "b", *_MARKS))):
        a, b, closes_a, closes_b = (x.as_buffer() for x in (a, b, closes_a, closes_b))
        ids = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
        yield (*ids, *(np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), count=len(i), bitorder="little")) + 1
                       for m, i in zip((closes_a, closes_b), ids)))


def _pairs(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
    return (a[cut_a - 1].astype(np.int64) << 32) | b[cut_b - 1]


@gives_back
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a partition links each pair; no more of them than :func:`most_pairs` are held."""
    pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in (b for batch in batches for b in blocks(batch, "a", _BLOCK_BYTES)):
        new, m = np.unique(np.concatenate([np.zeros(0, np.int64), *(_pairs(*t) for t in _opened(block))]), return_counts=True)
        pairs, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
        n = np.bincount(place, np.concatenate([n, m]), len(pairs)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` (A's id times 2**32 plus B's), ``n`` (links of it in the corpus), ``best`` (no pair of that B id has more)."""
    with _small_batches(aligned.sparkSession, _ROWS):
        n = materialize(aligned.mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return n.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


@gives_back
def _score(batches: Iterator[pa.RecordBatch], counts, n_a: int, n_b: int) -> Iterator[pa.RecordBatch]:
    pairs, n, best = counts.value
    names = [str(i).encode() for i in range(max(n_a, n_b))]
    table = [w + end for w in names for end in (b",", b"|", b";")]
    for block in (b for batch in batches for b in blocks(batch, "a", _BLOCK_BYTES)):
        out: list[tuple] = []
        for a, b, cut_a, cut_b in _opened(block):
            at = np.searchsorted(pairs, _pairs(a, b, cut_a, cut_b))
            # each token's place in the listing: A's tokens of a group come before B's
            groups_a = np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=0))
            groups_b = np.repeat(np.arange(len(cut_b)), np.diff(cut_b, prepend=0))
            listed = np.zeros(len(a) + len(b), np.int64)
            code_a, code_b = a.astype(np.int64) * 3, b.astype(np.int64) * 3
            code_a[cut_a - 1] += 1
            code_b[cut_b - 1] += 2
            before = np.concatenate([[0], cut_b])
            listed[np.arange(len(a)) + before[groups_a]] = code_a
            listed[np.arange(len(b)) + cut_a[groups_b]] = code_b
            text = b"".join(map(table.__getitem__, listed.tolist()))[:-1]
            out.append((len(a), len(b), len(cut_a), len(at), int(best[at].sum()), int(n[at].sum()), text))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([block.column("row"), block.column("doc_id"),
                                          *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))],
                                         ["row", "doc_id", *_SCORES])


_SCORES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def scored(aligned: DataFrame, counts: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``row``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links that no other of their B id outnumbers in
    the corpus), ``count_sum`` (corpus counts over the links), ``groups`` (binary: ``a1,a2|b1;a3|b2,b3``, ids by group)."""
    one, other = vocabularies(a_path or vocabulary(A_FILE), b_path or vocabulary(B_FILE))
    counts, bound = materialize(counts), most_pairs(one.bytes, other.bytes)
    if (n := counts.count()) > bound:
        raise ValueError(f"{n} pairs, but {bound} can be linked: these counts are of other vocabularies")
    held = counts.toArrow()
    order = np.argsort(held["pair"].to_numpy())
    sent = counts.sparkSession.sparkContext.broadcast(tuple(c.to_numpy()[order] for c in held.columns))
    return aligned.mapInArrow(partial(_score, counts=sent, n_a=len(one.bytes), n_b=len(other.bytes)),
                              "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                              "count_sum long, groups binary")
