"""Token ids of whole texts with a ``tokenizers`` vocabulary file.

The vocabulary drops white space and its BPE works on one pre-token at a
time, so a text's ids are the ids of its white-space separated words, one
after the other.  A letter next to ASCII punctuation (but the apostrophe)
always ends a pre-token, so a space put there changes nothing and makes words
repeat more.  Arrow lower-cases, splits and finds the distinct words of a
block; only words that this worker hasn't met go to the library.  Its table
is emptied at ``CACHE_WORDS`` entries, blocks hold ``BLOCK_BYTES`` of text or
one document, so memory stays bounded.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 400_000
BLOCK_BYTES = 2 << 20
_LETTERS = "a-zà-öø-įı-ɏÀ-ÖØ-ÞĀ"
_BORDER = f"([{_LETTERS}])([!-&(-/:;=?@\\[-`{{}}~])"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: Latin-1's printable
    characters stand for themselves, the others for U+0100 onwards in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes blocks of texts; ``end_id`` is appended to each text."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.known: dict[str, bytes] = {}  # little-endian 32-bit ids
        self.alphabet = _byte_alphabet()

    def _word(self, word: str) -> list[int]:
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:  # NFC and lower-casing go letter by letter
            if not word.isascii():
                word = word.lower().encode().decode("latin-1").translate(self.alphabet)
            return [t.id for t in self.tokenizer.model.tokenize(word)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known, out = self.known, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = np.array(self._word(w), "<u4").tobytes()
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: document ``k`` has ``ids[offsets[k]:offsets[k+1]]``."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = pc.match_substring(texts, "<|")  # these strings may be special tokens: as the library has them
        plain = pc.if_else(special, "", texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), _BORDER, "\\1 \\2"))
        units = lists.flatten().dictionary_encode()
        flat, counts = self._words(units.dictionary.to_numpy(zero_copy_only=False))
        starts = np.cumsum(counts) - counts
        index = units.indices.to_numpy(zero_copy_only=False)
        n = counts[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[index] - ends[:-1], n)]
        ends = ends[pc.subtract(lists.offsets, lists.offsets[0]).to_numpy()]
        docs = np.split(ids, ends[1:-1]) if len(texts) else []
        for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
            docs[k] = np.array(self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        tail = np.array([self.end_id], np.uint32)
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        flat = np.concatenate([x for d in docs for x in (d, tail)]) if docs else np.zeros(0, np.uint32)
        return flat.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per Python worker, kept across tasks."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, end_id)
    return _ENCODERS[key]


def gives_back(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A worker's function that at a task's end returns freed memory to the system:
    workers wait for later tasks beside those of other stages, and what they keep adds up."""
    @wraps(run)
    def task(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)
    return task


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
