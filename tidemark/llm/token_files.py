"""Token ids in flat binary files that can be memory-mapped.

A shard is three files in one folder: ``NAME.bin`` (all ids of its documents,
little-endian unsigned 16 or 32 bit, the smaller that holds the vocabulary),
``NAME.idx`` (64-bit offsets: document ``k`` has ids ``idx[k]`` to
``idx[k+1]``) and ``NAME.doc`` (64-bit document ids).  Shards cover ascending
ranges of document ids.  Texts are encoded where they are read; only the ids
(about a third of the text's bytes) are exchanged.  Sampled splitters of the
id column make the ranges, a task sorts its range and writes its shard, and
the shards' sizes are summed up in order to each shard's base: the number of
ids in all shards before it.

Files go to the shared folder: by plain file calls where it is a mounted
folder, else through Arrow's file systems (readers then copy a shard to
scratch before mapping it).  A task writes under a name of its own and renames
at the end, so a task that runs again, or twice at a time, leaves one whole
shard.

Defined results: NULL text is empty and gives the end id only; a NULL
document id comes first and reads back as NULL; rows with equal ids stay, in
the order of their token bytes; an empty table gives no shard and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.tokens import blocks, encoder, vocabulary
from tidemark.session import application_dir, materialize

_NULL_ID = np.iinfo(np.int64).min  # stands for a NULL document id in .doc files
_WRITE_BYTES = 4 << 20


def _split(path: str):
    """Arrow's file system and the path on it."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _encode(path: str, end_id: int, dtype: str, edges: list[int]):
    """Texts -> ids, with the range that the document belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        for batch in batches:
            for b in blocks(batch, "text"):
                ids, offsets = enc.encode(b.column("text"))
                ids = ids.astype(dtype)
                data = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [
                    None, pa.py_buffer((offsets * ids.itemsize).astype(np.int64)), pa.py_buffer(ids)])
                doc_id = b.column("doc_id").fill_null(_NULL_ID).to_numpy()
                part = pa.array(np.searchsorted(edges, doc_id, side="right"), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), part, data.cast(pa.binary())],
                                                 ["doc_id", "part", "ids"])
    return run


def _write(folder: str, dtype: str):
    """Sorted ids of one range -> a shard's files and one row that names them."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _split(folder)
        offsets, ids, part, out, tmp = [0], [], None, None, ""
        for batch in batches:
            for doc_id, p, data in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(),
                                       batch.column("ids")):
                if out is None:
                    part, tmp = p, f"{root}/try-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{tmp}.bin")
                buffer = data.as_buffer()
                out.write(buffer)
                offsets.append(offsets[-1] + buffer.size // width)
                ids.append(_NULL_ID if doc_id is None else doc_id)
        if out is None:
            return
        out.close()
        name = f"shard-{part:06d}"
        for end, values in (("idx", offsets), ("doc", ids)):
            with store.open_output_stream(f"{tmp}.{end}") as f:
                f.write(np.array(values, "<i8"))
        for end in ("bin", "idx", "doc"):
            store.move(f"{tmp}.{end}", f"{root}/{name}.{end}")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([len(ids)], pa.int64()),
            "n_tokens": pa.array([offsets[-1]], pa.int64())})
    return run


def write_token_files(docs: DataFrame, folder: str | None = None, text: str = "text", doc_id: str = "doc_id",
                      vocabulary_path: str | None = None, end_id: int = 1, vocabulary_size: int = 49408,
                      shards: int | None = None) -> DataFrame:
    """Write the shards and return their table: ``folder``, ``name``,
    ``n_docs``, ``n_tokens``, ``base`` (ids before the shard), ``dtype``."""
    spark = docs.sparkSession
    folder = folder or f"{application_dir(spark)}/tokens-{uuid.uuid4().hex}"
    store, root = _split(folder)
    store.create_dir(root, recursive=True)
    dtype = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    # splitters come from the id column alone, so no text is encoded twice
    points = [k / shards for k in range(1, shards)]
    splitters = (narrow.select(F.percentile_approx("doc_id", points, 20 * shards)).first()[0] or []) if points else []
    edges = sorted({int(x) for x in splitters})
    encoded = narrow.mapInArrow(_encode(vocabulary_path or vocabulary(), end_id, dtype, edges),
                                "doc_id long, part int, ids binary")
    ranged = (encoded.repartitionById(len(edges) + 1, F.col("part"))
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids"))
    written = materialize(ranged.mapInArrow(_write(folder, dtype), "part int, name string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return written.select(
        F.lit(folder).alias("folder"), "name", "n_docs", "n_tokens",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"), F.lit(dtype).alias("dtype"))


class Shard:
    """A shard's files, memory-mapped."""

    def __init__(self, folder: str, name: str, dtype: str):
        store, root = _split(folder)
        if store.type_name != "local":
            scratch = tempfile.mkdtemp(prefix="shard-")
            from pyarrow import fs
            for end in ("bin", "idx", "doc"):
                fs.copy_files(f"{root}/{name}.{end}", f"{scratch}/{name}.{end}", source_filesystem=store,
                              destination_filesystem=fs.LocalFileSystem())
            root = scratch
        empty = os.path.getsize(f"{root}/{name}.bin") == 0
        self.ids = np.zeros(0, dtype) if empty else np.memmap(f"{root}/{name}.bin", dtype, "r")
        self.offsets = np.memmap(f"{root}/{name}.idx", "<i8", "r")
        self.doc_ids = np.memmap(f"{root}/{name}.doc", "<i8", "r")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k]:self.offsets[k + 1]]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["folder"], row["name"], row["dtype"])
            for a in range(0, len(shard), 10_000):
                b = min(len(shard), a + 10_000)
                crc = [zlib.crc32(np.ascontiguousarray(shard[k], "<u4")) for k in range(a, b)]
                ids = [None if x == _NULL_ID else x for x in shard.doc_ids[a:b].tolist()]
                starts, sizes = shard.offsets[a:b] + row["base"], np.diff(shard.offsets[a:b + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(shards: DataFrame) -> DataFrame:
    """Every document of the shards, read from the mapped files: ``doc_id``,
    ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``
    (of the ids as little-endian unsigned 32-bit integers).  One task a shard."""
    n = max(1, shards.count())
    return (shards.repartitionById(n, F.monotonically_increasing_id().cast("int") % n)
            .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
