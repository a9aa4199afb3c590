"""Exact duplicate removal by content sort.

Normalised whole texts (A-Z lower-cased, NULL as empty) are range-partitioned
by sampled splitters and sorted, so equal texts lie next to each other.
Splitters hold the first bytes and the text's SHA-256 in place of the rest, so
the sample that the driver sees stays small whatever the texts' lengths.  The
key goes on with the identifier (descending), so splitters also fall inside a
group of copies: a text that a third of all rows share spreads over many
tasks.  Each task walks its sorted rows once, compares each text in full
with the one before and writes down, without the text, the run a row belongs
to.  Runs cut by a partition's edge (two a partition at most) are joined by
the SHA-256 of their whole text.

Defined results: NULL and empty text are equal; a NULL identifier sorts below
all others; rows equal in text and identifier are one group of which one row
stays; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clear_name, lower_ascii, numbered, whole_text
from tidemark.llm.near_dedup import _ROWS, _small_batches
from tidemark.llm.tokens import gives_back
from tidemark.session import materialize

SPLITTER_BYTES = 32
_RUNS = ("row long, doc_id long, part int, run long, first boolean, head_id long, sha string")


@gives_back
def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition -> their runs.  ``head_id`` is the
    identifier of the run's first row, the largest."""
    previous = head = None
    run = -1
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        runs, firsts, heads = [], [], []
        for text, doc_id in zip(batch.column("text"), ids):
            data = text.as_buffer()
            new = previous is None or not data.equals(previous)
            if new:
                run, head, previous = run + 1, doc_id, data
            runs.append(run)
            firsts.append(new)
            heads.append(head)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("part"), pa.array(runs, pa.int64()), pa.array(firsts, pa.bool_()),
             pa.array(heads, pa.int64()), batch.column("sha")],
            schema=_SCHEMA)


_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()),
                     ("first", pa.bool_()), ("head_id", pa.int64()), ("sha", pa.string())])


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the given column, else a number),
    ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    Of equal texts the row with the largest identifier stays, one row only."""
    spark = docs.sparkSession
    norm = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).cast("long").alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"), lower_ascii(whole_text(text)).cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = norm.select("*", F.sha2("text", 256).alias("sha"), F.substring("text", 1, SPLITTER_BYTES).alias("head"))
    largest_first = F.col("doc_id").desc_nulls_last()
    ranged = (norm.repartitionByRange(parts, "head", "sha", largest_first)
              .withColumn("part", F.spark_partition_id())
              .sortWithinPartitions("head", "sha", "text", largest_first).drop("head"))
    with _small_batches(spark, _ROWS):
        runs = materialize(ranged.mapInArrow(_walk, _RUNS))

    # a run's length, its largest identifier and its first row's number
    per_run = runs.groupBy("part", "run").agg(
        F.count(F.lit(1)).alias("n"), F.first("sha").alias("sha"), F.max("head_id").alias("head_id"))
    last = runs.groupBy("part").agg(F.max("run").alias("last_run"))
    at_edge = (per_run.join(last, "part").where((F.col("run") == 0) | (F.col("run") == F.col("last_run")))
               .select("part", "run", "n", "sha", "head_id"))
    joined = at_edge.groupBy("sha").agg(
        F.sum("n").alias("all_n"), F.max("head_id").alias("all_head"), F.min("part").alias("first_part"))
    edges = materialize(at_edge.join(joined, "sha").select(
        "part", "run", "all_n", "all_head", (F.col("part") == F.col("first_part")).alias("leads")))
    inner = materialize(per_run.select("part", "run", "n").where("n > 1"))
    out = (runs.join(inner, ["part", "run"], "left").join(edges, ["part", "run"], "left"))
    return out.select(
        "row", "doc_id", F.when(F.col("all_n").isNotNull(), F.col("all_head")).otherwise(F.col("head_id")).alias("keep_id"),
        F.coalesce("all_n", "n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first") & F.coalesce("leads", F.lit(True))).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the copies, all columns kept."""
    row = clear_name("_row", docs.columns)
    whole = numbered(docs, row)
    keep = copies(whole, text, doc_id, row).where("kept").select(F.col("row").alias(row))
    return whole.join(keep, row, "left_semi").drop(row).select(docs.columns)
