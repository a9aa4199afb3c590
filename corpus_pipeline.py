"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  The tables
that a stage writes on the way are removed when the next stage begins, so the
disk holds those of one stage at a time; a stage's result must have been
written by then.  Runs don't share tables.

NULL and empty texts are documents without words: the quality rules reject them.
Rows that share an identifier are documents of their own until a stage drops one;
other columns travel along; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import content_sort, line_quality, mixing, near_dedup, packing
from tidemark.session import let_go, materialize, release_between, written

#: Stages on word shingles take five words and 0.8; a link of 0.80 misses all 36 bands with probability below 1e-6.
NEAR = {"size": 5, "threshold": 80, "n_bands": 36}

#: Tables of stages called one by one, by application, thread and stage.
_OPEN: dict[tuple[str, int, str], list[tuple[int, int]]] = {}


def staged(before: str | None) -> Callable:
    """A stage that, called by itself, removes the tables which the stage
    ``before`` it wrote on the way in this thread: its input was written by then."""
    def wrap(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            own = spark.sparkContext.applicationId, threading.get_ident()
            for span in _OPEN.pop((*own, before), []):
                release_between(spark, *span)
            first = written()
            out = stage(spark, docs, sf_dir)
            _OPEN.setdefault((*own, stage.__name__), []).append((first, written()))
            return out
        return run_stage
    return wrap


@staged(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return line_quality.clean(docs)


@staged("quality")
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the largest identifier."""
    return content_sort.dedup(docs)


@staged("exact")
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (``NEAR``) stays, the smallest
    identifier."""
    return near_dedup.dedup(docs, **NEAR)


@staged("near")
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


@staged("mix")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and its place there."""
    return packing.pack(packing.cut(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("MinHash near-dedup", near),
          ("mixing sources", mix), ("best-fit packing", pack)]

#: Signatures, random draws and the genetic algorithm have no SQL; the stages
#: are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  A run owns its tables: what a stage wrote on the way goes as
    soon as its result is written, that result when the next one is.  The last
    stage's tables stay for the frame that is returned."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        first = written()
        out = stage.__wrapped__(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            last = written()
            out = materialize(out)
            release_between(spark, first, last)
            if k:
                let_go(docs)
        docs = out
    return docs
