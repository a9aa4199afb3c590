"""Helpers that several operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def whole_text(text: str = "text") -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z only, whatever the locale or script."""
    return F.translate(c, UPPER, LOWER)


def word_array(c: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def clear_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, or with underscores added until no column has that name
    (names compare without case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def numbered(df: DataFrame, row: str) -> DataFrame:
    """``df`` written once in the shared folder with a unique long ``row``.

    Rows equal in all columns stay distinct, and since the number is stored,
    every later job sees the same one, also after executors were lost.
    """
    return materialize(df.withColumn(row, F.monotonically_increasing_id()))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def hex_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
