"""Where two versions of a table differ, by additive digests of key ranges.

A table's digest is, for each range of keys, its number of rows and the sum of a
64-bit hash of every row.  Sums don't depend on the order of rows or on how
they are partitioned, they come from one aggregate with map-side partial sums, and
digests of disjoint parts add up, so they can be kept with the parts.  Two
versions of a table are compared by their digests first, a few rows; only
the ranges that differ are then read again and compared row by row.

Rows with equal values in all compared columns are equal; NULL equals NULL, and a
NULL differs from every value.  Repeated rows count: a range with a row twice
differs from one with it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM = "decimal(38,0)"  # of 64-bit hashes: no overflow below 10^19 rows


def row_hash(columns: list[str], seed: int = 0) -> Column:
    """64-bit hash of a row.  The hash function passes over NULLs, so each value
    goes in with a flag that says whether it's there."""
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def range_digests(df: DataFrame, in_range: Column, columns: list[str] | None = None) -> DataFrame:
    """``range``, ``n``, ``digest``: one row for each value of ``in_range`` (a range
    of keys or times, or a bucket of hashed keys)."""
    return (df.select(in_range.alias("range"), row_hash(columns or df.columns).alias("_h"))
            .groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast(SUM)).alias("digest")))


def compare_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """``range``, ``n_a``, ``n_b``, ``same`` from the digests of two versions."""
    a = a.select(F.col("range").alias("ra"), F.col("n").alias("n_a"), F.col("digest").alias("da"))
    b = b.select(F.col("range").alias("rb"), F.col("n").alias("n_b"), F.col("digest").alias("db"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, F.col("ra").eqNullSafe(F.col("rb")), "full_outer").select(
        F.coalesce("ra", "rb").alias("range"), F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b"),
        (F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("da").eqNullSafe(F.col("db"))).alias("same"))


def changed_rows(a: DataFrame, b: DataFrame, key: str, in_range: Column, columns: list[str] | None = None) -> DataFrame:
    """``key``, ``change`` for every key whose rows differ: ``removed`` (only in
    ``a``), ``added`` (only in ``b``), ``changed``.

    Both tables need the columns compared, of the same types.  Rows of ranges with equal
    digests are dropped by a semi join with the few ranges that differ, before
    anything is exchanged by key."""
    columns = columns or a.columns
    open_ranges = (compare_ranges(range_digests(a, in_range, columns), range_digests(b, in_range, columns))
                   .where(~F.col("same")).select(F.col("range").alias("_range")))

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(key), in_range.alias("_at"), row_hash(columns).cast(SUM).alias("_h"))
        return (rows.join(open_ranges, F.col("_at").eqNullSafe(F.col("_range")), "left_semi")
                .select(key, *(F.when(F.lit(name == s), F.lit(1)).otherwise(0).alias(f"_{s}") for s in "ab"),
                        F.when(F.lit(name == "a"), F.col("_h")).otherwise(-F.col("_h")).alias("_h")))

    # equal versions of a key cancel out: as many rows and the same sum of hashes on both sides
    both = side(a, "a").unionByName(side(b, "b")).groupBy(key).agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum("_h").alias("_h"))
    return (both.where((F.col("_a") != F.col("_b")) | (F.col("_h") != 0))
            .select(key, F.when(F.col("_b") == 0, "removed").when(F.col("_a") == 0, "added").otherwise("changed").alias("change")))
