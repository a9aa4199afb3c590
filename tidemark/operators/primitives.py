"""Shared building blocks: first-event pick, exact distributed rank / running
sum / n-tile, share of a total.

Global windows (``ORDER BY`` with no ``PARTITION BY``) make Spark move every
row into one task.  That is harmless on a monthly series or ten deciles but
not over sellers or persons, so entity-level rankings go through
:func:`rank_desc`, which is exact and keeps the sort spread over many tasks:

1. the input is written once as a table in the shared checkpoint folder (it
   feeds a count, a range sample and the plan);
2. ``repartitionByRange(B, value desc nulls last, key asc nulls last)`` —
   Spark's range partitioner samples the composite sort key and routes each
   row by binary search in the JVM, so bucket ``spark_partition_id()`` holds
   a contiguous slice of the global order.  The key is part of the sort key,
   so one dominant value is split across buckets by key;
3. that bucketed table is written once more, so the bucket of every row is
   fixed for everything that follows (a new range sample in a later job
   could draw different bounds);
4. ``row_number`` / running sum run per bucket (``Window.partitionBy``) —
   or, when only ranks are needed, the position inside the sorted range
   partition — and a ≤B-row table of bucket counts and sums turns them into
   global ranks with exclusive prefix sums; that table is broadcast up to
   ``BROADCAST_BUCKETS`` rows.

The bucket bounds only affect balance, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.selection import ntile_by_cuts
from tidemark.session import materialize

RANK = "_rank"
RUNNING = "_running"
BUCKET = "_bucket"

DEFAULT_ROWS_PER_BUCKET = 2_000_000
BROADCAST_BUCKETS = 100_000  # a bucket's row has 5 numbers; more buckets are joined without a hint
ROWS_PER_BUCKET_CONF = "tidemark.rank.rows_per_bucket"  # session setting overriding the default


def first_event(df: DataFrame, key: str | list[str], order_by: list[Column],
                where: Column | None = None) -> DataFrame:
    """One row per ``key``: the first by ``order_by`` (which must end in a
    unique column so ties are broken the same way every run).

    ``row_number() == 1`` lets Spark insert a partial ``WindowGroupLimit``
    before the shuffle, so a key holding a large share of all rows sends at
    most one row per map task across the network.
    """
    if where is not None:
        df = df.where(where)
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def _session_int(df: DataFrame, conf: str, default: int) -> int:
    return int(df.sparkSession.conf.get(conf, str(default)))


def rank_desc(df: DataFrame, value: str, key: str, *,
              rows_per_bucket: int | None = None,
              checkpoint: bool = True, running: bool = True) -> tuple[DataFrame, int]:
    """Exact global rank and running sum by ``value`` desc, ``key`` asc.

    ``key`` must be unique in ``df``.  Adds ``_rank`` (1..N, bigint) and,
    with ``running``, ``_running`` (running sum of ``value`` in rank order)
    and the grand total ``_total``.  Returns the frame and N.
    ``rows_per_bucket`` defaults to the session setting
    ``tidemark.rank.rows_per_bucket`` (else 2,000,000).

    Without ``running`` (n-tiles need ranks only) the in-bucket position is
    taken right after the range shuffle: each range partition is sorted and
    ``monotonically_increasing_id()`` (partition id in the high bits, row
    position in the low 33) gives the row's place, so no window and no
    second shuffle are needed.
    """
    if rows_per_bucket is None:
        rows_per_bucket = _session_int(df, ROWS_PER_BUCKET_CONF, DEFAULT_ROWS_PER_BUCKET)
    base = materialize(df) if checkpoint else df
    n = base.count()
    # one plan at every size: at least as many buckets as the session's shuffles have partitions
    n_buckets = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / max(1, rows_per_bucket)))
    small = F.broadcast if n_buckets <= BROADCAST_BUCKETS else (lambda df: df)
    order = [F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last()]

    ranged = base.repartitionByRange(n_buckets, *order)
    if not running:
        pid = F.spark_partition_id()
        bucketed = materialize(ranged.sortWithinPartitions(*order).select(
            "*", pid.alias(BUCKET),
            (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33) + 1).alias("_local_rank")))
        stats = bucketed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_cnt"))
        stats = stats.select(BUCKET, F.coalesce(F.sum("_cnt").over(
            Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_rank_offset"))
        out = (bucketed.join(small(stats), BUCKET)
               .withColumn(RANK, (F.col("_rank_offset") + F.col("_local_rank")).cast("bigint"))
               .drop("_local_rank", "_rank_offset", BUCKET))
        return out, n

    bucketed = materialize(ranged.withColumn(BUCKET, F.spark_partition_id()))

    w = Window.partitionBy(BUCKET).orderBy(*order)
    local = (bucketed
             .withColumn("_local_rank", F.row_number().over(w))
             .withColumn("_local_running",
                         F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))

    stats = bucketed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_cnt"), F.sum(value).alias("_sum"))
    ws = Window.orderBy(BUCKET)  # a row a bucket
    prev = ws.rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select(
        BUCKET,
        F.coalesce(F.sum("_cnt").over(prev), F.lit(0)).alias("_rank_offset"),
        F.sum("_sum").over(prev).alias("_sum_offset"),
        F.sum("_sum").over(Window.partitionBy()).alias("_total"),
    )
    out = (local.join(small(stats), BUCKET)
           .withColumn(RANK, (F.col("_rank_offset") + F.col("_local_rank")).cast("bigint"))
           .withColumn(RUNNING, F.when(F.col("_sum_offset").isNull(), F.col("_local_running"))
                       .otherwise(F.col("_sum_offset") + F.coalesce(F.col("_local_running"), F.lit(0))))
           .drop("_local_rank", "_local_running", "_rank_offset", "_sum_offset", BUCKET))
    return out, n


def ntile_of_rank(rank: str | Column, n: int, k: int) -> Column:
    """NTILE(k) from a 1-based global rank over n rows: the first n mod k
    tiles get one extra row."""
    r = F.col(rank) if isinstance(rank, str) else rank
    q, rem = divmod(n, k)
    big = rem * (q + 1)
    first = F.floor((r - 1) / F.lit(q + 1)) + 1
    if q == 0:
        return first.cast("bigint")
    rest = F.lit(rem) + F.floor((r - 1 - F.lit(big)) / F.lit(q)) + 1
    return F.when(r <= F.lit(big), first).otherwise(rest).cast("bigint")


MOST_CUTS = 64  # tiles that are told apart by comparing with their last rows


def ntile_desc(df: DataFrame, value: str, key: str, k: int, alias: str = "tile",
               sample: int | None = None, **kw) -> DataFrame:
    """Exact distributed ``NTILE(k) OVER (ORDER BY value DESC, key)``.

    Up to ``MOST_CUTS`` tiles come from the rows that end them
    (:mod:`tidemark.operators.selection`): no sort, no table.  For more of
    them every row is ranked."""
    if k <= MOST_CUTS:
        return ntile_by_cuts(df, value, key, k, alias, sample)
    ranked, n = rank_desc(df, value, key, running=False, **kw)
    if n == 0:
        return df.withColumn(alias, F.lit(None).cast("bigint"))
    drop = [c for c in (RANK, RUNNING, "_total") if c in ranked.columns]
    return ranked.withColumn(alias, ntile_of_rank(RANK, n, k)).drop(*drop)


def share_over_all(x: str | Column) -> Column:
    """``SUM(x) OVER ()`` — only for small, already-aggregated frames
    (tiles, flags, months): it gathers the frame into one task."""
    c = F.col(x) if isinstance(x, str) else x
    return F.sum(c).over(Window.partitionBy())
