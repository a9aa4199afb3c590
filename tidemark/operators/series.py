"""Monthly revenue series: growth, moving average, running total, masking
and trimming.

Items are summed per order *before* the join to orders, so the join and
the monthly shuffle move one row per order instead of one per item.  The
windows that follow (``LAG``, moving average, running total) run on the
monthly series — a few hundred rows — where a single-task window is right.
Windows are ROWS frames: a month with no orders is skipped, unless the series
is asked for on a dense calendar (:func:`dense_months`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import half_open, money, month_of, ratio, round_half
from tidemark.operators.customers import order_revenue

MONTH = "month"


def monthly_revenue(orders: DataFrame, items: DataFrame,
                    ts: str = "order_purchase_timestamp",
                    window: tuple[str, str] | None = None) -> DataFrame:
    """month, monthly_volume (distinct orders with items), revenue."""
    o = orders.select("order_id", ts)
    if window is not None:
        o = o.where(half_open(ts, *window))
    per_order = order_revenue(items, "_rev")
    return (o.join(per_order, "order_id")
            .groupBy(month_of(ts).alias(MONTH))
            .agg(F.countDistinct("order_id").alias("monthly_volume"),
                 money(F.sum("_rev")).alias("revenue")))


def _trimmed(series: DataFrame, trim: tuple[str, str, str] | None, stage: str) -> DataFrame:
    if trim is None or trim[2] != stage:
        return series
    return series.where(half_open(MONTH, trim[0], trim[1]))


def dense_months(series: DataFrame, zeros: list[str], by: list[str] | None = None,
                 month: str = MONTH) -> DataFrame:
    """``series`` with a row for every month from its first to its last.

    A missing month has 0 in the columns ``zeros`` and NULL in all others.  With
    ``by``, each combination of those columns has its own first and last month
    (NULLs are a combination like any other).  The months are generated from
    the bounds, so no calendar table and no cross join is needed; a series
    without rows, or a NULL month, adds none.  There must be one row a month and
    combination.
    """
    by = by or []
    first, last = F.min(month).cast("date"), F.max(month).cast("date")
    spine = (series.groupBy(*by).agg(F.sequence(first, last, F.expr("INTERVAL 1 MONTH")).alias("_months"))
             .select(*by, F.explode("_months").alias(month))
             .withColumn(month, F.col(month).cast(series.schema[month].dataType)))
    on = F.lit(True)
    for c in [*by, month]:
        on = on & F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}"))
    joined = spine.alias("s").join(series.alias("d"), on, "left")
    return joined.select(*(
        F.col(f"s.{c}").alias(c) if c in by or c == month
        else F.coalesce(F.col(f"d.{c}"), F.lit(0).cast(series.schema[c].dataType)).alias(c) if c in zeros
        else F.col(f"d.{c}").alias(c) for c in series.columns))


def _series(orders, items, trim, dense=False):
    window = (trim[0], trim[1]) if trim is not None and trim[2] == "before" else None
    s = monthly_revenue(orders, items, window=window)
    return dense_months(s, ["monthly_volume", "revenue"]) if dense else s


ROWS_PER_TASK = 500_000  # items that one task of idle_months joins


def idle_months(orders: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """``by``, first_month, last_month, months, idle_months, longest_idle: for how
    many months, and for how many in a row, a seller, product, … sold nothing
    between its first and last sale.

    The months with sales are bits of 64-month words, aggregated before the
    exchange; a group's few words then tell its gaps, so no month without sales
    is ever a row.  The join has as many tasks as the items need: a task's memory
    doesn't grow with the input.
    """
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(items.count() / ROWS_PER_TASK))
    month = month_of("order_purchase_timestamp")
    sold = items.select("order_id", by).repartition(parts, "order_id").join(
        orders.select("order_id", ((F.year(month) - 1970) * 12 + F.month(month) - 1).alias("_m")).repartition(parts, "order_id"),
        "order_id").where("_m is not null")
    words = sold.groupBy(by, F.shiftright("_m", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, _m & 63))").alias("_bits"))
    held = words.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_words"))
    sales = held.select(by, F.flatten(F.transform("_words", lambda w: F.filter(
        F.sequence(w["_word"] * 64, w["_word"] * 64 + 63),
        lambda m: F.getbit(w["_bits"], m.bitwiseAND(63)) == 1))).alias("_months"))
    gaps = F.transform("_months", lambda m, k: F.coalesce(m - F.get("_months", k - 1) - 1, F.lit(0)))
    ends = sales.select(by, F.get("_months", F.lit(0)).alias("_first"), F.element_at("_months", -1).alias("_last"),
                        F.size("_months").alias("_sold"), F.array_max(gaps).cast("bigint").alias("longest_idle"))
    epoch = F.lit("1970-01-01").cast("date")
    months = (F.col("_last") - F.col("_first") + 1).cast("bigint")
    return ends.select(
        by, *(F.add_months(epoch, c).cast("timestamp_ntz").alias(name) for c, name in (("_first", "first_month"), ("_last", "last_month"))),
        months.alias("months"), (months - F.col("_sold")).alias("idle_months"), "longest_idle")


def monthly_growth(orders: DataFrame, items: DataFrame,
                   trim: tuple[str, str, str] | None = None, dense: bool = False) -> DataFrame:
    """month, monthly_volume, revenue, previous_month_revenue, mom_growth_pct.

    ``trim=(start, end, "before"|"after")`` restricts to ``[start, end)``
    either before the window functions run (orders outside are never read
    past the scan) or after (LAG still sees the dropped neighbours).  On a
    ``dense`` calendar a month without orders has revenue 0, and growth from
    it is NULL.
    """
    s = _series(orders, items, trim, dense)
    w = Window.orderBy(MONTH)
    out = (s.withColumn("previous_month_revenue", F.lag("revenue").over(w))
            .withColumn("mom_growth_pct",
                        round_half((ratio("revenue", "previous_month_revenue") - 1) * 100, 2)))
    return _trimmed(out, trim, "after").select(
        MONTH, "monthly_volume", "revenue", "previous_month_revenue", "mom_growth_pct").orderBy(MONTH)


def moving_average(orders: DataFrame, items: DataFrame, k: int = 3,
                   trim: tuple[str, str, str] | None = None, dense: bool = False) -> DataFrame:
    """month, revenue, mean over the current and previous k−1 months
    (the first k−1 rows average over the rows that exist)."""
    s = _series(orders, items, trim, dense)
    frame = Window.orderBy(MONTH).rowsBetween(-(k - 1), Window.currentRow)
    out = s.withColumn(f"revenue_{k}month_moving_avg",
                       F.sum("revenue").over(frame).cast("double") / F.count("revenue").over(frame))
    return _trimmed(out, trim, "after").select(MONTH, "revenue", f"revenue_{k}month_moving_avg").orderBy(MONTH)


def running_total(orders: DataFrame, items: DataFrame,
                  trim: tuple[str, str, str] | None = None, dense: bool = False) -> DataFrame:
    """month, revenue, cumulative revenue."""
    s = _series(orders, items, trim, dense)
    frame = Window.orderBy(MONTH).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = s.withColumn("running_total_revenue", money(F.sum("revenue").over(frame)))
    return _trimmed(out, trim, "after").select(MONTH, "revenue", "running_total_revenue").orderBy(MONTH)


def small_base_flag(growth: DataFrame, floor: float) -> DataFrame:
    """Mask month-over-month growth computed on a base below ``floor``."""
    small = F.col("previous_month_revenue").isNotNull() & (F.col("previous_month_revenue") < F.lit(floor))
    return (growth.withColumn("small_base", small)
            .withColumn("mom_growth_pct", F.when(~small, F.col("mom_growth_pct"))))


def trim_window(df: DataFrame, start: str, end: str, month_col: str = MONTH) -> DataFrame:
    """Keep rows with ``start <= month < end``."""
    return df.where(half_open(month_col, start, end))
