"""Matched-window growth: platform benchmark and per-category share shift.

The two windows are half-open timestamp ranges on the purchase time (not
``EXTRACT(YEAR)`` predicates), so they reach the Parquet scan as pushed
filters.  The platform benchmark is computed, not typed in, and is compared
unrounded; it is attached to the category rows as a scalar subquery (the
per-category aggregate it reads is the same exchange as the main plan's,
which Spark reuses rather than recomputing).

Items have no purchase time, so a window on orders prunes orders only.  With
:func:`write_items_by_month` the items carry their order's purchase month as a
partition; :func:`category_years_by_month` then reads the window's months alone and joins no
orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions import col, half_open, money, ratio, revenue, round_half


def _window(year: int, months: tuple[int, int]) -> tuple[str, str]:
    m0, m1 = months
    end_year, end_month = (year + 1, 1) if m1 == 12 else (year, m1 + 1)
    return f"{year}-{m0:02d}-01 00:00:00", f"{end_year}-{end_month:02d}-01 00:00:00"


def category_years(orders: DataFrame, items: DataFrame, products: DataFrame,
                   year_a: int, year_b: int, months: tuple[int, int] = (1, 8),
                   category: str = "product_category_name",
                   ts: str = "order_purchase_timestamp") -> DataFrame:
    """category, rev_<a>, rev_<b> over the matched months of both years
    (non-NULL categories only)."""
    wa, wb = _window(year_a, months), _window(year_b, months)
    o = (orders.select("order_id", ts)
         .where(half_open(ts, *wa) | half_open(ts, *wb))
         .select("order_id", F.when(half_open(ts, *wa), F.lit(year_a)).otherwise(F.lit(year_b)).alias("_year")))
    sold = items.select("order_id", "product_id", revenue().alias("_rev")).join(o, "order_id")
    return _by_category(sold, products, year_a, year_b, category)


def _by_category(sold: DataFrame, products: DataFrame, year_a: int, year_b: int, category: str) -> DataFrame:
    """``sold``: product_id, _year, _rev."""
    p = products.where(F.col(category).isNotNull()).select("product_id", category)
    zero = F.lit(0).cast("decimal(18,2)")
    years = {y: F.when(F.col("_year") == y, F.col("_rev")).otherwise(zero) for y in (year_a, year_b)}
    sold = sold.groupBy("product_id").agg(*(F.sum(v).alias(f"_rev_{y}") for y, v in years.items()))
    return sold.join(p, "product_id").groupBy(category).agg(
        *(money(F.sum(f"_rev_{y}")).alias(f"rev_{y}") for y in years))


IN_MONTH = "purchase_month"  # yyyy-MM
NO_MONTH = "none"  # items whose order is missing or has no purchase time


def write_items_by_month(orders: DataFrame, items: DataFrame, path: str, ts: str = "order_purchase_timestamp") -> None:
    """Items with their order's purchase month, in a folder a month.

    The months in ``orders`` are replaced, others stay: the items of one month's orders can be
    written again alone.  Rows of a month are dealt over tasks by a hash of the order,
    so a month that holds a third of all items isn't one task; Spark's
    rebalancing joins the small pieces of a month and splits large ones."""
    months = orders.select("order_id", F.date_format(ts, "yyyy-MM").alias(IN_MONTH))
    (items.join(months, "order_id", "left").withColumn(IN_MONTH, F.coalesce(IN_MONTH, F.lit(NO_MONTH)))
     .hint("rebalance", F.col(IN_MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(IN_MONTH).parquet(path))


def read_items_by_month(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``schema``: of the items; the month is added, as text."""
    return spark.read.schema(StructType([*schema.fields, StructField(IN_MONTH, StringType())])).parquet(path)


def category_years_by_month(items: DataFrame, products: DataFrame, year_a: int, year_b: int,
                            months: tuple[int, int] = (1, 8), category: str = "product_category_name") -> DataFrame:
    """:func:`category_years` from items with their purchase month: the months are
    partition values, so those outside both windows are never listed or read."""
    wanted = {y: [f"{y}-{m:02d}" for m in range(months[0], months[1] + 1)] for y in (year_a, year_b)}
    sold = (items.where(F.col(IN_MONTH).isin([m for ms in wanted.values() for m in ms]))
            .select("product_id", revenue().alias("_rev"),
                    F.when(F.col(IN_MONTH).isin(wanted[year_a]), F.lit(year_a)).otherwise(F.lit(year_b)).alias("_year")))
    return _by_category(sold, products, year_a, year_b, category)


def _growth(a, b):
    a, b = col(a), col(b)
    return ratio(b - a, a) * 100


def platform_growth(orders: DataFrame, items: DataFrame, products: DataFrame,
                    year_a: int, year_b: int, months: tuple[int, int] = (1, 8)) -> DataFrame:
    """total_<a>, total_<b>, platform_growth (%)."""
    return growth_of(category_years(orders, items, products, year_a, year_b, months), year_a, year_b)


def growth_of(cy: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """The platform's growth from the categories' revenue of both years."""
    ta, tb = f"total_{year_a}", f"total_{year_b}"
    return (cy.agg(money(F.sum(f"rev_{year_a}")).alias(ta), money(F.sum(f"rev_{year_b}")).alias(tb))
            .withColumn("platform_growth", round_half(_growth(ta, tb), 2)))


def share_shift(orders: DataFrame, items: DataFrame, products: DataFrame,
                year_a: int, year_b: int, months: tuple[int, int] = (1, 8),
                floor: float = 25000) -> DataFrame:
    """Per category above the base-year floor: growth % and whether it beat
    the platform's growth (NULL growth counts as losing share)."""
    return shift_of(category_years(orders, items, products, year_a, year_b, months), year_a, year_b, floor)


def shift_of(cy: DataFrame, year_a: int, year_b: int, floor: float) -> DataFrame:
    """The categories' share shift from their revenue of both years."""
    ra, rb = f"rev_{year_a}", f"rev_{year_b}"
    bench = cy.agg(_growth(F.sum(ra), F.sum(rb)).alias("_bench")).scalar()
    g = _growth(ra, rb)
    return (cy.where(F.col(ra) >= F.lit(floor))
            .select("product_category_name", ra, rb,
                    round_half(g, 2).alias("growth_rate"),
                    F.when(g >= bench, "gaining share").otherwise("losing share").alias("share_trend"))
            .orderBy(F.col("growth_rate").desc_nulls_first(), F.col("product_category_name")))


def share_trend_counts(shift: DataFrame) -> DataFrame:
    return shift.groupBy("share_trend").agg(F.count(F.lit(1)).alias("categories"))
