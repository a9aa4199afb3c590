"""Distinct counts that can be kept and merged: theta sketches a month.

An exact distinct count must see all ids again whenever a month is added.  A
sketch of each month's ids is a few kilobytes, whatever the month holds; sketches
merge into those of any set of months, and differ from each other, without the
ids.  Exact counts stand beside them (``quality.staged_counts``); these are for
repeated questions over a growing table.

With ``2^lg`` kept hashes the relative standard error is ``1 / sqrt(2^lg - 2)``, and up to
``2^lg`` distinct ids the count is exact.  The error of a difference is relative to the
larger set, not to the difference.  NULL ids aren't counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import month_of

LG = 14  # 16,384 hashes: 0.8 % standard error, at most 128 KB a sketch


def error(lg: int = LG) -> float:
    """Relative standard error of an estimate."""
    return (2 ** lg - 2) ** -0.5


def monthly_sketches(customers: DataFrame, orders: DataFrame, items: DataFrame, lg: int = LG,
                     person: str = "customer_unique_id") -> DataFrame:
    """month, persons, persons_with_items, orders, orders_with_items: a sketch of
    each, from one flagged join.  Partial sketches are built where rows lie; what is
    exchanged for the last aggregate is sketches."""
    with_items = items.select("order_id").distinct().withColumn("_has", F.lit(True))
    reach = (customers.select("customer_id", person)
             .join(orders.select("order_id", "customer_id", month_of("order_purchase_timestamp").alias("month")), "customer_id")
             .join(with_items, "order_id", "left"))
    has = F.col("_has").isNotNull()
    return reach.groupBy("month").agg(*(
        F.theta_sketch_agg(F.when(keep, F.col(c)) if keep is not None else F.col(c), lg).alias(name)
        for name, c, keep in (("persons", person, None), ("persons_with_items", person, has),
                              ("orders", "order_id", None), ("orders_with_items", "order_id", has))))


def merged(sketches: DataFrame, lg: int = LG, by: list[str] | None = None) -> DataFrame:
    """The sketches of all months as one, or one for each value of ``by``."""
    by = by or []
    return sketches.groupBy(*by).agg(*(
        F.theta_union_agg(c, lg).alias(c) for c in sketches.columns if c not in by and c != "month"))


def size(sketch: str | Column) -> Column:
    """How many distinct ids a sketch stands for."""
    return F.theta_sketch_estimate(sketch)


def staged(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """stage, persons, orders as ``quality.staged_counts``, estimated; the gap is
    the size of the sketches' set difference."""
    total = merged(sketches, lg)
    rows = F.array(
        F.struct(F.lit("reachable").alias("stage"), size("persons").alias("persons"), size("orders").alias("orders")),
        F.struct(F.lit("with_items").alias("stage"), size("persons_with_items").alias("persons"),
                 size("orders_with_items").alias("orders")),
        F.struct(F.lit("gap").alias("stage"), size(F.theta_difference("persons", "persons_with_items")).alias("persons"),
                 size(F.theta_difference("orders", "orders_with_items")).alias("orders")))
    return total.select(F.explode(rows).alias("r")).select("r.*")


def staged_errors(estimated: DataFrame, exact: DataFrame, lg: int = LG, deviations: float = 5) -> DataFrame:
    """The exact counts, and whether each estimate is within ``deviations``
    standard errors (relative to the whole set, ``reachable``)."""
    whole = exact.where(F.col("stage") == "reachable")
    e = estimated.select("stage", F.col("persons").alias("_p"), F.col("orders").alias("_o"))
    bound = deviations * error(lg)
    return exact.join(e, "stage").select(
        "stage", "persons", "orders",
        (F.abs(F.col("_p") - F.col("persons")) <= bound * whole.select("persons").scalar()).alias("persons_within"),
        (F.abs(F.col("_o") - F.col("orders")) <= bound * whole.select("orders").scalar()).alias("orders_within"))
