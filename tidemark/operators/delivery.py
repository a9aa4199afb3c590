"""Delivery delay: distribution, bucket → review score, exclusion effect.

delay_days = delivered date − estimated date (calendar days, negative =
early).  Percentiles are exact (``percentile`` keeps a value→count map;
whole-day delays have few distinct values, so the map stays small at any
row count); ``exact=False`` switches to ``percentile_approx``.

The same figures come from a small additive summary, the count of orders a
purchase month and delay (:func:`delay_summary`).  It is kept as a table with a
folder a month, of which single months are replaced, and any percentile of any
set of months is read from it by a cumulative sum (:func:`summary_distribution`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import delay_days, delivery_bucket, month_of, pct, ratio, round_half

DELIVERED = "order_delivered_customer_date"
PERCENTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def delivered_delays(orders: DataFrame) -> DataFrame:
    """order_id, delivery timestamp, delay_days for delivered orders."""
    return (orders.where(F.col(DELIVERED).isNotNull())
            .select("order_id", DELIVERED, delay_days().alias("delay_days")))


def delay_distribution(orders: DataFrame, exact: bool = True) -> DataFrame:
    """min, max, mean (2 dp) and interpolated p25/p50/p75/p90 of delay_days."""
    d = delivered_delays(orders)
    qs = list(PERCENTILES.values())
    q = (F.percentile("delay_days", F.array(*[F.lit(x) for x in qs])) if exact
         else F.percentile_approx("delay_days", qs, 100000))
    agg = d.agg(F.min("delay_days").alias("min_delay"), F.max("delay_days").alias("max_delay"),
                F.sum("delay_days").alias("_s"), F.count("delay_days").alias("_n"), q.alias("_q"))
    return agg.select(
        "min_delay", "max_delay", round_half(ratio("_s", "_n"), 2).alias("avg_delay"),
        *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(PERCENTILES)])


def delay_summary(orders: DataFrame) -> DataFrame:
    """month (of purchase), delay_days, n: how many delivered orders had the
    delay.  Orders without a purchase time have a NULL month; an unknown delay
    (no estimate) is counted under NULL.  Summaries of disjoint orders add up."""
    return (orders.where(F.col(DELIVERED).isNotNull())
            .groupBy(month_of("order_purchase_timestamp").alias("month"), delay_days().alias("delay_days"))
            .agg(F.count(F.lit(1)).alias("n")))


def write_delay_summary(summary: DataFrame, path: str) -> None:
    """Put the months of ``summary`` in place in the table at ``path``; other
    months stay as they are, so a run over one month's orders corrects that
    month, and a run repeated changes nothing.  A month is one file, as it has
    one row a delay."""
    (summary.withColumn("in_month", F.date_format("month", "yyyy-MM"))
     .repartition("in_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("in_month").parquet(path))


def read_delay_summary(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The summary table, or only some months (``yyyy-MM``) of it: other months'
    folders are not read."""
    schema = "month timestamp_ntz, delay_days bigint, n bigint, in_month string"
    kept = spark.read.schema(schema).parquet(path)
    return (kept if months is None else kept.where(F.col("in_month").isin(months))).drop("in_month")


def _at(place: Column) -> Column:
    """The delay at a 0-based place of the sorted orders."""
    return F.min(F.when(F.col("_upto") > place, F.col("delay_days")))


def summary_distribution(summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The figures of :func:`delay_distribution` from a summary, in total or for
    each value of ``by``.

    A percentile lies at place ``q * (n - 1)`` of the sorted orders; the orders up to a delay
    are a running sum over distinct delays, of which there are as many as days.
    Unknown delays are left out; without orders the figures are NULL (in total)
    or there is no row (``by``)."""
    by = by or []
    counts = (summary.where(F.col("delay_days").isNotNull())
              .groupBy(*by, "delay_days").agg(F.sum("n").alias("n")))
    w = Window.partitionBy(*by).orderBy("delay_days").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumn("_upto", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    figures = [F.min("delay_days").alias("min_delay"), F.max("delay_days").alias("max_delay"),
               round_half(ratio(F.sum(F.col("delay_days") * F.col("n")), F.sum("n")), 2).alias("avg_delay")]
    for name, q in PERCENTILES.items():
        place = F.lit(q) * (F.col("_all") - 1)
        low, high = _at(F.floor(place)), _at(F.ceil(place))
        part = F.max(place - F.floor(place))
        figures.append((low + (high - low) * part).cast("double").alias(name))
    return cumulated.groupBy(*by).agg(*figures)


def _reviewed(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    return delivered_delays(orders).join(
        reviews.select("order_id", "review_score", "review_creation_date"), "order_id")


def _after_delivery(by_date: bool):
    if by_date:
        return F.col("review_creation_date").cast("date") >= F.col(DELIVERED).cast("date")
    return F.col("review_creation_date") >= F.col(DELIVERED)


def bucket_score(orders: DataFrame, reviews: DataFrame, by_date: bool = False) -> DataFrame:
    """delivery_bucket, reviews_counted (review rows), avg_score — only
    reviews created at/after the delivery timestamp (``by_date=True``
    compares calendar dates instead)."""
    r = _reviewed(orders, reviews).where(_after_delivery(by_date))
    return (r.groupBy(delivery_bucket().alias("delivery_bucket"))
            .agg(F.count(F.lit(1)).alias("reviews_counted"),
                 F.sum("review_score").alias("_s"), F.count("review_score").alias("_n"))
            .select("delivery_bucket", "reviews_counted", round_half(ratio("_s", "_n"), 2).alias("avg_score"))
            .orderBy(F.col("avg_score").desc_nulls_first(), "delivery_bucket"))


def exclusion_effect(orders: DataFrame, reviews: DataFrame, by_date: bool = False) -> DataFrame:
    """Review rows per bucket before and after dropping pre-delivery reviews
    (one pass, conditional counts)."""
    r = _reviewed(orders, reviews)
    return (r.groupBy(delivery_bucket().alias("delivery_bucket"))
            .agg(F.count(F.lit(1)).alias("before"),
                 F.sum(F.coalesce(_after_delivery(by_date), F.lit(False)).cast("bigint")).alias("after")))


def early_share(orders: DataFrame) -> DataFrame:
    """delivered orders, how many arrived before the estimate, share."""
    d = delivered_delays(orders)
    return (d.agg(F.count(F.lit(1)).alias("delivered"),
                  F.sum((F.col("delay_days") < 0).cast("bigint")).alias("early"))
            .withColumn("early_pct", pct("early", "delivered")))
