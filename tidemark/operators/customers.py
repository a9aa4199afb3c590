"""Person-level purchase frequency, spend tiers and the repeat flag.

A person is ``customer_unique_id``; ``customer_id`` is one record per
order in the source data.  Two populations are kept apart on purpose:

* orders of any status (frequency, the *returned* flag in retention);
* orders that have items (spend, the *repeat* flag) — an inner join to
  items, so persons whose orders have no items drop out.

Item revenue is summed per order before it is joined to orders and
customers, so the person-level shuffles carry one row per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cents, from_cents, money, pct, ratio, revenue, round_half
from tidemark.operators.primitives import ntile_desc, share_over_all

PERSON = "customer_unique_id"


def person_orders(customers: DataFrame, orders: DataFrame, person: str = PERSON) -> DataFrame:
    """person, order_count = distinct orders of any status."""
    return (customers.select("customer_id", person)
            .join(orders.select("order_id", "customer_id"), "customer_id")
            .groupBy(person).agg(F.countDistinct("order_id").alias("order_count")))


def order_revenue(items: DataFrame, alias: str = "_order_rev") -> DataFrame:
    """order_id, item revenue of the order (orders without items absent).

    The per-order sum runs on exact integer cents (a bigint hash-aggregate
    buffer instead of a wide decimal one, about twice as fast) and is turned
    back into decimal money once per order.  A single order's revenue is far
    from the bigint range; totals over many orders are summed as decimals.
    """
    return (items.groupBy("order_id").agg(F.sum(cents(revenue())).alias("_cents"))
            .select("order_id", from_cents("_cents").alias(alias)))


def person_spend(customers: DataFrame, orders: DataFrame, items: DataFrame,
                 person: str = PERSON) -> DataFrame:
    """person, revenue, order_count over orders that have items."""
    return (customers.select("customer_id", person)
            .join(orders.select("order_id", "customer_id"), "customer_id")
            .join(order_revenue(items), "order_id")
            .groupBy(person).agg(F.sum("_order_rev").alias("revenue"),
                                 F.countDistinct("order_id").alias("order_count")))


def frequency_distribution(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """purchase_count, number_of_customers."""
    return (person_orders(customers, orders)
            .groupBy(F.col("order_count").alias("purchase_count"))
            .agg(F.count(F.lit(1)).alias("number_of_customers"))
            .orderBy("purchase_count"))


def one_time_share(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Share of persons with exactly one order."""
    return (person_orders(customers, orders)
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.sum((F.col("order_count") == 1).cast("bigint")).alias("one_time"))
            .withColumn("one_time_pct", pct("one_time", "customers")))


def spend_tiers(customers: DataFrame, orders: DataFrame, items: DataFrame, n: int = 4,
                tile: str = "spend_quartile", **kw) -> DataFrame:
    """n spend tiers (revenue desc, person asc): customers, revenue, % of
    revenue, mean spend per tier."""
    spend = person_spend(customers, orders, items).select(PERSON, "revenue")
    tiled = ntile_desc(spend, "revenue", PERSON, n, alias=tile, **kw)
    agg = tiled.groupBy(tile).agg(F.count(F.lit(1)).alias("customers"),
                                  F.sum("revenue").alias("_rev"))
    return agg.select(
        tile, "customers", money("_rev").alias("tier_revenue"),
        round_half(ratio("_rev", share_over_all("_rev")) * 100, 2).alias("pct_of_revenue"),
        round_half(ratio("_rev", "customers"), 2).alias("avg_spend")).orderBy(tile)


def _repeat_groups(customers, orders, items, min_orders):
    spend = person_spend(customers, orders, items)
    label = F.when(F.col("order_count") >= min_orders, "repeat").otherwise("one_time")
    return spend.groupBy(label.alias("buyer_type")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("revenue").alias("_rev"))


def repeat_flag(customers: DataFrame, orders: DataFrame, items: DataFrame,
                min_orders: int = 2) -> DataFrame:
    """one_time vs repeat: customers, % of customers, % of revenue."""
    g = _repeat_groups(customers, orders, items, min_orders)
    return g.select("buyer_type", "customers",
                    pct("customers", share_over_all("customers")).alias("pct_of_customers"),
                    pct("_rev", share_over_all("_rev")).alias("pct_of_revenue"))


def disproportionality(customers: DataFrame, orders: DataFrame, items: DataFrame,
                       min_orders: int = 2) -> DataFrame:
    """Revenue share ÷ customer share per buyer type (unrounded shares).
    Near-tautological for repeat buyers — reported, not read as a finding."""
    g = _repeat_groups(customers, orders, items, min_orders)
    rev_share = ratio("_rev", share_over_all("_rev"))
    cust_share = ratio("customers", share_over_all("customers"))
    return g.select("buyer_type", round_half(rev_share / cust_share, 2).alias("revenue_to_customer_ratio"))
