"""Grain, duplicate and orphan checks — run before any figure is trusted.

Scalars from one frame are attached to another as scalar subqueries
(``DataFrame.scalar()``): Spark computes the one-row aggregate once and
inlines the value, so no join (and no cross join) is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import money, pct, ratio, revenue, round_half

PERSON = "customer_unique_id"


def dup_diagnosis(df: DataFrame, key: str) -> DataFrame:
    """Total rows vs distinct keys (before a de-dup)."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.countDistinct(key).alias("distinct_keys"))


def fanout_factor(df: DataFrame, key: str) -> DataFrame:
    """Rows per key — the multiplier a join on ``key`` would apply."""
    return dup_diagnosis(df, key).withColumn(
        "factor", round_half(ratio("total_rows", "distinct_keys"), 2))


def centroid_dedup(df: DataFrame, key: str, avg_cols: list[str], min_cols: list[str]) -> DataFrame:
    """One row per key: mean of the coordinate columns, MIN of text columns.

    The mean is exact-sum / count (the sum stays decimal), so it does not
    depend on the order partial sums are merged in.
    """
    aggs = [(F.sum(c).cast("double") / F.count(c)).alias(c) for c in avg_cols]
    aggs += [F.min(c).alias(c) for c in min_cols]
    return df.groupBy(key).agg(*aggs)


def time_range(orders: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    return orders.agg(F.min(ts).alias("first_order"), F.max(ts).alias("last_order"))


def revenue_item_grain(items: DataFrame) -> DataFrame:
    """The correct total: item revenue summed at item grain."""
    return items.agg(money(F.sum(revenue())).alias("revenue_right"))


def revenue_fanned_out(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """The deliberately wrong total of orders ⋈ items ⋈ payments.

    Every item row is repeated once per payment row of its order.  Instead of
    materialising that fan-out, each side is reduced to one row per order
    first (item revenue sum, payment row count) and the product is summed —
    the same number, with shuffles sized by orders, not items × payments.
    """
    from tidemark.operators.customers import order_revenue
    item_rev = order_revenue(items, "_rev")
    pay_rows = payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("_pays"))
    return (orders.select("order_id")
            .join(item_rev, "order_id").join(pay_rows, "order_id")
            .agg(money(F.sum(F.col("_rev") * F.col("_pays"))).alias("revenue_wrong")))


def revenue_inflation_one_pass(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """revenue_wrong, revenue_right and inflation_pct from one scan of items.

    Per-order item revenue is left-joined to per-order counts of order rows
    and payment rows (every side is one row per order, all partitioned on
    order_id), and a single aggregate takes both totals: right = Σ revenue
    (items whose order is missing still count), wrong = Σ revenue × order
    rows × payment rows over orders present in both — exactly the fan-out of
    joining the three tables row by row.
    """
    from tidemark.operators.customers import order_revenue
    item_rev = order_revenue(items, "_rev")
    n_orders = orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    pay_rows = payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("_pays"))
    j = item_rev.join(n_orders, "order_id", "left").join(pay_rows, "order_id", "left")
    totals = j.agg(money(F.sum(F.col("_rev") * F.col("_n") * F.col("_pays"))).alias("revenue_wrong"),
                   money(F.sum("_rev")).alias("revenue_right"))
    return totals.withColumn("inflation_pct",
                             round_half((ratio("revenue_wrong", "revenue_right") - 1) * 100, 2))


def revenue_inflation(wrong: DataFrame, right: DataFrame) -> DataFrame:
    """wrong ÷ right − 1, in percent."""
    return (wrong.select("revenue_wrong")
            .withColumn("revenue_right", right.select("revenue_right").scalar())
            .withColumn("inflation_pct",
                        round_half((ratio("revenue_wrong", "revenue_right") - 1) * 100, 2)))


def reconcile(series: DataFrame, total: DataFrame, running_col: str = "running_total_revenue",
              order_col: str = "month", total_col: str = "revenue_right") -> DataFrame:
    """Last running-total value vs the independent grain total: must be equal."""
    last = series.agg(money(F.max_by(running_col, order_col)).alias("series_total"))
    return (last.withColumn("grain_total", total.select(money(total_col)).scalar())
            .withColumn("matches", F.col("series_total") == F.col("grain_total")))


def reachable_persons(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Check A: distinct persons reachable through orders."""
    return (customers.select("customer_id", PERSON)
            .join(orders.select("customer_id"), "customer_id")
            .agg(F.countDistinct(PERSON).alias("reachable")))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Check B: rows of ``left`` with no match in ``right`` (anti-join)."""
    return (left.select(key).join(right.select(key), key, "left_anti")
            .agg(F.count(F.lit(1)).alias("orphan_count")))


def staged_counts(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Persons and orders surviving each join stage, and the gap between them.

    One flagged join: customers ⋈ orders, each row marked with whether its
    order has items (a join to the distinct item order ids, so item rows are
    never multiplied in).  Grouping sets then make one row per order and one
    per person from that join, in one exchange; one aggregate counts both.
    NULL ids are no orders and no persons.
    """
    with_items = items.select("order_id").distinct().withColumn("_has", F.lit(1))
    reach = (customers.select("customer_id", PERSON)
             .join(orders.select("order_id", "customer_id"), "customer_id")
             .join(with_items, "order_id", "left")
             .withColumn("_has", F.coalesce("_has", F.lit(0))))
    each = reach.groupingSets([["order_id"], [PERSON]], "order_id", PERSON).agg(F.max("_has").alias("_h"))
    # in an order's row the person is NULL, and the other way round
    c = each.agg(*(x for key, alias in ((PERSON, "p"), ("order_id", "o")) for x in (
        F.count(key).alias(f"{alias}_all"),
        F.count_if(F.col(key).isNotNull() & (F.col("_h") == 1)).alias(f"{alias}_it"))))
    rows = F.array(
        F.struct(F.lit("reachable").alias("stage"), F.col("p_all").alias("persons"), F.col("o_all").alias("orders")),
        F.struct(F.lit("with_items").alias("stage"), F.col("p_it").alias("persons"), F.col("o_it").alias("orders")),
        F.struct(F.lit("gap").alias("stage"), (F.col("p_all") - F.col("p_it")).alias("persons"),
                 (F.col("o_all") - F.col("o_it")).alias("orders")))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def null_bucket_size(items: DataFrame, products: DataFrame,
                     category: str = "product_category_name") -> DataFrame:
    """Item rows and revenue whose product has no category."""
    return (items.select("product_id", revenue().alias("_rev"))
            .join(products.where(F.col(category).isNull()).select("product_id"), "product_id")
            .agg(F.count(F.lit(1)).alias("null_rows"), money(F.sum("_rev")).alias("null_revenue")))


def undelivered_preserved(orders: DataFrame,
                          delivered: str = "order_delivered_customer_date") -> DataFrame:
    """Orders per status and how many have no delivery date (kept, not dropped)."""
    return orders.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col(delivered).isNull().cast("bigint")).alias("undelivered"))


def identity_trap(customers: DataFrame, orders: DataFrame,
                  keys: tuple[str, ...] = ("customer_id", PERSON), min_orders: int = 2) -> DataFrame:
    """Repeat rate keyed on each id column side by side: a per-record id
    fabricates a different retention figure than the per-person id.  Grouping
    sets count all ids from one join."""
    cols = list(dict.fromkeys(["customer_id", *keys]))
    joined = customers.select(*cols).join(
        orders.select("order_id", "customer_id"), "customer_id")
    keys = list(dict.fromkeys(keys))
    per = joined.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_set"), F.countDistinct("order_id").alias("_n"))
    # a set's id has a bit for each key that it leaves out, the first key's bit highest
    own = {k: F.col("_set") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    counts = per.agg(*(x for i, k in enumerate(keys) for x in (
        F.count_if(own[k]).alias(f"n{i}"),
        F.sum(F.when(own[k], (F.col("_n") >= min_orders).cast("bigint"))).alias(f"r{i}"))))
    rows = [F.struct(F.lit(k).alias("key_used"), F.col(f"n{i}").alias("entities"), F.col(f"r{i}").alias("repeat"))
            for i, k in enumerate(keys)]
    return (counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .withColumn("repeat_pct", pct("repeat", "entities")))
