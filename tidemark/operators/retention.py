"""Retention diagnosis: first-delivery exposure vs return, stratified, and
the counterfactual bound on how much of non-return delivery could explain.

Populations (kept as separate builders, never inlined):

* *exposure*: each person's first **delivered** order (earliest purchase,
  ties broken by order id) — undelivered orders are filtered out first;
* *outcome*: ``returned`` = the person has ≥ ``min_orders`` distinct orders
  **of any status**, so an earlier undelivered order still counts;
* *spend*: orders that have items (inner join), see customers.py.

Delay NULL (no estimate) is ``not_late`` here, unlike the four-way bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import delay_days, late_flag, pct, ratio, round_half
from tidemark.operators.customers import PERSON, person_orders, person_spend
from tidemark.operators.primitives import first_event, ntile_desc

DELIVERED = "order_delivered_customer_date"
ESTIMATED = "order_estimated_delivery_date"
PURCHASE = "order_purchase_timestamp"


def first_delivered(customers: DataFrame, orders: DataFrame,
                    strata: list[str] | None = None) -> DataFrame:
    """person, strata…, order_id, delay_days of the person's first delivered order."""
    strata = list(strata or [])
    j = (customers.select("customer_id", PERSON, *strata)
         .join(orders.where(F.col(DELIVERED).isNotNull())
               .select("order_id", "customer_id", PURCHASE, DELIVERED, ESTIMATED), "customer_id"))
    first = first_event(j, PERSON, [F.col(PURCHASE).asc_nulls_last(), F.col("order_id").asc()])
    return first.select(PERSON, *strata, "order_id", delay_days(DELIVERED, ESTIMATED).alias("delay_days"))


def returned_flag(customers: DataFrame, orders: DataFrame, min_orders: int = 2) -> DataFrame:
    """person, returned ∈ {0,1}: at least ``min_orders`` distinct orders."""
    return person_orders(customers, orders).select(
        PERSON, (F.col("order_count") >= min_orders).cast("int").alias("returned"))


_ID_RANGE = 10 ** 20  # over twice the largest integer id


def packed_order(time: str, order_id: str, time_type: str) -> Column:
    """(purchase time ascending NULLS LAST, integer order id ascending) as one
    decimal(38, 0): microseconds in the upper 18 digits, the id in the lower 20.
    Aggregates that compare it keep fixed-width buffers, so they stay hash aggregates."""
    if time_type == "timestamp_ntz":  # without a time zone's gaps and repeated hours
        micros = (f"unix_date(cast({time} as date)) * 86400000000L + (hour({time}) * 3600 + minute({time}) * 60) * 1000000L"
                  f" + cast(extract(second from {time}) * 1000000 as bigint)")
    elif time_type == "date":
        micros = f"unix_date({time}) * 86400000000L"
    else:
        micros = f"unix_micros({time})"
    place = f"coalesce({micros}, 999999999999999999L)"
    return F.expr(f"cast({place} as decimal(18, 0)) * cast({_ID_RANGE} as decimal(21, 0))"
                  f" + (cast({order_id} as decimal(19, 0)) + cast(9223372036854775808 as decimal(19, 0)))").cast("decimal(38,0)")


def person_table(customers: DataFrame, orders: DataFrame, payload: dict[str, Column] | None = None,
                 min_orders: int = 2) -> DataFrame:
    """person, delay_days, returned and ``payload`` columns (fixed-width values
    of customers, as on the record of the first delivered order) — exposure and
    outcome in one pass over orders.

    Equivalent to joining :func:`first_delivered` to :func:`returned_flag`, but orders
    are scanned and joined to customers once: one person-level aggregate takes the distinct
    order count (all statuses) and, ordered by (purchase time, order id), the first
    delivered order's values.  With integer order ids that order is one number
    (:func:`packed_order`), every buffer has a fixed width and the aggregate
    hashes; text ids are compared as a struct, which sorts.  Undelivered orders have a NULL
    place, which ``min_by`` skips; persons without a delivered order are dropped.
    """
    payload = payload or {}
    j = (customers.select("customer_id", PERSON, *[c.alias(n) for n, c in payload.items()])
         .join(orders.select("order_id", "customer_id", PURCHASE, DELIVERED, ESTIMATED), "customer_id"))
    types = dict(orders.dtypes)
    if types["order_id"] in ("tinyint", "smallint", "int", "bigint"):
        place = packed_order(PURCHASE, "order_id", types[PURCHASE])
    else:
        place = F.struct(F.col(PURCHASE).isNull().alias("k0"), F.col(PURCHASE).alias("k1"), F.col("order_id").alias("k2"))
    place = F.when(F.col(DELIVERED).isNotNull(), place)
    per = (j.withColumn("_place", place).withColumn("_delay", delay_days(DELIVERED, ESTIMATED))
           .groupBy(PERSON).agg(F.countDistinct("order_id").alias("_n"), F.min("_place").alias("_first"),
                                *[F.min_by(c, "_place").alias(n) for c, n in (("_delay", "delay_days"), *((n, n) for n in payload))]))
    return per.where(F.col("_first").isNotNull()).select(
        PERSON, "delay_days", *payload, (F.col("_n") >= min_orders).cast("int").alias("returned"))


def exposure_cells(customers: DataFrame, orders: DataFrame, strata: str | None = "customer_state",
                   min_orders: int = 2) -> DataFrame:
    """(stratum,) delivery_bucket, customers, returners: the person table
    folded to its cells.  All strata, rates and bounds below are sums of these few rows.

    Persons carry a hash of their stratum through the aggregate; names come
    back to the cells, which are as many as there are strata (times two)."""
    if strata is None:
        return _cells(person_table(customers, orders, min_orders=min_orders), [])
    code = F.xxhash64(strata)
    names = customers.select(strata, code.alias("_code")).distinct()
    cells = _cells(person_table(customers, orders, {"_code": code}, min_orders), ["_code"])
    return cells.join(names, "_code").select(strata, "delivery_bucket", "customers", "returners")


def _cells(persons: DataFrame, keys: list[str]) -> DataFrame:
    return persons.groupBy(*keys, late_flag().alias("delivery_bucket")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("returned").cast("bigint").alias("returners"))


def exposure_rollup(customers: DataFrame, orders: DataFrame, region_map: DataFrame | None = None,
                    state: str = "customer_state", min_orders: int = 2) -> DataFrame:
    """Return rates of every level from one pass: state, region and total per
    late flag.  ``level`` tells them apart; columns above a level are NULL."""
    cells = _with_region(exposure_cells(customers, orders, state, min_orders), region_map, state)
    level = F.when(F.grouping("region") == 1, "total").when(F.grouping(state) == 1, "region").otherwise("state")
    return (cells.groupingSets([["delivery_bucket", "region", state], ["delivery_bucket", "region"], ["delivery_bucket"]],
                               "delivery_bucket", "region", state)
            .agg(level.alias("level"), F.sum("customers").alias("customers"), F.sum("returners").alias("returners"))
            .select("level", "region", state, "delivery_bucket", "customers", "returners",
                    pct("returners", "customers").alias("return_rate_pct")))


def cell_sizes(customers: DataFrame, orders: DataFrame, strata: str = "customer_state") -> DataFrame:
    """First delivered orders per stratum × late flag."""
    return (exposure_cells(customers, orders, strata)
            .select(strata, "delivery_bucket", F.col("customers").alias("first_orders")).orderBy(strata, "delivery_bucket"))


def thin_cells(cells: DataFrame, floor: int = 30, strata: str = "customer_state") -> DataFrame:
    """Share of stratum × flag cells below ``floor`` first orders.  Empty
    cells count: each stratum has two, taken side by side from one aggregate."""
    def size(flag: str) -> Column:
        return F.sum(F.when(F.col("delivery_bucket") == flag, F.col("first_orders")).otherwise(F.lit(0)))

    per = cells.groupBy(strata).agg(size("late").alias("_l"), size("not_late").alias("_n"))
    thin = (F.col("_l") < floor).cast("bigint") + (F.col("_n") < floor).cast("bigint")
    return (per.agg((F.count(F.lit(1)) * 2).alias("cells"), F.sum(thin).alias("thin"))
            .withColumn("thin_pct", pct("thin", "cells")))


def _with_region(customers: DataFrame, region_map: DataFrame | None, state: str) -> DataFrame:
    """customers + ``region``: a join to a small state→region map (bounded
    by the number of states, so broadcast), else the fixed Brazilian map."""
    if region_map is None:
        from tidemark.functions import region_of_state
        return customers.withColumn("region", region_of_state(state))
    m = region_map.select(F.col(state).alias("_state"), F.col("region").alias("_region"))
    c = customers.drop("region") if "region" in customers.columns else customers
    return (c.join(F.broadcast(m), F.col(state) == F.col("_state"), "left")
            .withColumn("region", F.coalesce(F.col("_region"), F.lit("unknown")))
            .drop("_state", "_region"))


def stratified_counts(customers: DataFrame, orders: DataFrame, region_map: DataFrame | None = None,
                      state: str = "customer_state", min_orders: int = 2) -> DataFrame:
    """region, delivery_bucket, customers, returners (raw counts)."""
    cells = _with_region(exposure_cells(customers, orders, state, min_orders), region_map, state)
    return cells.groupBy("region", "delivery_bucket").agg(F.sum("customers").alias("customers"), F.sum("returners").alias("returners"))


def stratified_rate(customers: DataFrame, orders: DataFrame, region_map: DataFrame | None = None,
                    state: str = "customer_state", min_orders: int = 2) -> DataFrame:
    """Return rate per region × late flag."""
    s = stratified_counts(customers, orders, region_map, state, min_orders)
    return s.select("region", "delivery_bucket", "customers",
                    pct("returners", "customers").alias("return_rate_pct")).orderBy("region", "delivery_bucket")


def exposure_rate(customers: DataFrame, orders: DataFrame, min_orders: int = 2) -> DataFrame:
    """Return rate and returners per late flag, all regions together."""
    return exposure_cells(customers, orders, None, min_orders).withColumn("return_rate_pct", pct("returners", "customers"))


def _by_flag(df: DataFrame, keys: list[str]) -> DataFrame:
    def pick(flag, c):
        return F.sum(F.when(F.col("delivery_bucket") == flag, F.col(c)).otherwise(F.lit(0))).cast("bigint")
    return df.groupBy(*keys).agg(pick("late", "customers").alias("_nl"), pick("late", "returners").alias("_rl"),
                                 pick("not_late", "customers").alias("_nn"),
                                 pick("not_late", "returners").alias("_rn"))


def counterfactual_bound(exposure: DataFrame) -> DataFrame:
    """If the late group returned at the not-late rate: customers recovered,
    and that as a share of all non-returners.  Unrounded rates throughout;
    an upper bound (assumes the whole gap is caused by lateness)."""
    f = _by_flag(exposure, [])
    gap = ratio("_rn", "_nn") - ratio("_rl", "_nl")
    recovered = F.col("_nl").cast("double") * gap
    non_ret = (F.col("_nl") - F.col("_rl")) + (F.col("_nn") - F.col("_rn"))
    return f.select(
        F.col("_nl").alias("exposed"),
        round_half(gap * 100, 2).alias("gap_pct"),
        round_half(recovered, 2).alias("recovered"),
        non_ret.alias("non_returners"),
        round_half(ratio(recovered, non_ret) * 100, 4).alias("share_pct"))


def stratum_gap(stratified: DataFrame) -> DataFrame:
    """Per region: not-late and late return rates, their gap and direction."""
    f = _by_flag(stratified, ["region"])
    gap = ratio("_rn", "_nn") - ratio("_rl", "_nl")
    return f.select("region", pct("_rn", "_nn").alias("not_late_pct"), pct("_rl", "_nl").alias("late_pct"),
                    round_half(gap * 100, 2).alias("gap"),
                    (ratio("_rl", "_nl") < ratio("_rn", "_nn")).alias("late_worse"),
                    F.col("_nl").alias("late_customers"))


def spend_and_return(customers: DataFrame, orders: DataFrame, items: DataFrame,
                     min_orders: int = 2) -> DataFrame:
    """person, revenue (orders that have items), returned (≥ min_orders
    distinct orders of any status) — one customers⋈orders join and one
    person-level aggregate instead of two.

    Orders are left-joined to their per-order item revenue, so itemless
    orders still count toward ``returned``; persons with no order that has
    items get a NULL revenue and are dropped, as the inner join to items
    drops them from the spend population.
    """
    from tidemark.operators.customers import order_revenue
    per = (customers.select("customer_id", PERSON)
           .join(orders.select("order_id", "customer_id"), "customer_id")
           .join(order_revenue(items), "order_id", "left")
           .groupBy(PERSON).agg(F.sum("_order_rev").alias("revenue"),
                                F.countDistinct("order_id").alias("_n")))
    return per.where(F.col("revenue").isNotNull()).select(
        PERSON, "revenue", (F.col("_n") >= min_orders).cast("int").alias("returned"))


def first_order_spend(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """person, revenue of the person's first order that has items — the
    non-circular spend basis (a second order cannot lift the tier)."""
    from tidemark.operators.customers import order_revenue
    j = (customers.select("customer_id", PERSON)
         .join(orders.select("order_id", "customer_id", PURCHASE), "customer_id")
         .join(order_revenue(items), "order_id"))
    first = first_event(j, PERSON, [F.col(PURCHASE).asc_nulls_last(), F.col("order_id").asc()])
    return first.select(PERSON, F.col("_order_rev").alias("revenue"))


def tier_counts(customers: DataFrame, orders: DataFrame, items: DataFrame, n: int = 4,
                spend_basis: str = "all", min_orders: int = 2,
                tile: str = "spend_quartile", **kw) -> DataFrame:
    """tile, customers, spend sum, returners per spend tier.

    With ``spend_basis="all"`` (the source definition) tiers are partly
    circular: repeat buyers spend more because they returned.
    ``"first_order"`` ranks on first-order spend instead."""
    if spend_basis == "all":
        j = ntile_desc(spend_and_return(customers, orders, items, min_orders), "revenue", PERSON, n,
                       alias=tile, **kw)
    elif spend_basis == "first_order":
        spend = first_order_spend(customers, orders, items)
        tiled = ntile_desc(spend, "revenue", PERSON, n, alias=tile, **kw)
        j = tiled.join(returned_flag(customers, orders, min_orders), PERSON)
    else:
        raise ValueError(spend_basis)
    return j.groupBy(tile).agg(F.count(F.lit(1)).alias("customers"), F.sum("revenue").alias("_rev"),
                               F.sum("returned").cast("bigint").alias("_ret"))


def tier_return_rate(customers: DataFrame, orders: DataFrame, items: DataFrame, n: int = 4,
                     spend_basis: str = "all", min_orders: int = 2,
                     tile: str = "spend_quartile", **kw) -> DataFrame:
    """Spend tier × return rate and mean spend."""
    t = tier_counts(customers, orders, items, n, spend_basis, min_orders, tile, **kw)
    return t.select(tile, "customers", round_half(ratio("_rev", "customers"), 2).alias("avg_spend"),
                    pct("_ret", "customers").alias("return_rate_pct")).orderBy(tile)


def one_time_within_tier(customers: DataFrame, orders: DataFrame, items: DataFrame, n: int = 4,
                         spend_basis: str = "all", min_orders: int = 2,
                         tile: str = "spend_quartile", **kw) -> DataFrame:
    """Per tier: share of persons who never returned."""
    t = tier_counts(customers, orders, items, n, spend_basis, min_orders, tile, **kw)
    return t.select(tile, pct(F.col("customers") - F.col("_ret"), "customers").alias("one_time_pct"))
