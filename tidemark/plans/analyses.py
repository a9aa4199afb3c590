"""The three acts of the analysis as binding-agnostic plans.

``analyses(params)`` maps a result name to a function of a
:class:`~tidemark.sources.tpch.Tables` binding, so the same plans run on
silver tables in the canonical schema (``native_tables``) or on any other
binding.  Nothing is collected; each function returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.operators import concentration as conc
from tidemark.operators import customers as cust
from tidemark.operators import delivery as dlv
from tidemark.operators import growth as grw
from tidemark.operators import quality as qa
from tidemark.operators import retention as ret
from tidemark.operators import series as ser
from tidemark.operators import sketches as sk
from tidemark.sources.tpch import Tables


@dataclass(frozen=True)
class Params:
    """Choices the analysis makes about its data."""
    year_a: int
    year_b: int
    matched_months: tuple[int, int]
    share_floor: float = 25000          # base-year revenue floor for share shift
    small_base_floor: float = 25000     # month-over-month base floor
    trust_window: tuple[str, str] | None = None  # [start, end) of trustworthy months
    thin_floor: int = 30                # minimum first orders per stratum cell
    pareto_p: float = 80
    deciles: int = 10
    spend_tiers: int = 4
    min_orders: int = 2
    identity_keys: tuple[str, str] = ("customer_id", "customer_unique_id")
    geo_key: str = "geolocation_zip_code_prefix"
    geo_avg: tuple[str, ...] = ("geolocation_lat", "geolocation_lng")
    geo_min: tuple[str, ...] = ("geolocation_city", "geolocation_state")


# --- fixed values: the source analysis's own choices on its data ---
NATIVE_PARAMS = Params(year_a=2017, year_b=2018, matched_months=(1, 8), share_floor=25000,
                       small_base_floor=25000,
                       trust_window=("2017-01-01 00:00:00", "2018-09-01 00:00:00"))


def analyses(p: Params) -> dict[str, Callable[[Tables], DataFrame]]:
    q: dict[str, Callable[[Tables], DataFrame]] = {}
    # grain and de-dup checks
    q["dup_diagnosis"] = lambda t: qa.dup_diagnosis(t.geolocation, p.geo_key)
    q["centroid_dedup"] = lambda t: qa.centroid_dedup(t.geolocation, p.geo_key, list(p.geo_avg), list(p.geo_min))
    q["fanout_factor"] = lambda t: qa.fanout_factor(t.geolocation, p.geo_key)
    # act 1: landscape
    q["time_range"] = lambda t: qa.time_range(t.orders)
    q["revenue_fanned_out"] = lambda t: qa.revenue_fanned_out(t.orders, t.items, t.payments)
    q["revenue_item_grain"] = lambda t: qa.revenue_item_grain(t.items)
    q["revenue_inflation"] = lambda t: qa.revenue_inflation_one_pass(t.orders, t.items, t.payments)
    q["monthly_growth"] = lambda t: ser.monthly_growth(t.orders, t.items)
    q["revenue_moving_avg"] = lambda t: ser.moving_average(t.orders, t.items, 3)
    q["revenue_running_total"] = lambda t: ser.running_total(t.orders, t.items)
    q["revenue_reconcile"] = lambda t: qa.reconcile(ser.running_total(t.orders, t.items),
                                                    qa.revenue_item_grain(t.items))
    q["monthly_growth_dense"] = lambda t: ser.monthly_growth(t.orders, t.items, dense=True)
    q["revenue_moving_avg_dense"] = lambda t: ser.moving_average(t.orders, t.items, 3, dense=True)
    q["revenue_running_total_dense"] = lambda t: ser.running_total(t.orders, t.items, dense=True)
    q["product_idle_months"] = lambda t: ser.idle_months(t.orders, t.items, "product_id")
    q["monthly_growth_masked"] = lambda t: ser.small_base_flag(
        ser.monthly_growth(t.orders, t.items), p.small_base_floor)
    if p.trust_window:
        q["monthly_growth_trimmed"] = lambda t: ser.monthly_growth(
            t.orders, t.items, trim=(*p.trust_window, "before"))
    q["category_pareto"] = lambda t: conc.pareto(t.items, t.products)
    q["pareto_threshold"] = lambda t: conc.pareto_threshold(t.items, t.products, p.pareto_p)
    # act 2: concentration
    q["seller_decile_share"] = lambda t: conc.ntile_share(t.items, "seller_id", p.deciles)
    q["seller_cumulative_share"] = lambda t: conc.top_tile_share(conc.ntile_share(t.items, "seller_id", p.deciles))
    q["purchase_frequency"] = lambda t: cust.frequency_distribution(t.customers, t.orders)
    q["one_time_share"] = lambda t: cust.one_time_share(t.customers, t.orders)
    q["reachable_persons"] = lambda t: qa.reachable_persons(t.customers, t.orders)
    q["itemless_orders"] = lambda t: qa.orphans(t.orders, t.items, "order_id")
    q["staged_counts"] = lambda t: qa.staged_counts(t.customers, t.orders, t.items)
    q["staged_counts_sketched"] = lambda t: sk.staged_errors(
        sk.staged(sk.monthly_sketches(t.customers, t.orders, t.items)), qa.staged_counts(t.customers, t.orders, t.items))
    q["spend_quartiles"] = lambda t: cust.spend_tiers(t.customers, t.orders, t.items, p.spend_tiers)
    q["repeat_buyers"] = lambda t: cust.repeat_flag(t.customers, t.orders, t.items, p.min_orders)
    q["repeat_ratio"] = lambda t: cust.disproportionality(t.customers, t.orders, t.items, p.min_orders)
    q["identity_trap"] = lambda t: qa.identity_trap(t.customers, t.orders, p.identity_keys, p.min_orders)
    win = (p.year_a, p.year_b, p.matched_months)
    q["platform_growth"] = lambda t: grw.platform_growth(t.orders, t.items, t.products, *win)
    q["category_share_shift"] = lambda t: grw.share_shift(t.orders, t.items, t.products, *win, p.share_floor)
    q["share_trend_counts"] = lambda t: grw.share_trend_counts(
        grw.share_shift(t.orders, t.items, t.products, *win, p.share_floor))
    q["null_category_revenue"] = lambda t: qa.null_bucket_size(t.items, t.products)
    # act 3: retention diagnosis
    q["delay_distribution"] = lambda t: dlv.delay_distribution(t.orders)
    q["delay_distribution_by_month"] = lambda t: dlv.summary_distribution(dlv.delay_summary(t.orders), ["month"])
    q["delay_bucket_score"] = lambda t: dlv.bucket_score(t.orders, t.reviews)
    q["pre_delivery_exclusion"] = lambda t: dlv.exclusion_effect(t.orders, t.reviews)
    q["early_share"] = lambda t: dlv.early_share(t.orders)
    q["undelivered_by_status"] = lambda t: qa.undelivered_preserved(t.orders)
    q["first_delivered_order"] = lambda t: ret.first_delivered(t.customers, t.orders)
    q["state_cell_sizes"] = lambda t: ret.cell_sizes(t.customers, t.orders)
    q["thin_cells"] = lambda t: ret.thin_cells(ret.cell_sizes(t.customers, t.orders), p.thin_floor)
    q.update(retention_analyses(p))
    q["spend_tier_return_first_order"] = lambda t: ret.tier_return_rate(
        t.customers, t.orders, t.items, p.spend_tiers, spend_basis="first_order", min_orders=p.min_orders)
    return q


def retention_analyses(p: Params) -> dict[str, Callable[[Tables], DataFrame]]:
    """Return-rate results (these depend on the order window chosen)."""
    return {
        "region_return_rate": lambda t: ret.stratified_rate(t.customers, t.orders, t.region_map,
                                                            min_orders=p.min_orders),
        "exposure_rollup": lambda t: ret.exposure_rollup(t.customers, t.orders, t.region_map, min_orders=p.min_orders),
        "region_gap": lambda t: ret.stratum_gap(ret.stratified_counts(t.customers, t.orders, t.region_map,
                                                                      min_orders=p.min_orders)),
        "delivery_return_rate": lambda t: ret.exposure_rate(t.customers, t.orders, p.min_orders),
        "counterfactual_bound": lambda t: ret.counterfactual_bound(
            ret.exposure_rate(t.customers, t.orders, p.min_orders)),
        "spend_tier_return": lambda t: ret.tier_return_rate(t.customers, t.orders, t.items, p.spend_tiers,
                                                            min_orders=p.min_orders),
        "tier_one_time": lambda t: ret.one_time_within_tier(t.customers, t.orders, t.items, p.spend_tiers,
                                                            min_orders=p.min_orders),
    }
