"""Hand-made micro-fixtures for the semantics the source analysis depends on
(populations, NULL handling, tie-breaks, grain)."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators import concentration as conc
from tidemark.operators import customers as cust
from tidemark.operators import delivery as dlv
from tidemark.operators import growth as grw
from tidemark.operators import quality as qa
from tidemark.operators import retention as ret
from tidemark.operators import series as ser


def ts(c):
    return F.col(c).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def fx(spark):
    orders = spark.createDataFrame([
        # person A: first order undelivered, second delivered early
        ("o1", "cA1", "canceled", "2018-01-05 10:00:00", None, "2018-01-20 00:00:00"),
        ("o2", "cA2", "delivered", "2018-02-01 09:00:00", "2018-02-10 15:00:00", "2018-02-15 00:00:00"),
        # person B: delivered late
        ("o3", "cB", "delivered", "2018-03-01 08:00:00", "2018-03-20 10:00:00", "2018-03-10 00:00:00"),
        # person C: NULL estimate, plus an itemless cancelled order
        ("o4", "cC", "delivered", "2018-03-05 08:00:00", "2018-03-05 12:00:00", None),
        ("o5", "cC", "canceled", "2018-04-01 08:00:00", None, "2018-04-20 00:00:00"),
    ], "order_id string, customer_id string, order_status string, order_purchase_timestamp string, "
       "order_delivered_customer_date string, order_estimated_delivery_date string")
    for c in orders.columns[3:]:
        orders = orders.withColumn(c, ts(c))
    customers = spark.createDataFrame([
        ("cA1", "A", "SP"), ("cA2", "A", "RJ"), ("cB", "B", "AC"), ("cC", "C", "XX")],
        "customer_id string, customer_unique_id string, customer_state string")
    items = spark.createDataFrame([
        ("o2", "p1", "s1", D("10.00"), D("1.00")), ("o2", "p2", "s2", D("20.00"), D("2.00")),
        ("o3", "p3", "s1", D("5.00"), D("0.50")), ("o4", "p1", "s3", D("7.00"), D("0.70"))],
        "order_id string, product_id string, seller_id string, price decimal(18,2), freight_value decimal(18,2)")
    payments = spark.createDataFrame([("o2", 1), ("o2", 2), ("o3", 1), ("o4", 1)],
                                     "order_id string, payment_sequential int")
    reviews = spark.createDataFrame([
        ("r2", "o2", 5, "2018-02-10 00:00:00"), ("r3", "o3", 2, "2018-03-21 00:00:00"),
        ("r4", "o4", 3, "2018-03-06 00:00:00")],
        "review_id string, order_id string, review_score int, review_creation_date string"
    ).withColumn("review_creation_date", ts("review_creation_date"))
    products = spark.createDataFrame([("p1", "a"), ("p2", None), ("p3", "b")],
                                     "product_id string, product_category_name string")
    return dict(orders=orders, customers=customers, items=items, payments=payments,
                reviews=reviews, products=products)


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fanout_vs_grain(fx):
    wrong = qa.revenue_fanned_out(fx["orders"], fx["items"], fx["payments"])
    right = qa.revenue_item_grain(fx["items"])
    assert wrong.first().revenue_wrong == D("79.20")   # o2 items counted twice
    assert right.first().revenue_right == D("46.20")
    infl = qa.revenue_inflation(wrong, right).first()
    assert infl.inflation_pct == pytest.approx(71.43)
    one = qa.revenue_inflation_one_pass(fx["orders"], fx["items"], fx["payments"]).first()
    assert (one.revenue_wrong, one.revenue_right, one.inflation_pct) == (D("79.20"), D("46.20"), 71.43)


def test_orphans_and_staged_counts(fx):
    assert qa.orphans(fx["orders"], fx["items"], "order_id").first().orphan_count == 2
    got = {r.stage: (r.persons, r.orders) for r in qa.staged_counts(
        fx["customers"], fx["orders"], fx["items"]).collect()}
    assert got == {"reachable": (3, 5), "with_items": (3, 3), "gap": (0, 2)}


def test_person_not_record(fx):
    freq = rows(cust.frequency_distribution(fx["customers"], fx["orders"]))
    assert freq == [(1, 1), (2, 2)]
    trap = {r.key_used: (r.entities, r.repeat) for r in qa.identity_trap(
        fx["customers"], fx["orders"]).collect()}
    assert trap == {"customer_id": (4, 1), "customer_unique_id": (3, 2)}


def test_first_delivered_and_return(fx):
    first = {r.customer_unique_id: (r.order_id, r.delay_days) for r in ret.first_delivered(
        fx["customers"], fx["orders"]).collect()}
    assert first == {"A": ("o2", -5), "B": ("o3", 10), "C": ("o4", None)}
    exp = {r.delivery_bucket: (r.customers, r.returners) for r in ret.exposure_rate(
        fx["customers"], fx["orders"]).collect()}
    # A returned through an undelivered first order; C's NULL delay is not_late
    assert exp == {"not_late": (2, 2), "late": (1, 0)}
    b = ret.counterfactual_bound(ret.exposure_rate(fx["customers"], fx["orders"])).first()
    assert (b.exposed, b.gap_pct, b.recovered, b.non_returners, b.share_pct) == (1, 100.0, 1.0, 1, 100.0)


def test_bound_zero_when_rates_equal(spark):
    e = spark.createDataFrame([("late", 10, 3), ("not_late", 20, 6)],
                              "delivery_bucket string, customers long, returners long")
    b = ret.counterfactual_bound(e).first()
    assert b.recovered == 0.0 and b.non_returners == 21


def test_strata_and_unknown_region(fx):
    cells = rows(ret.cell_sizes(fx["customers"], fx["orders"]))
    assert cells == [("AC", "late", 1), ("RJ", "not_late", 1), ("XX", "not_late", 1)]
    rates = rows(ret.stratified_rate(fx["customers"], fx["orders"]), "region", "delivery_bucket", "customers")
    assert rates == [("North", "late", 1), ("Southeast", "not_late", 1), ("unknown", "not_late", 1)]
    thin = ret.thin_cells(ret.cell_sizes(fx["customers"], fx["orders"]), floor=1).first()
    assert (thin.cells, thin.thin) == (6, 3)


def test_review_filter_timestamp_vs_date(fx):
    by_ts = rows(dlv.bucket_score(fx["orders"], fx["reviews"]), "delivery_bucket", "reviews_counted")
    assert by_ts == [("late", 2)]            # NULL delay falls to late in the 4-way CASE
    by_date = rows(dlv.bucket_score(fx["orders"], fx["reviews"], by_date=True), "delivery_bucket", "reviews_counted")
    assert by_date == [("early", 1), ("late", 2)]
    excl = rows(dlv.exclusion_effect(fx["orders"], fx["reviews"]))
    assert excl == [("early", 1, 0), ("late", 2, 2)]


def test_monthly_rows_frames_skip_gaps(fx):
    g = ser.monthly_growth(fx["orders"], fx["items"]).collect()
    assert [r.month.month for r in g] == [2, 3]          # January has no items: skipped
    assert g[1].previous_month_revenue == D("33.00")
    ma = ser.moving_average(fx["orders"], fx["items"]).collect()
    assert ma[0].revenue_3month_moving_avg == 33.0      # partial frame kept
    rt = ser.running_total(fx["orders"], fx["items"]).collect()
    assert rt[-1].running_total_revenue == D("46.20")
    rec = qa.reconcile(ser.running_total(fx["orders"], fx["items"]), qa.revenue_item_grain(fx["items"])).first()
    assert rec.matches


def test_pareto_keeps_null_group(fx):
    p = conc.pareto(fx["items"], fx["products"]).orderBy("running_total").collect()
    assert [(r.product_category, r.revenue, r.running_total, r.cumulative_pct) for r in p] == [
        (None, D("22.00"), D("22.00"), 47.62), ("a", D("18.70"), D("40.70"), 88.1),
        ("b", D("5.50"), D("46.20"), 100.0)]
    th = conc.pareto_threshold(fx["items"], fx["products"], 80).first()
    assert (th.entities_needed, th.entities_total) == (2, 3)


def test_share_shift_zero_base_and_floor(spark):
    orders = spark.createDataFrame([("o1", "2017-02-01"), ("o2", "2018-02-01"), ("o3", "2018-03-01"),
                                    ("o4", "2017-03-01"), ("o5", "2018-09-01")],
                                   "order_id string, order_purchase_timestamp string"
                                   ).withColumn("order_purchase_timestamp", ts("order_purchase_timestamp"))
    items = spark.createDataFrame([("o1", "p1", D("100"), D("0")), ("o2", "p1", D("600"), D("0")),
                                   ("o3", "p2", D("50"), D("0")), ("o4", "p3", D("10"), D("0")),
                                   ("o5", "p1", D("999"), D("0"))],
                                  "order_id string, product_id string, price decimal(18,2), freight_value decimal(18,2)")
    products = spark.createDataFrame([("p1", "x"), ("p2", "y"), ("p3", "z")],
                                     "product_id string, product_category_name string")
    pg = grw.platform_growth(orders, items, products, 2017, 2018, (1, 8)).first()
    assert (pg.total_2017, pg.total_2018, pg.platform_growth) == (D("110.00"), D("650.00"), 490.91)
    sh = {r.product_category_name: (r.growth_rate, r.share_trend)
          for r in grw.share_shift(orders, items, products, 2017, 2018, (1, 8), floor=0).collect()}
    # y has no base-year revenue: growth NULL → losing share
    assert sh == {"x": (500.0, "gaining share"), "y": (None, "losing share"), "z": (-100.0, "losing share")}
    assert set(r.product_category_name for r in grw.share_shift(
        orders, items, products, 2017, 2018, (1, 8), floor=50).collect()) == {"x"}


def test_spend_tiers_ties_and_fewer_rows_than_tiles(fx):
    t = rows(cust.spend_tiers(fx["customers"], fx["orders"], fx["items"], n=10), "spend_quartile", "customers")
    assert t == [(1, 1), (2, 1), (3, 1)]
    r = rows(ret.tier_return_rate(fx["customers"], fx["orders"], fx["items"], n=2),
             "spend_quartile", "customers", "return_rate_pct")
    assert r == [(1, 2, 100.0), (2, 1, 0.0)]


def test_driver_fixture_values(spark):
    """Check values recorded for the driver tables at sf0.01."""
    from __spark_entry__ import queries
    from datasets import SF_MID
    q = queries()
    b = q["counterfactual_bound_since_2001"](spark, SF_MID).first()
    assert (b.exposed, b.recovered, b.non_returners) == (169, 1.91, 396)
    e = {r.delivery_bucket: (r.customers, r.returners) for r in q["delivery_return_rate_since_2001"](spark, SF_MID).collect()}
    assert e == {"late": (169, 69), "not_late": (510, 214)}
    d = q["delay_distribution"](spark, SF_MID).first()
    assert (d.min_delay, d.max_delay, d.avg_delay, d.p25, d.median, d.p75, d.p90) == (-21, 8, -6.6, -14.0, -7.0, 1.0, 5.0)
    assert q["revenue_item_grain"](spark, SF_MID).first().revenue_right == D("3184780406.63")
    assert q["revenue_fanned_out"](spark, SF_MID).first().revenue_wrong == D("4249257683.25")
    assert q["itemless_orders"](spark, SF_MID).first().orphan_count == 257
    assert q["null_category_revenue"](spark, SF_MID).first().null_revenue == D("116625000.12")


def test_small_base_mask_and_trim(fx):
    g = ser.small_base_flag(ser.monthly_growth(fx["orders"], fx["items"]), floor=40)
    r = {x.month.month: (x.small_base, x.mom_growth_pct) for x in g.collect()}
    assert r == {2: (False, None), 3: (True, None)}          # 33.00 base is below 40: masked
    before = ser.monthly_growth(fx["orders"], fx["items"], trim=("2018-03-01 00:00:00", "2018-04-01 00:00:00", "before"))
    after = ser.monthly_growth(fx["orders"], fx["items"], trim=("2018-03-01 00:00:00", "2018-04-01 00:00:00", "after"))
    # trimming first hides February from LAG; trimming last keeps it as the base
    assert before.first().previous_month_revenue is None
    assert after.first().previous_month_revenue == D("33.00")


def test_region_gap_and_tiers(fx, spark):
    s = spark.createDataFrame(
        [("North", "late", 10, 1), ("North", "not_late", 30, 6), ("South", "not_late", 5, 1)],
        "region string, delivery_bucket string, customers long, returners long")
    g = {r.region: (r.not_late_pct, r.late_pct, r.gap, r.late_worse, r.late_customers)
         for r in ret.stratum_gap(s).collect()}
    assert g["North"] == (20.0, 10.0, 10.0, True, 10)
    assert g["South"] == (20.0, None, None, None, 0)
    one = {r.spend_quartile: r.one_time_pct for r in ret.one_time_within_tier(
        fx["customers"], fx["orders"], fx["items"], n=2).collect()}
    assert one == {1: 0.0, 2: 100.0}


def test_undelivered_kept_by_status(fx):
    u = {r.order_status: (r.orders, r.undelivered) for r in qa.undelivered_preserved(fx["orders"]).collect()}
    assert u == {"canceled": (2, 2), "delivered": (3, 0)}
    e = dlv.early_share(fx["orders"]).first()
    assert (e.delivered, e.early) == (3, 1)


def test_first_order_spend_basis(fx):
    r = {x.spend_quartile: x.customers for x in ret.tier_return_rate(
        fx["customers"], fx["orders"], fx["items"], n=3, spend_basis="first_order").collect()}
    assert r == {1: 1, 2: 1, 3: 1}


def test_hot_person_holds_a_third_of_orders(spark):
    """One person with a third of all orders: exposure/return and spend tiers
    equal a brute-force computation (no capping, no sampling)."""
    n = 3000
    orders = spark.range(n).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 401).cast("string")).alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.expr("timestamp_ntz'2018-01-01 00:00:00' + make_dt_interval(0, CAST(id % 500 AS INT))")
         .alias("order_purchase_timestamp"),
        F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE timestamp_ntz'2018-03-01 00:00:00' + "
               "make_dt_interval(CAST(id % 11 AS INT)) END").alias("order_delivered_customer_date"),
        F.expr("timestamp_ntz'2018-03-06 00:00:00'").alias("order_estimated_delivery_date"))
    customers = orders.select("customer_id").distinct().select(
        "customer_id", F.col("customer_id").alias("customer_unique_id"), F.lit("SP").alias("customer_state"))
    items = orders.select("order_id", F.lit("p").alias("product_id"), F.lit("s").alias("seller_id"),
                          F.lit(D("1.00")).cast("decimal(18,2)").alias("price"),
                          (F.col("order_id").cast("int") % 5).cast("decimal(18,2)").alias("freight_value"))
    # brute force in Python
    o = orders.collect()
    per = {}
    for r in o:
        per.setdefault(r.customer_id, []).append(r)
    want = {}
    for cid, rs in per.items():
        d = sorted([r for r in rs if r.order_delivered_customer_date is not None],
                   key=lambda r: (r.order_purchase_timestamp, r.order_id))
        if not d:
            continue
        first = d[0]
        delay = (first.order_delivered_customer_date.date() - first.order_estimated_delivery_date.date()).days
        b = "late" if delay > 0 else "not_late"
        c, ret_ = want.get(b, (0, 0))
        want[b] = (c + 1, ret_ + (1 if len(rs) >= 2 else 0))
    got = {r.delivery_bucket: (r.customers, r.returners) for r in ret.exposure_rate(customers, orders).collect()}
    assert got == want
    tiers = {r.spend_quartile: r.customers for r in cust.spend_tiers(customers, orders, items, 4).collect()}
    assert sum(tiers.values()) == len(per) and max(tiers.values()) - min(tiers.values()) <= 1


@pytest.mark.parametrize("key,col,n", [("seller_decile_share", "pct_of_total", 10),
                                       ("spend_quartiles", "pct_of_revenue", 4),
                                       ("repeat_buyers", "pct_of_customers", 2),
                                       ("repeat_buyers", "pct_of_revenue", 2)])
def test_shares_sum_to_100(spark, key, col, n):
    from __spark_entry__ import queries
    from datasets import SF_MID
    vals = [r[col] for r in queries()[key](spark, SF_MID).collect()]
    assert len(vals) <= n and abs(sum(vals) - 100) <= 0.005 * n + 1e-9


def test_exposure_partitions_persons_with_a_delivery(spark):
    from __spark_entry__ import queries
    from datasets import SF_MID
    q = queries()
    persons = q["first_delivered_order"](spark, SF_MID).count()
    e = q["delivery_return_rate"](spark, SF_MID).collect()
    assert sum(r.customers for r in e) == persons
    cells = q["state_cell_sizes"](spark, SF_MID).collect()
    assert sum(r.first_orders for r in cells) == persons


def test_delay_distribution_approx_option(spark):
    from datasets import SF_MID
    from tidemark.sources.tpch import tpch_tables
    t = tpch_tables(spark, SF_MID)
    exact = dlv.delay_distribution(t.orders).first()
    approx = dlv.delay_distribution(t.orders, exact=False).first()
    assert (approx.min_delay, approx.max_delay, approx.avg_delay) == (exact.min_delay, exact.max_delay, exact.avg_delay)
    # whole-day delays: the approximate quantiles are actual values within a day of the interpolated ones
    for q in ("p25", "median", "p75", "p90"):
        assert abs(approx[q] - exact[q]) <= 1.0
