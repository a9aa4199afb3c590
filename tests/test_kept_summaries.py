"""Dense calendars, delay summaries, digests of ranges, sketches, items by month."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from tidemark.operators import delivery as dlv
from tidemark.operators import growth as grw
from tidemark.operators import quality as qa
from tidemark.operators import series as ser
from tidemark.operators import sketches as sk
from tidemark.operators.digests import changed_rows, compare_ranges, range_digests
from tidemark.sources.tpch import tpch_tables

ORDERS = "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz"
ITEMS = "order_id string, product_id string, price decimal(18,2), freight_value decimal(18,2)"


def _day(y, m, d=5):
    return dt.datetime(y, m, d, 10)


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.createDataFrame([("a", "1", _day(2017, 1)), ("b", "2", _day(2017, 1, 31)), ("c", "1", _day(2017, 4)),
                                    ("d", "3", _day(2017, 5)), ("e", "3", None)], ORDERS)
    items = spark.createDataFrame([(o, p, Decimal(v), Decimal(0)) for o, p, v in [
        ("a", "x", 10), ("b", "x", 20), ("b", "y", 5), ("c", "x", 60), ("d", "y", 30), ("e", "x", 7), ("lost", "x", 9)]], ITEMS)
    return orders, items


def test_dense_calendar_fills_skipped_months(shop):
    orders, items = shop
    known = orders.where("order_purchase_timestamp IS NOT NULL")
    got = [(r.month.month, r.monthly_volume, r.revenue, r.previous_month_revenue, r.mom_growth_pct)
           for r in ser.monthly_growth(known, items, dense=True).collect()]
    assert got == [(1, 2, 35, None, None), (2, 0, 0, 35, -100.0), (3, 0, 0, 0, None), (4, 1, 60, 0, None), (5, 1, 30, 60, -50.0)]
    assert [r.month.month for r in ser.monthly_growth(known, items).collect()] == [1, 4, 5]
    average = ser.moving_average(known, items, 3, dense=True).collect()
    assert [r.revenue_3month_moving_avg for r in average] == [35.0, 17.5, 35 / 3, 20.0, 30.0]
    assert [r.running_total_revenue for r in ser.running_total(known, items, dense=True).collect()] == [35, 35, 35, 95, 125]


def test_dense_calendar_by_group_and_empty(spark, shop):
    s = spark.createDataFrame([("p", dt.date(2017, 11, 1), 1, "k"), ("p", dt.date(2018, 2, 1), 2, "l"), (None, dt.date(2018, 1, 1), 3, "m")],
                              "who string, month date, n int, note string")
    got = {(r.who, str(r.month), r.n, r.note) for r in ser.dense_months(s, ["n"], ["who"]).collect()}
    assert got == {("p", "2017-11-01", 1, "k"), ("p", "2017-12-01", 0, None), ("p", "2018-01-01", 0, None),
                   ("p", "2018-02-01", 2, "l"), (None, "2018-01-01", 3, "m")}
    assert ser.dense_months(s.limit(0), ["n"]).count() == 0
    orders, items = shop
    idle = {r.product_id: (r.months, r.idle_months, r.longest_idle)
            for r in ser.idle_months(orders.where("order_purchase_timestamp IS NOT NULL"), items, "product_id").collect()}
    assert idle == {"x": (4, 2, 2), "y": (5, 3, 3)}


def test_idle_months_makes_no_rows_for_months_without_sales(spark, monkeypatch):
    sales = {"x": ["1931-05-09", "2017-01-31", "2017-01-02", "2017-04-01"], "y": [None, "1975-04-30", "1975-05-01"],
             None: ["1969-12-31", "1970-01-01", "1970-03-01"], "z": [None], "w": ["1975-04-01", "1980-09-01"]}
    rows = [(p, d) for p, days in sales.items() for d in days]
    orders = spark.createDataFrame([(k, d) for k, (_, d) in enumerate(rows)], "order_id long, d string").select(
        "order_id", F.to_timestamp_ntz("d").alias("order_purchase_timestamp"))
    items = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(rows)], "order_id long, product_id string")
    monkeypatch.setattr(ser, "ROWS_PER_TASK", 1)
    idle = ser.idle_months(orders, items, "product_id")
    plan = idle._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for a month without sales
    assert re.search(rf"hashpartitioning\(order_id#\d+L, {len(rows)}\)", plan)  # tasks by the items' number
    got = {r.product_id: (str(r.first_month)[:7], str(r.last_month)[:7], r.months, r.idle_months, r.longest_idle) for r in idle.collect()}
    assert got == {"x": ("1931-05", "2017-04", 1032, 1029, 1027), "y": ("1975-04", "1975-05", 2, 0, 0),
                   None: ("1969-12", "1970-03", 4, 1, 1), "w": ("1975-04", "1980-09", 66, 64, 64)}


def _delays(spark, rows):
    return spark.createDataFrame(rows, "order_id int, order_purchase_timestamp timestamp_ntz, "
                                       "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")


def test_delay_summary_equals_percentile_and_a_month_can_be_replaced(spark, scratch):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        bought = dt.datetime(2017, 1 + k % 3, 1 + rng.randrange(28))
        due = None if k % 50 == 0 else bought + dt.timedelta(20)
        rows.append((k, bought, None if k % 9 == 0 else bought + dt.timedelta(rng.randrange(40)), due))
    orders = _delays(spark, rows)
    expected = dlv.delay_distribution(orders).collect()
    assert dlv.summary_distribution(dlv.delay_summary(orders)).collect() == expected
    path, february = f"{scratch}/delays", F.month("order_purchase_timestamp") == 2
    dlv.write_delay_summary(dlv.delay_summary(orders.where(~february | (F.col("order_id") < 100))), path)
    kept = dlv.read_delay_summary(spark, path)
    assert dlv.summary_distribution(kept).collect() != expected
    for _ in range(2):  # a repeated run changes nothing
        dlv.write_delay_summary(dlv.delay_summary(orders.where(february)), path)
        rebuilt = sorted(map(tuple, dlv.delay_summary(orders).collect()), key=str)
        kept = dlv.read_delay_summary(spark, path)
        assert sorted(map(tuple, kept.collect()), key=str) == rebuilt
    assert dlv.summary_distribution(kept).collect() == expected
    one = dlv.read_delay_summary(spark, path, ["2017-02"])
    assert dlv.summary_distribution(one).collect() == dlv.delay_distribution(orders.where(february)).collect()
    by_month = {r.month.month: tuple(r)[1:] for r in dlv.summary_distribution(kept, ["month"]).collect()}
    for m in (1, 2, 3):
        assert by_month[m] == tuple(dlv.delay_distribution(orders.where(F.month("order_purchase_timestamp") == m)).first())


def test_delay_summary_of_nothing(spark):
    none = dlv.delay_summary(_delays(spark, []))
    assert tuple(dlv.summary_distribution(none).first()) == (None,) * 7
    assert dlv.summary_distribution(none, ["month"]).count() == 0


def test_digests_locate_planted_changes(spark):
    a = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 50).alias("v"),
                                 F.when(F.col("id") % 3 != 0, F.lit("t")).alias("w"))
    bucket = F.pmod(F.xxhash64("k"), F.lit(64))
    b = (a.where("k != '17'").withColumn("v", F.when(F.col("k") == "40", -1).otherwise(F.col("v")))
         .withColumn("w", F.when(F.col("k") == "41", F.lit(None)).otherwise(F.col("w")))
         .unionByName(spark.createDataFrame([("new", 1, None)], a.schema)))
    b = b.unionByName(b.where("k = '99'")).repartition(5)  # a repeated row
    got = {tuple(r) for r in changed_rows(a, b, "k", bucket).collect()}
    assert got == {("17", "removed"), ("40", "changed"), ("41", "changed"), ("new", "added"), ("99", "changed")}
    ranges = compare_ranges(range_digests(a, bucket), range_digests(b, bucket)).collect()
    assert len(ranges) == 64 and 1 <= sum(not r.same for r in ranges) <= 5
    assert changed_rows(a, a.repartition(3), "k", bucket).count() == 0
    assert changed_rows(a.limit(0), a.limit(0), "k", bucket).count() == 0


def test_digests_tell_nulls_apart(spark):
    schema = "k int, x string, y string"
    a = spark.createDataFrame([(1, "s", None), (2, None, None)], schema)
    b = spark.createDataFrame([(1, None, "s"), (2, None, None)], schema)
    assert [tuple(r) for r in changed_rows(a, b, "k", F.lit(0)).collect()] == [(1, "changed")]
    swapped = spark.createDataFrame([(2, "s", None), (1, None, None)], schema)  # whole rows, the key in the hash
    assert {r.k for r in changed_rows(a, swapped, "k", F.lit(None).cast("int")).collect()} == {1, 2}


@pytest.mark.parametrize("n", [500, 20_000, 200_000])
def test_sketch_errors_at_three_scales(spark, n):
    customers = spark.range(n).select(F.col("id").alias("customer_id"), (F.col("id") - F.col("id") % 2).alias("customer_unique_id"))
    orders = spark.range(n).select(
        F.col("id").alias("order_id"), F.col("id").alias("customer_id"),
        F.expr("timestamp_ntz'2017-01-03 00:00:00' + make_interval(0, cast(id % 6 as int))").alias("order_purchase_timestamp"))
    items = spark.range(n).where("id % 5 != 0").select(F.col("id").alias("order_id"))
    lg = 12
    exact = qa.staged_counts(customers, orders, items)
    assert {r.stage: (r.persons, r.orders) for r in exact.collect()}["reachable"] == (n // 2, n)
    estimated = sk.staged(sk.monthly_sketches(customers, orders, items, lg), lg)
    errors = sk.staged_errors(estimated, exact, lg, deviations=4).collect()
    assert len(errors) == 3 and all(r.persons_within and r.orders_within for r in errors)
    if n <= 2 ** lg:  # exact there
        assert sorted(map(tuple, estimated.collect())) == sorted(map(tuple, exact.collect()))


def test_sketches_of_nothing(spark):
    empty = spark.createDataFrame([], "customer_id int, customer_unique_id int")
    orders = spark.createDataFrame([], "order_id int, customer_id int, order_purchase_timestamp timestamp_ntz")
    assert sk.monthly_sketches(empty, orders, orders.select("order_id")).count() == 0


def test_items_by_month_read_only_the_window(spark, scratch):
    t, path = tpch_tables(spark, SF_SMALL), f"{scratch}/items"
    grw.write_items_by_month(t.orders, t.items, path)
    items = grw.read_items_by_month(spark, path, t.items.schema)
    assert items.count() == t.items.count()
    window = items.where(F.col(grw.IN_MONTH).isin("2000-01", "2000-02"))
    assert {f.split(f"{grw.IN_MONTH}=")[1][:7] for f in (r[0] for r in window.select(F.input_file_name()).distinct().collect())} \
        == {"2000-01", "2000-02"}
    cy = grw.category_years_by_month(items, t.products, 2000, 2001, (1, 7))
    plan = cy._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [purchase_month#" in plan and "SortMergeJoin [order_id" not in plan
    want = grw.category_years(t.orders, t.items, t.products, 2000, 2001, (1, 7))
    assert sorted(map(tuple, cy.collect())) == sorted(map(tuple, want.collect()))


def test_items_by_month_replaces_single_months(spark, scratch, shop):
    orders, items = shop
    path = f"{scratch}/items"
    grw.write_items_by_month(orders, items, path)
    kept = {(r.order_id, r.product_id, r.purchase_month) for r in grw.read_items_by_month(spark, path, items.schema).collect()}
    assert ("e", "x", "none") in kept and ("lost", "x", "none") in kept and ("c", "x", "2017-04") in kept
    april = orders.where("order_id = 'c'")
    grw.write_items_by_month(april, items.where("order_id = 'c'").withColumn("price", (F.col("price") + 1).cast("decimal(18,2)")), path)
    again = grw.read_items_by_month(spark, path, items.schema)
    assert again.count() == len(kept)
    assert again.where("order_id = 'c'").first().price == 61


def test_staged_counts_and_identities_plan_one_join(spark):
    customers = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, None, 11)], "customer_id int, customer_unique_id int, pair int")
    orders = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (None, 3)], "order_id int, customer_id int")
    items = spark.createDataFrame([(1,), (1,), (9,)], "order_id int")
    staged = qa.staged_counts(customers, orders, items)
    assert [tuple(r) for r in staged.collect()] == [("reachable", 1, 3), ("with_items", 1, 1), ("gap", 0, 2)]
    trap = qa.identity_trap(customers, orders, ("customer_id", "customer_unique_id"))
    assert [tuple(r) for r in trap.collect()] == [("customer_id", 3, 0, 0.0), ("customer_unique_id", 2, 1, 50.0)]
    for df, joins in ((staged, 2), (trap, 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == joins and plan.count("Expand ") == 1
    none = qa.identity_trap(customers.limit(0), orders, ("customer_id",)).collect()
    assert [tuple(r) for r in none] == [("customer_id", 0, None, None)]
