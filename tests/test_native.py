"""Raw CSV exports in the canonical schema → silver Parquet → all analyses."""

import os

import pytest

from tidemark.plans.analyses import NATIVE_PARAMS, analyses
from tidemark.sources.native import build_silver, native_tables

RAW = {
    "orders": (
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,c1,canceled,2017-01-05 10:00:00,,,,2017-01-20 00:00:00\n"
        "o2,c2,delivered,2017-02-01 09:00:00,2017-02-01 10:00:00,2017-02-03 10:00:00,"
        "2017-02-10 15:00:00,2017-02-15 00:00:00\n"
        "o3,c3,delivered,2018-03-01 08:00:00,,,2018-03-20 10:00:00,2018-03-10 00:00:00\n"
        "o4,c4,delivered,2018-03-05 08:00:00,,,2018-03-05 12:00:00,2018-03-07 00:00:00\n"),
    "order_items": (
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o2,1,p1,s1,2017-02-05 00:00:00,30000.00,10.00\n"
        "o2,2,p2,s2,2017-02-05 00:00:00,20.00,2.00\n"
        "o3,1,p1,s1,2018-03-05 00:00:00,90000.00,0.50\n"
        "o4,1,p3,s3,2018-03-06 00:00:00,7.00,0.70\n"),
    "order_payments": (
        "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
        "o2,1,credit_card,1,20000.00\no2,2,voucher,1,10032.00\no3,1,boleto,1,90000.50\n"
        "o4,1,credit_card,2,7.70\n"),
    "order_reviews": (
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        "r2,o2,5,,,2017-02-11 00:00:00,2017-02-12 00:00:00\n"
        'r3,o3,2,late,"arrived\nlate",2018-03-21 00:00:00,\n'),
    "products": (
        "product_id,product_category_name,product_name_lenght,product_description_lenght,"
        "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
        "p1,beleza,40,287,1,225,16,10,14\np2,,,,,,,,\np3,moveis,10,20,1,1000,30,30,30\n"),
    "customers": (
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        "c1,u1,01151,sao paulo,SP\nc2,u1,01151,sao paulo,SP\nc3,u2,69005,manaus,AM\n"
        "c4,u3,88000,florianopolis,SC\n"),
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01001,sao paulo,SP\n",
    "geolocation": (
        "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
        "01001,-23.55,-46.63,sao paulo,SP\n01001,-23.54,-46.64,são paulo,SP\n69005,-3.10,-60.02,manaus,AM\n"),
    "category_translation": "product_category_name,product_category_name_english\nbeleza,health_beauty\n",
}


@pytest.fixture(scope="module")
def native(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("native")
    raw = os.path.join(root, "raw")
    os.makedirs(raw)
    for t, text in RAW.items():
        with open(os.path.join(raw, f"{t}.csv"), "w") as f:
            f.write(text)
    counts = build_silver(spark, raw, os.path.join(root, "silver"), partition_orders_by_month=True)
    return counts, native_tables(spark, os.path.join(root, "silver"))


def test_load_counts(native):
    counts, _ = native
    got = {r.tbl: r["count"] for r in counts.collect()}
    assert got["orders"] == 4 and got["geolocation"] == 3 and got["order_reviews"] == 2


def test_every_analysis_runs_on_native_silver(native):
    _, t = native
    for name, fn in analyses(NATIVE_PARAMS).items():
        fn(t).collect()


def test_native_headlines(native):
    _, t = native
    a = analyses(NATIVE_PARAMS)
    geo = {r.geolocation_zip_code_prefix: r for r in t.geolocation.collect()}
    assert set(geo) == {"01001", "69005"} and geo["01001"].geolocation_city == "sao paulo"
    rates = {(r.region, r.delivery_bucket): r.customers for r in a["region_return_rate"](t).collect()}
    assert rates == {("Southeast", "not_late"): 1, ("North", "late"): 1, ("South", "not_late"): 1}
    pg = a["platform_growth"](t).first()
    assert str(pg.total_2017) == "30010.00" and str(pg.total_2018) == "90008.20"
    shift = {r.product_category_name: r.share_trend for r in a["category_share_shift"](t).collect()}
    # beleza grows 199.90% while the platform grows 199.93% (moveis has no 2017 base)
    assert shift == {"beleza": "losing share"}


def test_report_writes_every_result(spark, native, tmp_path):
    from tidemark.plans.report import run_report
    _, t = native
    out = str(tmp_path / "report")
    names = run_report(t, out)
    assert "counterfactual_bound" in names and len(names) == len(analyses(NATIVE_PARAMS))
    assert spark.read.parquet(f"{out}/counterfactual_bound").count() == 1


def test_bucketed_silver_avoids_order_shuffles(spark, tmp_path):
    import contextlib
    import io

    from tidemark.sources.native import catalog_tables
    raw = tmp_path / "raw"
    raw.mkdir()
    for t, text in RAW.items():
        (raw / f"{t}.csv").write_text(text)
    build_silver(spark, str(raw), str(tmp_path / "silver"), buckets=4, database="tidemark_bucketed_test")
    t = catalog_tables(spark, "tidemark_bucketed_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = analyses(NATIVE_PARAMS)["monthly_growth"](t)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        assert "Exchange hashpartitioning(order_id" not in buf.getvalue()
        native_rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(native_rows) == 2
