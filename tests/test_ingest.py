"""Raw CSV → bronze → silver, the sink, and the streaming ingest."""

import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql.utils import AnalysisException  # noqa: F401

from tidemark.sources.bronze import read_bronze, row_counts
from tidemark.sources.silver import silver, write_silver
from tidemark.streaming import stream_to_silver

ORDERS_CSV = (
    "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
    "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,2017-10-04 19:55:00,"
    "2017-10-10 21:25:13,2017-10-18 00:00:00\n"
    "o2,c2,canceled,2017-11-01 08:00:00,,,,2017-11-20 00:00:00\n"
    'o3,c3,shipped,2017-11-02 08:00:00,"","",  ,2017-11-22 00:00:00\n'
)

REVIEWS_CSV = (
    "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    'r1,o1,4,,"line one\nline ""two""",2017-10-11 00:00:00,2017-10-12 10:00:00\n'
    "r2,o2,1,bad,,,\n"
)

CUSTOMERS_CSV = (
    "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
    "c1,u1,01151,sao paulo,SP\n"
)

PRODUCTS_CSV = (
    "product_id,product_category_name,product_name_lenght,product_description_lenght,"
    "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
    "p1,beleza,40,287,1,225,16,10,14\n"
    "p2,,,,,,,,\n"
)


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_blank_dates_become_null(spark, scratch):
    b = read_bronze(spark, _write(scratch, "orders.csv", ORDERS_CSV), "orders")
    assert all(f.dataType.simpleString() == "string" for f in b.schema.fields)
    s = silver("orders", b)
    got = {r.order_id: r.order_delivered_customer_date for r in s.collect()}
    assert got["o2"] is None and got["o3"] is None and got["o1"] is not None
    assert dict(s.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"


def test_multiline_review_and_quotes(spark, scratch):
    b = read_bronze(spark, _write(scratch, "reviews.csv", REVIEWS_CSV), "order_reviews")
    r = {x.review_id: x for x in silver("order_reviews", b).collect()}
    assert r["r1"].review_comment_message == 'line one\nline "two"'
    assert r["r2"].review_creation_date is None and r["r2"].review_score == 1


def test_zip_prefix_keeps_leading_zero(spark, scratch):
    b = read_bronze(spark, _write(scratch, "customers.csv", CUSTOMERS_CSV), "customers")
    assert silver("customers", b).first().customer_zip_code_prefix == "01151"


def test_blank_category_is_null_and_guarded_numbers(spark, scratch):
    b = read_bronze(spark, _write(scratch, "products.csv", PRODUCTS_CSV), "products")
    r = {x.product_id: x for x in silver("products", b).collect()}
    assert r["p2"].product_category_name is None and r["p2"].product_weight_g is None
    assert r["p1"].product_name_lenght == 40


def test_strict_cast_fails_and_reject_mode(spark, scratch):
    bad = ORDERS_CSV + "o4,c4,delivered,not-a-date,,,,2017-11-22 00:00:00\n"
    b = read_bronze(spark, _write(scratch, "orders_bad.csv", bad), "orders")
    with pytest.raises(PySparkException):
        silver("orders", b).collect()
    good, rejects = silver("orders", b, reject=True)
    assert [r.order_id for r in rejects.collect()] == ["o4"]
    assert sorted(r.order_id for r in good.collect()) == ["o1", "o2", "o3"]


def test_row_counts_and_sink(spark, scratch):
    b = read_bronze(spark, _write(scratch, "orders.csv", ORDERS_CSV), "orders")
    rc = {r.tbl: r["count"] for r in row_counts({"orders": b, "customers": read_bronze(
        spark, _write(scratch, "c.csv", CUSTOMERS_CSV), "customers")}).collect()}
    assert rc == {"orders": 3, "customers": 1}
    out = os.path.join(scratch, "silver_orders")
    write_silver(silver("orders", b), out)
    assert spark.read.parquet(out).count() == 3


def test_streaming_ingest(spark, scratch):
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    _write(landing, "orders-1.csv", ORDERS_CSV)
    out = os.path.join(scratch, "silver")
    ckpt = os.path.join(scratch, "ckpt")
    for q in stream_to_silver(spark, landing, "orders", out, checkpoint=ckpt):
        q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    # a second file is picked up incrementally; the first is not re-read
    _write(landing, "orders-2.csv", ORDERS_CSV.split("\n", 1)[0] + "\n"
           "o9,c9,delivered,2018-01-01 00:00:00,,,,2018-01-20 00:00:00\n")
    for q in stream_to_silver(spark, landing, "orders", out, checkpoint=ckpt):
        q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 4
    assert got.where("order_id = 'o9'").first().order_delivered_customer_date is None


def test_streaming_rejects_go_to_their_own_sink(spark, scratch):
    landing = os.path.join(scratch, "landing_r")
    os.makedirs(landing)
    _write(landing, "orders-bad.csv", ORDERS_CSV + "o4,c4,delivered,not-a-date,,,,2017-11-22 00:00:00\n")
    out, rej = os.path.join(scratch, "silver_r"), os.path.join(scratch, "rejects_r")
    for q in stream_to_silver(spark, landing, "orders", out, checkpoint=os.path.join(scratch, "ck_r"),
                              reject_dir=rej):
        q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    assert [r.order_id for r in spark.read.parquet(rej).collect()] == ["o4"]


def test_read_all_with_custom_file_names(spark, scratch):
    from tidemark.sources.bronze import read_bronze_all
    _write(scratch, "export_orders_2018.csv", ORDERS_CSV)
    _write(scratch, "export_customers.csv", CUSTOMERS_CSV)
    t = read_bronze_all(spark, scratch, {"orders": "export_orders_2018.csv", "customers": "export_customers.csv"})
    assert set(t) == {"orders", "customers"} and t["orders"].count() == 3 and t["customers"].count() == 1


ITEMS_HEAD = "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"


def test_header_in_another_order_fails(spark, scratch):
    swapped = "customer_unique_id,customer_id,customer_zip_code_prefix,customer_city,customer_state\nP1,R1,01001,x,SP\n"
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_bronze(spark, _write(scratch, "swapped.csv", swapped), "customers").collect()


def test_row_with_too_many_fields_fails(spark, scratch):
    text = ITEMS_HEAD + "o1,1,p1,s1,2018-01-01 00:00:00,extra,10.00,2.00\n"
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_bronze(spark, _write(scratch, "ragged.csv", text), "order_items").collect()


@pytest.mark.parametrize("price", ["", '""', "10.999", "abc"])
def test_strict_price_fails_or_is_rejected(spark, scratch, price):
    text = ITEMS_HEAD + f"o1,1,p1,s1,2018-01-01 00:00:00,{price},2.00\no2,1,p1,s1,2018-01-01 00:00:00,10.90,2.00\n"
    b = read_bronze(spark, _write(scratch, "items.csv", text), "order_items")
    with pytest.raises(PySparkException):
        silver("order_items", b).collect()
    good, rejects = silver("order_items", b, reject=True)
    assert [r.order_id for r in good.collect()] == ["o2"] and [r.order_id for r in rejects.collect()] == ["o1"]


def test_stream_rejects_ragged_rows(spark, scratch):
    landing = os.path.join(scratch, "landing_ragged")
    os.makedirs(landing)
    _write(landing, "items.csv", ITEMS_HEAD + "o1,1,p1,s1,2018-01-01 00:00:00,extra,10.00,2.00\n"
           "o2,1,p1,s1,2018-01-01 00:00:00,10.90,2.00\n")
    out, rej = os.path.join(scratch, "out_ragged"), os.path.join(scratch, "rej_ragged")
    for q in stream_to_silver(spark, landing, "order_items", out, checkpoint=os.path.join(scratch, "ck_ragged"), reject_dir=rej):
        q.awaitTermination(120)
    assert [r.order_id for r in spark.read.parquet(out).collect()] == ["o2"]
    assert [r.order_id for r in spark.read.parquet(rej).collect()] == ["o1"]


def test_default_stream_checkpoint_is_the_same_in_every_session(spark, scratch):
    """Progress lies under the configured folder, not under a session's own."""
    from tidemark.session import shared_dir
    landing, out = os.path.join(scratch, "landing_twice"), os.path.join(scratch, "out_twice")
    os.makedirs(landing)
    _write(landing, "a.csv", ORDERS_CSV)
    for q in stream_to_silver(spark, landing, "orders", out):
        q.awaitTermination(120)
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(os.path.join(scratch, "another"))  # what a new session does
    _write(landing, "b.csv", ORDERS_CSV.replace("o1,", "n1,").replace("o2,", "n2,").replace("o3,", "n3,"))
    for q in stream_to_silver(spark, landing, "orders", out):
        q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 6 and shared_dir(spark) == shared_dir(spark.newSession())
    if before:
        spark.sparkContext.setCheckpointDir(before)


def test_queries_see_files_added_to_a_folder(spark, scratch):
    from tidemark.plans import build_queries
    src = "/root/testdata/sf0.001"
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem"):
        os.symlink(f"{src}/{name}.parquet", os.path.join(scratch, f"{name}.parquet"))
    orders = os.path.join(scratch, "orders.parquet")
    spark.read.parquet(f"{src}/orders.parquet").coalesce(1).write.parquet(orders)
    count = build_queries()["row_counts"]
    first = {r.tbl: r["count"] for r in count(spark, scratch).collect()}["orders"]
    spark.read.parquet(f"{src}/orders.parquet").coalesce(1).write.mode("append").parquet(orders)
    assert {r.tbl: r["count"] for r in count(spark, scratch).collect()}["orders"] == 2 * first
