"""Binding of the driver's TPC-H-style tables to the canonical retail shape.

Only projections and derived columns — Catalyst prunes unused columns and
pushes filters through them into the Parquet scans.  Derived values
(delivery/estimated dates, payments, reviews, NULL category) come from key
arithmetic so both the Spark plans and the SQL oracle see the same rows:

* order = TPC-H order; purchase = ``o_orderdate``; delivered =
  purchase + (key mod 30) days, NULL for status ``P``; estimated =
  purchase + 21 days;
* item revenue: price = ``l_extendedprice``, freight = ``l_quantity`` (both
  decimal(18,2)); seller = supplier; product = part;
* category = ``p_brand`` with ``Brand#11`` standing in for the NULL bucket;
* state = nation name, macro-region = region name;
  ``paired_id`` (two customer records per person) drives the identity check;
* payments: one per order, a second when key mod 3 = 0;
  reviews: one per order, created purchase + (key mod 41) days, with quotes and
  line ends in the message; measures of products and coordinates from keys and sizes;
* geolocation points: customers with nation as the zip prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


class Tables:
    """Canonical retail tables (silver shape, canonical column names).

    Each table is built on first use, so a query plans only the scans it
    needs.  Attributes: orders, items, payments, reviews, products,
    customers, sellers, geolocation, translation, region_map (the last one
    is small, bounded by the number of states).
    """

    NAMES = ("orders", "items", "payments", "reviews", "products", "customers", "sellers",
             "geolocation", "translation", "region_map")

    def __init__(self, builders: dict):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        builders = self.__dict__.get("_builders", {})
        if name not in builders:
            raise AttributeError(name)
        built = self.__dict__["_built"]
        if name not in built:
            built[name] = builders[name]()
        return built[name]

    def replace(self, **overrides) -> "Tables":
        """Same tables with some replaced by functions of the originals."""
        b = dict(self._builders)
        for name, fn in overrides.items():
            b[name] = (lambda f=fn, n=name: f(getattr(self, n)))
        return Tables(b)


_SCHEMAS: dict[tuple, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table.  Footers are read for its schema only if the path's
    status (time, length) isn't the one seen before; files are listed each time."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at)
    seen = (path, status.getModificationTime(), status.getLen())
    if seen not in _SCHEMAS:
        _SCHEMAS[seen] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[seen]).parquet(path)


def tpch_tables(spark: SparkSession, sf_dir: str) -> Tables:
    cache: dict[str, DataFrame] = {}

    def r(n: str) -> DataFrame:
        if n not in cache:
            cache[n] = read_table(spark, sf_dir, n)
        return cache[n]

    def orders():
        return r("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL "
                   "ELSE o_orderdate + (o_orderkey % 30) * INTERVAL '1' DAY END")
             .alias("order_delivered_customer_date"),
            F.expr("o_orderdate + INTERVAL '21' DAY").alias("order_estimated_delivery_date"),
            F.expr("o_orderdate + (o_orderkey % 3) * INTERVAL '1' DAY").alias("order_approved_at"),
            F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL "
                   "ELSE o_orderdate + (o_orderkey % 15) * INTERVAL '1' DAY END").alias("order_delivered_carrier_date"),
        )

    def items():
        return r("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
            F.col("l_quantity").cast("decimal(18,2)").alias("freight_value"),
        )

    def nation_region():
        n, rg = r("nation"), r("region")
        return n.join(F.broadcast(rg), n.n_regionkey == rg.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("customer_state"), F.col("r_name").alias("region"))

    def customers():
        c, nr = r("customer"), nation_region()
        # nation/region are fixed 25/5-row dimensions: a bounded broadcast.
        return c.join(F.broadcast(nr), c.c_nationkey == nr.n_nationkey).select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            (F.col("c_custkey") - F.col("c_custkey") % 2).alias("paired_id"),
            F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"),
            F.col("c_name").alias("customer_city"),
            "customer_state",
        )

    def products():
        return r("part").select(
            F.col("p_partkey").alias("product_id"),
            F.expr("NULLIF(p_brand, 'Brand#11')").alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.length("p_type").alias("product_description_lenght"),
            F.expr("NULLIF(p_size % 6, 0)").alias("product_photos_qty"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("product_weight_g"),
            F.col("p_size").cast("decimal(18,2)").alias("product_length_cm"),
            F.expr("CAST(NULLIF(p_size % 4, 0) AS decimal(18,2))").alias("product_height_cm"),
            F.expr("CAST(p_size + 1 AS decimal(18,2))").alias("product_width_cm"),
        )

    def payments():
        o = r("orders")
        # a derivation, not a subset: every order keeps its first payment row,
        # and every third order gets a second one (the multi-payment fan-out)
        held = [F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("payment_type"),
                (1 + F.col("o_orderkey") % 10).cast("int").alias("payment_installments"),
                F.col("o_totalprice").cast("decimal(18,2)").alias("payment_value")]
        first_pay = o.select(*held, F.lit(1).alias("payment_sequential"))
        second_pay = o.where(F.col("o_orderkey") % 3 == 0).select(*held, F.lit(2).alias("payment_sequential"))
        return first_pay.unionByName(second_pay)

    def reviews():
        return r("orders").select(
            F.col("o_orderkey").alias("review_id"),
            F.col("o_orderkey").alias("order_id"),
            (F.lit(1) + (F.col("o_orderkey") % 7) % 5).cast("int").alias("review_score"),
            F.expr("o_orderdate + (o_orderkey % 41) * INTERVAL '1' DAY").alias("review_creation_date"),
            F.expr("'no. ' || (o_orderkey % 5)").alias("review_comment_title"),
            # quotes, commas and line ends, as free text has them
            F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit(' said "'), F.col("o_orderpriority"), F.lit('",\nthen \\ left ')))
             .alias("review_comment_message"),
            F.expr("CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + (o_orderkey % 41 + 1) * INTERVAL '1' DAY END")
             .alias("review_answer_timestamp"),
        )

    def sellers():
        s, n = r("supplier"), r("nation")
        return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"),
            F.col("s_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )

    def geolocation():
        return r("customer").select(
            F.col("c_nationkey").cast("string").alias("geolocation_zip_code_prefix"),
            F.col("c_acctbal").cast("decimal(18,2)").alias("geolocation_lat"),
            (F.col("c_custkey") % 360 - 180).cast("decimal(18,2)").alias("geolocation_lng"),
            F.col("c_name").alias("geolocation_city"),
            F.col("c_mktsegment").alias("geolocation_state"),
        )

    def translation():
        return (r("part").select(F.col("p_brand").alias("product_category_name")).distinct()
                .withColumn("product_category_name_english",
                            F.lower(F.regexp_replace("product_category_name", "#", "_"))))

    def region_map():
        return nation_region().select("customer_state", "region")

    return Tables(dict(orders=orders, items=items, payments=payments, reviews=reviews,
                       products=products, customers=customers, sellers=sellers,
                       geolocation=geolocation, translation=translation, region_map=region_map))
