"""The query catalogue: every operator bound to the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; nothing is
collected.  Parameters that stand in for the source analysis's choices on
this data (matched window, trustworthy window, floors) are fixed here once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import delivery as dlv
from tidemark.operators import growth as grw
from tidemark.operators import series as ser
from tidemark.operators.digests import changed_rows
from tidemark.plans.analyses import Params, analyses, retention_analyses
from tidemark.schema import BRONZE_COLUMNS
from tidemark.session import fresh_path
from tidemark.sources.bronze import read_bronze, row_counts, to_bronze, write_raw
from tidemark.sources.incremental import VERSION, apply_batch, current
from tidemark.sources.native import load_silver, native_tables
from tidemark.sources.silver import silver
from tidemark.sources.tpch import Tables, tpch_tables

# --- parameters of the analysis on the driver tables ---
TPCH_PARAMS = Params(
    year_a=2000, year_b=2001,            # matched-window years (data ends 2001-08-01)
    matched_months=(1, 7),               # Jan–Jul in both years
    share_floor=25000, small_base_floor=25000,
    trust_window=("1992-01-01 00:00:00", "2001-08-01 00:00:00"),  # drops the censored last month
    thin_floor=30, pareto_p=80,
    identity_keys=("customer_id", "paired_id"),   # record id vs two-records-per-person id
)
YEAR_A, YEAR_B = TPCH_PARAMS.year_a, TPCH_PARAMS.year_b
MATCHED_MONTHS = TPCH_PARAMS.matched_months
SHARE_FLOOR = TPCH_PARAMS.share_floor
SMALL_BASE_FLOOR = TPCH_PARAMS.small_base_floor
TRUST_WINDOW = TPCH_PARAMS.trust_window
THIN_FLOOR = TPCH_PARAMS.thin_floor
PARETO_P = TPCH_PARAMS.pareto_p
RETURN_SINCE = "2001-01-01 00:00:00"  # analysis window where return is not near-universal

# bronze/silver tables on the driver data: canonical name -> (binding attr, columns)
ATTRIBUTES = {"orders": "orders", "order_items": "items", "order_payments": "payments", "order_reviews": "reviews",
              "products": "products", "customers": "customers", "sellers": "sellers", "geolocation": "geolocation",
              "category_translation": "translation"}
BRONZE_TABLES: dict[str, tuple[str, list[str]]] = {t: (ATTRIBUTES[t], cols) for t, cols in BRONZE_COLUMNS.items()}


def bronze_of(t: Tables, table: str) -> DataFrame:
    attr, cols = BRONZE_TABLES[table]
    return to_bronze(getattr(t, attr).select(*cols))


def _since(t: Tables) -> Tables:
    """Same tables with orders restricted to purchases from RETURN_SINCE."""
    return t.replace(orders=lambda o: o.where(
        F.col("order_purchase_timestamp") >= F.lit(RETURN_SINCE).cast("timestamp_ntz")))


def _q(fn: Callable[[Tables], DataFrame], since: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tpch_tables(spark, sf_dir)
        return fn(_since(t) if since else t)
    run.__doc__ = fn.__doc__
    return run


def _bronze(table):
    """The raw CSV export of the table, read again."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_path(spark, f"raw-{table}")
        attr, cols = BRONZE_TABLES[table]
        write_raw(getattr(tpch_tables(spark, sf_dir), attr).select(*cols), path)
        raw = read_bronze(spark, path, table)
        return raw.select([F.coalesce(c, F.lit("")).alias(c) for c in raw.columns])
    return run


def export_raw(spark: SparkSession, sf_dir: str) -> str:
    """All nine raw CSV exports, in a folder of the application."""
    root, t = fresh_path(spark, "raw"), tpch_tables(spark, sf_dir)
    for table, (attr, cols) in BRONZE_TABLES.items():
        write_raw(getattr(t, attr).select(*cols), f"{root}/{table}.csv")
    return root


def load_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV exports loaded into silver; control totals as measured by the load."""
    return load_silver(spark, export_raw(spark, sf_dir), fresh_path(spark, "silver"))


def raw_to_category_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw CSV exports through silver to an answer."""
    silver_root = fresh_path(spark, "silver")
    load_silver(spark, export_raw(spark, sf_dir), silver_root)
    return analyses(TPCH_PARAMS)["category_pareto"](native_tables(spark, silver_root))


def silver_orders_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three deliveries: all of them, a correction of every third
    order's status, and the first delivery over again, which changes nothing."""
    path = fresh_path(spark, "silver-orders")
    first = bronze_of(tpch_tables(spark, sf_dir), "orders")
    fixed = first.where(F.col("order_id").cast("bigint") % 3 == 0).withColumn("order_status", F.lit("corrected"))
    for batch, (rows, version) in enumerate([(first, 1), (fixed, 2), (first, 1)]):
        apply_batch(rows.withColumn(VERSION, F.lit(version)), batch, "orders", path)
    return current(spark, path)


CHANGED_MONTH = "1997-03"  # in which located_changes plants its changes


def located_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose silver rows differ from an earlier version's: of one month,
    every seventh order is missing there, every eleventh has another status and
    every thirteenth isn't delivered yet.  Digests a month say where to look."""
    orders = silver("orders", bronze_of(tpch_tables(spark, sf_dir), "orders"))
    month = F.date_format("order_purchase_timestamp", "yyyy-MM")
    number, planted = F.col("order_id").cast("bigint"), month == CHANGED_MONTH
    earlier = (orders.where(~planted | (number % 7 != 0))
               .withColumn("order_status", F.when(planted & (number % 11 == 0), "earlier").otherwise(F.col("order_status")))
               .withColumn("order_delivered_customer_date", F.when(~(planted & (number % 13 == 0)), F.col("order_delivered_customer_date"))))
    return changed_rows(earlier, orders, "order_id", month)


def delay_distribution_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay distribution from the kept summary, of which one year's months
    were first written with half their orders and then put right."""
    orders, path = tpch_tables(spark, sf_dir).orders, fresh_path(spark, "delays")
    late = F.year("order_purchase_timestamp") == YEAR_A
    dlv.write_delay_summary(dlv.delay_summary(orders.where(~late | (F.col("order_id") % 2 == 0))), path)
    dlv.write_delay_summary(dlv.delay_summary(orders.where(late)), path)
    return dlv.summary_distribution(dlv.read_delay_summary(spark, path))


def items_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written with their order's purchase month, and read back."""
    t, path = tpch_tables(spark, sf_dir), fresh_path(spark, "items-by-month")
    grw.write_items_by_month(t.orders, t.items, path)
    return grw.read_items_by_month(spark, path, t.items.schema)


def platform_growth_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platform's growth, from the matched months' items alone."""
    cy = grw.category_years_by_month(items_by_month(spark, sf_dir), tpch_tables(spark, sf_dir).products, YEAR_A, YEAR_B, MATCHED_MONTHS)
    return grw.growth_of(cy, YEAR_A, YEAR_B)


def category_share_shift_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories' share shift, from the matched months' items alone."""
    cy = grw.category_years_by_month(items_by_month(spark, sf_dir), tpch_tables(spark, sf_dir).products, YEAR_A, YEAR_B, MATCHED_MONTHS)
    return grw.shift_of(cy, YEAR_A, YEAR_B, SHARE_FLOOR)


def _silver(table):
    return _q(lambda t: silver(table, bronze_of(t, table)))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    # ingest: the binding rendered as raw text (bronze), typed again (silver)
    for table in BRONZE_TABLES:
        q[f"bronze_{table}"] = _bronze(table)
    for table in ["orders", "order_items", "order_payments", "order_reviews", "products",
                  "customers", "sellers", "geolocation", "category_translation"]:
        q[f"silver_{table}"] = _silver(table)
    for fn in (load_totals, raw_to_category_pareto, silver_orders_incremental, located_changes,
               delay_distribution_kept, platform_growth_by_month, category_share_shift_by_month):
        q[fn.__name__] = fn
    q["row_counts"] = _q(lambda t: row_counts({k: bronze_of(t, k) for k in BRONZE_TABLES}))
    for name, fn in analyses(TPCH_PARAMS).items():
        q[name] = _q(fn)
    q["delay_bucket_score_by_date"] = _q(lambda t: dlv.bucket_score(t.orders, t.reviews, by_date=True))
    q["monthly_growth_trimmed_after"] = _q(
        lambda t: ser.monthly_growth(t.orders, t.items, trim=(*TRUST_WINDOW, "after")))
    for name, fn in retention_analyses(TPCH_PARAMS).items():
        q[f"{name}_since_2001"] = _q(fn, since=True)
    return q
