"""The canonical retail schema end to end: raw CSV exports → bronze → silver
Parquet, and the binding that reads the silver layer back for analysis.

``load_silver`` is the whole load: nine all-text reads, the typed silver
projection of each, control totals measured while it is written, and the geolocation
centroid de-dup (collapsed to one row per zip prefix *before* any join can
fan out on it).  Orders are written partitioned by purchase month when
asked, so date-window analyses prune directories.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import centroid_dedup
from tidemark.schema import BRONZE_COLUMNS, SILVER_TYPES
from tidemark.sources.bronze import read_bronze_all
from tidemark.sources.silver import silver, write_silver
from tidemark.sources.tpch import Tables

SILVER_NAMES = {
    "orders": "orders_clean", "order_items": "order_items_clean",
    "order_payments": "order_payments_clean", "order_reviews": "order_reviews_clean",
    "products": "products_clean", "customers": "customers_clean", "sellers": "sellers_clean",
    "geolocation": "geolocation_clean", "category_translation": "category_translation_clean",
}


def silver_layer(bronze: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Typed silver DataFrames for every bronze table (lazy)."""
    out = {t: silver(t, df) for t, df in bronze.items() if t != "geolocation"}
    if "geolocation" in bronze:
        g = silver("geolocation", bronze["geolocation"])
        out["geolocation"] = centroid_dedup(g, "geolocation_zip_code_prefix",
                                            ["geolocation_lat", "geolocation_lng"],
                                            ["geolocation_city", "geolocation_state"])
    return out


TOTAL = "decimal(38,2)"  # of control totals
# tables keyed by order (bucketed on order_id) and by customer record
ORDER_KEYED = ("orders", "order_items", "order_payments", "order_reviews")


class LoadMismatch(ValueError):
    """What was loaded differs from what was announced."""


def measures(table: str) -> dict[str, Column]:
    """Control totals of a silver table: its rows and the sums of its numbers."""
    numbers = [c for c, (kind, _) in SILVER_TYPES.get(table, {}).items() if kind == "int" or kind.startswith("decimal")]
    return {"rows": F.count(F.lit(1)).cast(TOTAL)} | {c: F.sum(F.col(c).cast(TOTAL)).cast(TOTAL) for c in numbers}


def _totals(table: str, raw_rows: int, got: dict) -> list[tuple]:
    return [(table, "raw_rows", Decimal(raw_rows)), *((table, m, got.get(m)) for m in measures(table))]


def check_manifest(totals: DataFrame, manifest: DataFrame) -> None:
    """Every announced (tbl, measure, value) must have been measured so.  A
    manifest has a row a table and measure, so the rows that differ are few."""
    got = totals.select("tbl", "measure", F.col("value").alias("loaded"))
    wrong = (manifest.select("tbl", "measure", F.col("value").cast(TOTAL).alias("announced"))
             .join(got, ["tbl", "measure"], "left").where(~F.col("announced").eqNullSafe(F.col("loaded"))).orderBy("tbl", "measure"))
    if rows := wrong.take(20):
        raise LoadMismatch("; ".join(f"{r.tbl}.{r.measure}: announced {r.announced}, loaded {r.loaded}" for r in rows))


def load_silver(spark: SparkSession, raw_root: str, silver_root: str, file_names: dict[str, str] | None = None,
                partition_orders_by_month: bool = False, buckets: int | None = None, database: str | None = None,
                reject_root: str | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Load every raw table and write the silver layer; returns the control
    totals (tbl, measure, value), which are measured while a table is written: each
    file is read once.

    With ``reject_root`` rows that are ragged or don't parse go to
    ``reject_root/<table>`` (a second read, of a table that has any) and the rest is
    loaded; else they fail the load.  With ``manifest`` (tbl, measure, value) a load
    that doesn't measure what was announced fails with :class:`LoadMismatch`; tables
    are then written beside their places first and moved there after all were checked.

    With ``buckets`` and ``database`` the order-keyed tables are saved as
    catalog tables bucketed and sorted by ``order_id`` (customers by
    ``customer_id``), at the same paths.  Joins and aggregations on those
    keys then read co-located buckets instead of shuffling the fact tables
    (read them back with :func:`catalog_tables`).
    """
    root = silver_root.rstrip("/")
    aside = manifest is not None and not database
    totals: list[tuple] = []
    for table, bronze in read_bronze_all(spark, raw_root, file_names, keep_corrupt=bool(reject_root)).items():
        seen, kept = Observation(), Observation()
        bronze = bronze.observe(seen, F.count(F.lit(1)).alias("rows"))
        typed, rejects = silver(table, bronze, reject=True) if reject_root else (silver(table, bronze), None)
        df = typed.observe(kept, *[c.alias(m) for m, c in measures(table).items()])
        if table == "geolocation":
            df = centroid_dedup(df, "geolocation_zip_code_prefix", ["geolocation_lat", "geolocation_lng"],
                                ["geolocation_city", "geolocation_state"])
        path = f"{root}/_load/{SILVER_NAMES[table]}" if aside else f"{root}/{SILVER_NAMES[table]}"
        key = "order_id" if table in ORDER_KEYED else "customer_id" if table == "customers" else None
        if database:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
            w = df.write.mode("overwrite").option("path", path)
            if buckets and key:
                w = w.bucketBy(buckets, key).sortBy(key)
            w.saveAsTable(f"{database}.{SILVER_NAMES[table]}")
        elif table == "orders" and partition_orders_by_month:
            df = df.withColumn("purchase_month", F.date_format("order_purchase_timestamp", "yyyy-MM"))
            write_silver(df, path, ["purchase_month"])
        else:
            write_silver(df, path)
        got = kept.get
        totals += _totals(table, seen.get["rows"], got)
        if rejects is not None and got["rows"] < seen.get["rows"]:
            rejects.write.mode("overwrite").parquet(f"{reject_root.rstrip('/')}/{table}")
    out = spark.createDataFrame(totals, f"tbl string, measure string, value {TOTAL}")
    if manifest is not None:
        check_manifest(out, manifest)
    if aside:
        _put_in_place(spark, root)
    return out


def _put_in_place(spark: SparkSession, root: str) -> None:
    """The tables written beside their places take them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for name in SILVER_NAMES.values():
        if fs.exists(path(f"{root}/_load/{name}")):
            fs.delete(path(f"{root}/{name}"), True)
            if not fs.rename(path(f"{root}/_load/{name}"), path(f"{root}/{name}")):
                raise OSError(f"{root}/_load/{name} could not be moved")
    fs.delete(path(f"{root}/_load"), True)


def build_silver(spark: SparkSession, raw_root: str, silver_root: str, file_names: dict[str, str] | None = None,
                 **options) -> DataFrame:
    """:func:`load_silver`, returning the raw row counts (tbl, count)."""
    totals = load_silver(spark, raw_root, silver_root, file_names, **options)
    return totals.where("measure = 'raw_rows'").select("tbl", F.col("value").cast("bigint").alias("count"))


def native_tables(spark: SparkSession, silver_root: str) -> Tables:
    """Binding over a silver layer written by :func:`build_silver`.

    The state → macro-region mapping is the fixed 27-code map
    (``region_map`` is None, see tidemark.functions.region_of_state)."""
    root = silver_root.rstrip("/")

    def reader(table):
        def read():
            df = spark.read.parquet(f"{root}/{SILVER_NAMES[table]}")
            return df.drop("purchase_month") if "purchase_month" in df.columns else df
        return read

    attr = {"orders": "orders", "order_items": "items", "order_payments": "payments",
            "order_reviews": "reviews", "products": "products", "customers": "customers",
            "sellers": "sellers", "geolocation": "geolocation", "category_translation": "translation"}
    builders = {attr[t]: reader(t) for t in BRONZE_COLUMNS}
    builders["region_map"] = lambda: None
    return Tables(builders)


def catalog_tables(spark: SparkSession, database: str) -> Tables:
    """Binding over silver tables saved in the catalog by
    ``build_silver(..., buckets=N, database=...)`` (bucket metadata kept);
    tables written without bucketing are read from the catalog as well."""
    attr = {"orders": "orders", "order_items": "items", "order_payments": "payments",
            "order_reviews": "reviews", "products": "products", "customers": "customers",
            "sellers": "sellers", "geolocation": "geolocation", "category_translation": "translation"}

    def reader(table):
        return lambda: spark.table(f"{database}.{SILVER_NAMES[table]}")

    builders = {attr[t]: reader(t) for t in BRONZE_COLUMNS}
    builders["region_map"] = lambda: None
    return Tables(builders)
