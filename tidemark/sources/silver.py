"""Silver layer: typed, cleaned copies of the bronze tables, and the sink.

Guarded columns go through ``NULLIF(TRIM(col), '')`` before the cast so a
meaningful blank (an undelivered order) survives as NULL.  Unguarded columns
are strict: a blank or NULL there is an error, also where the CSV reader has
turned the blank into NULL.  A value with more decimal places than its type
keeps is an error too.  An error fails the job; with ``reject=True`` the
result is (rows without error, raw rows with one), and rows that the reader
marked as malformed (column ``CORRUPT``) are among the latter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import MONEY, SILVER_BLANK_TO_NULL, SILVER_TYPES


CORRUPT = "_corrupt_record"


def _blank_null(c: str) -> Column:
    return F.expr(f"NULLIF(TRIM(`{c}`), '')")


def silver(table: str, bronze: DataFrame, reject: bool = False):
    """Typed silver table for ``table``; with ``reject`` returns (silver, rejects)."""
    spec = SILVER_TYPES.get(table, {})
    blanks = set(SILVER_BLANK_TO_NULL.get(table, []))
    corrupt = [F.col(CORRUPT).isNotNull()] if CORRUPT in bronze.columns else []
    cols, bad = [], list(corrupt)
    for c in bronze.columns:
        if c == CORRUPT:
            continue
        if c not in spec:
            cols.append(_blank_null(c).alias(c) if c in blanks else F.col(c))
            continue
        typ, guarded = spec[c]
        # money is parsed once, wide; narrowing it shows a value that the type can't hold or that has more places
        parsed = F.expr(f"try_cast(NULLIF(TRIM(`{c}`), '') AS {'decimal(38,18)' if typ == MONEY else typ})")
        typed = parsed.try_cast(typ) if typ == MONEY else parsed
        wrong = parsed.isNull() & _blank_null(c).isNotNull()
        if not guarded:  # a blank is an error too
            wrong = parsed.isNull()
        if typ == MONEY:
            wrong = wrong | (parsed.isNotNull() & ~F.coalesce(typed == parsed, F.lit(False)))
        if reject:
            bad.append(wrong)
        else:
            message = F.concat(F.lit(f"{table}.{c}: no {typ} without loss in '"), F.coalesce(F.col(c), F.lit("")), F.lit("'"))
            typed = F.when(wrong, F.raise_error(message)).otherwise(typed)
        cols.append(typed.cast(typ).alias(c))
    if not reject:
        return bronze.select(cols)
    failed = F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(False)) if bad else F.lit(False)
    # rows with a value that did not parse go only to the reject table
    return bronze.where(~failed).select(cols), bronze.where(failed)


def silver_orders(bronze: DataFrame, reject: bool = False):
    return silver("orders", bronze, reject)


def silver_order_items(bronze: DataFrame, reject: bool = False):
    return silver("order_items", bronze, reject)


def silver_order_payments(bronze: DataFrame, reject: bool = False):
    return silver("order_payments", bronze, reject)


def silver_order_reviews(bronze: DataFrame, reject: bool = False):
    return silver("order_reviews", bronze, reject)


def silver_products(bronze: DataFrame, reject: bool = False):
    return silver("products", bronze, reject)


def silver_customers(bronze: DataFrame, reject: bool = False):
    return silver("customers", bronze, reject)


def silver_sellers(bronze: DataFrame, reject: bool = False):
    return silver("sellers", bronze, reject)


def silver_category_translation(bronze: DataFrame, reject: bool = False):
    return silver("category_translation", bronze, reject)


def write_silver(df: DataFrame, path: str, partition_by: list[str] | None = None,
                 max_records_per_file: int = 5_000_000) -> None:
    """Sink: overwrite a Parquet table (optionally partitioned, e.g. orders
    by purchase month so date-window queries prune whole directories).

    No shuffle is added before the write (a repartition by month would send
    a hot month to one task); each task writes its own files, capped at
    ``max_records_per_file`` rows so no single file grows without bound."""
    w = df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
