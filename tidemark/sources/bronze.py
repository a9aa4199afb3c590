"""Bronze layer: raw files read as all-text tables, plus load validation.

The explicit all-``StringType`` schema means a blank or malformed value can
never make the reader drop or mistype a row; typing happens in silver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import BRONZE_COLUMNS, bronze_schema
from tidemark.sources.silver import CORRUPT

# tables whose free text may hold quoted newlines and doubled quotes
_MULTILINE = {"order_reviews"}


def read_bronze(spark: SparkSession, path: str, table: str, keep_corrupt: bool = False, **options) -> DataFrame:
    """Read one raw CSV table (header row, all columns text).

    The header must name the table's columns in their order, and a row must
    have as many fields: anything else fails the read instead of shifting
    values into other columns, unless ``keep_corrupt`` hands such a row on in the
    column ``_corrupt_record``.  A multi-line file (reviews) is one task, so
    land such tables in files of a few hundred MB."""
    schema = bronze_schema(table)
    if keep_corrupt:
        schema = schema.add(CORRUPT, "string")
    reader = (spark.read.schema(schema)
              .option("header", True)
              .option("enforceSchema", False)
              .option("escape", '"')
              .option("mode", "PERMISSIVE" if keep_corrupt else "FAILFAST")
              .option("columnNameOfCorruptRecord", CORRUPT))
    if table in _MULTILINE:
        reader = reader.option("multiLine", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def read_bronze_all(spark: SparkSession, root: str, file_names: dict[str, str] | None = None,
                    keep_corrupt: bool = False) -> dict[str, DataFrame]:
    """All nine raw tables from ``root/<table>.csv`` (or the given names)."""
    names = file_names or {t: f"{t}.csv" for t in BRONZE_COLUMNS}
    return {t: read_bronze(spark, f"{root.rstrip('/')}/{names[t]}", t, keep_corrupt) for t in names}


def to_bronze(df: DataFrame) -> DataFrame:
    """Render a typed table the way a raw export holds it: every column as
    text, NULL written as the empty string."""
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_raw(df: DataFrame, path: str) -> None:
    """A typed table as the raw CSV export that :func:`read_bronze` reads."""
    (to_bronze(df).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, count) per table — one job, one UNION ALL of global counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("tbl"), "count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
