"""Incremental silver tables that may be fed any file or batch again.

A table with a primary key lies in ``parts`` directories by a hash of the key, so all
deliveries of a row, late corrections included, meet in one directory.  Each row
keeps the version it came with (its file's time, say) and a digest of its values.

:func:`apply_batch` takes a batch of raw rows:

1. rows that don't parse, or have no key, go to ``reject_dir/batch_id=N``;
2. of a key's rows in the batch the latest version counts;
3. a row is a change if its key is new, or its digest differs and its version
   isn't older.  Without any change nothing is written;
4. directories that hold changes are merged into a staging folder named by the
   batch, then take the place of the old ones by dynamic partition overwrite.

A batch that is run again finds no change.  If the driver was lost between staging and
overwriting, the complete staging folder of that batch is put in place as it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.primitives import first_event
from tidemark.session import materialize, shared_dir
from tidemark.sources.silver import silver

VERSION, DIGEST, PART = "_version", "_digest", "_part"
PARTS = 64
# fixed values: primary keys of the raw tables (geolocation has none: its repeated rows are data)
TABLE_KEYS: dict[str, list[str]] = {
    "orders": ["order_id"], "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"], "order_reviews": ["review_id", "order_id"],
    "products": ["product_id"], "customers": ["customer_id"], "sellers": ["seller_id"],
    "category_translation": ["product_category_name"],
}


def row_digest(columns: list[str]) -> Column:
    """Of the columns' names and values; NULLs and blanks differ."""
    return F.md5(F.to_json(F.struct(*columns)))


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def _stored(spark: SparkSession, silver_dir: str) -> DataFrame | None:
    fs, at = _path(spark, silver_dir)
    if not fs.exists(at) or not any(s.getPath().getName().startswith(f"{PART}=") for s in fs.listStatus(at)):
        return None
    return spark.read.parquet(silver_dir)


def current(spark: SparkSession, silver_dir: str) -> DataFrame:
    """The table's rows as they stand."""
    return spark.read.parquet(silver_dir).drop(VERSION, DIGEST, PART)


def _parts(df: DataFrame) -> list[int]:
    """At most ``parts`` numbers."""
    return sorted(r[0] for r in df.select(PART).distinct().collect())


def apply_batch(raw: DataFrame, batch_id: int, table: str, silver_dir: str, reject_dir: str | None = None,
                parts: int = PARTS) -> dict[str, int]:
    """Bring the raw rows of one batch into the table.  ``raw`` has the bronze columns, ``_version`` and perhaps
    ``_corrupt_record``.  Without ``reject_dir`` a bad row fails the batch.  Returns the numbers of changed rows and of parts written."""
    spark, silver_dir, keys = raw.sparkSession, silver_dir.rstrip("/"), TABLE_KEYS[table]
    no_key = F.array_contains(F.array(*[F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys]), "")
    if reject_dir:
        typed, rejects = silver(table, raw.where(~no_key), reject=True)
        rejects = rejects.unionByName(raw.where(no_key))
        rejects.write.mode("overwrite").parquet(f"{reject_dir.rstrip('/')}/batch_id={batch_id}")
    else:
        typed = silver(table, raw.withColumn(keys[0], F.when(no_key, F.raise_error(F.lit(f"{table}: a row has no key")))
                                             .otherwise(F.col(keys[0]))))
    staging = f"{silver_dir}/_staging/batch_id={batch_id}"
    changed = -1  # unknown: the batch was staged before
    if not _exists(spark, f"{staging}/_SUCCESS"):
        values = [c for c in typed.columns if c != VERSION]
        rows = (typed.withColumn(DIGEST, row_digest(values))
                .withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
        rows = first_event(rows, keys, [F.col(VERSION).desc_nulls_last(), F.col(DIGEST).desc()])
        stored = _stored(spark, silver_dir)
        if stored is None:
            newer = materialize(rows)
        else:
            held = stored.select(*keys, F.col(VERSION).alias("_v"), F.col(DIGEST).alias("_d"), F.col(PART).alias("_p"))
            held = held.where(F.col("_p").isin(_parts(rows))).drop("_p")
            later = F.col("_d").isNull() | ((F.col(DIGEST) != F.col("_d")) & (
                (F.col(VERSION) > F.col("_v")) | ((F.col(VERSION) == F.col("_v")) & (F.col(DIGEST) > F.col("_d")))))
            newer = materialize(rows.join(held, keys, "left").where(later).drop("_v", "_d"))
        changed = newer.count()
        if not changed:
            return {"changed": 0, "parts": 0}
        merged = newer
        if stored is not None:
            old = stored.where(F.col(PART).isin(_parts(newer))).join(newer.select(*keys), keys, "left_anti")
            merged = old.unionByName(newer)
        merged.write.mode("overwrite").partitionBy(PART).parquet(staging)
    staged = spark.read.parquet(staging)
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(silver_dir))
    n = len(_parts(staged))
    fs, at = _path(spark, staging)
    fs.delete(at, True)
    return {"changed": changed, "parts": n}


def stream_upsert(spark: SparkSession, landing_dir: str, table: str, silver_dir: str, reject_dir: str,
                  checkpoint: str | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Every file present in ``landing_dir`` through :func:`apply_batch`, then stop; a row's version is its file's time.
    The checkpoint numbers the batches, so one that is run again after a failure has its old number."""
    from tidemark.streaming.ingest import read_bronze_stream
    sink = hashlib.sha256(silver_dir.rstrip("/").encode()).hexdigest()[:16]
    raw = read_bronze_stream(spark, landing_dir, table, max_files_per_trigger, keep_corrupt=True)
    raw = raw.select("*", F.col("_metadata.file_modification_time").alias(VERSION))
    return (raw.writeStream.option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/upsert-{table}-{sink}")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, table, silver_dir, reject_dir) and None).start())
