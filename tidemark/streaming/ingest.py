"""Incremental bronze → silver load with Structured Streaming.

The source analysis loads raw CSV exports once.  A production load receives
new export files over time, so the same text-first reading and the same
silver typing run as a file stream: each new file in the landing folder is
read with the all-text schema, typed by :func:`tidemark.sources.silver.silver`
and appended to the silver Parquet table.  Progress (which files were
taken) lives in a checkpoint under the session's shared checkpoint folder,
so a restarted or failed run picks up exactly the files it has not written.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import bronze_schema
from tidemark.session import shared_dir
from tidemark.sources.silver import CORRUPT, silver

_MULTILINE = {"order_reviews"}


def read_bronze_stream(spark: SparkSession, landing_dir: str, table: str,
                       max_files_per_trigger: int | None = None, keep_corrupt: bool = False):
    """Streaming all-text reader over a folder of raw CSV files.  A file whose
    header differs fails the stream; so does a row with too few or too many
    fields, unless ``keep_corrupt`` hands it on in the column ``CORRUPT``."""
    schema = bronze_schema(table)
    if keep_corrupt:
        schema = schema.add(CORRUPT, "string")
    r = (spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"')
         .option("mode", "PERMISSIVE" if keep_corrupt else "FAILFAST").option("columnNameOfCorruptRecord", CORRUPT))
    if table in _MULTILINE:
        r = r.option("multiLine", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(landing_dir)


def stream_to_silver(spark: SparkSession, landing_dir: str, table: str, silver_dir: str,
                     checkpoint: str | None = None, available_now: bool = True,
                     reject_dir: str | None = None) -> list[StreamingQuery]:
    """Start the bronze→silver stream for one table.

    ``available_now=True`` processes every file present and stops (a
    scheduled incremental batch); otherwise the query keeps running.  With
    ``reject_dir`` malformed rows go to their own sink instead of failing
    the stream.
    """
    sink = hashlib.sha256(silver_dir.rstrip("/").encode()).hexdigest()[:16]
    base = checkpoint or f"{shared_dir(spark)}/stream-silver-{table}-{sink}"
    raw = read_bronze_stream(spark, landing_dir, table, keep_corrupt=bool(reject_dir))
    if reject_dir:
        typed, rejects = silver(table, raw, reject=True)
    else:
        typed, rejects = silver(table, raw), None
    queries = []

    def start(df, path, ckpt):
        w = (df.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", ckpt).outputMode("append"))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
        return w.start()

    queries.append(start(typed, silver_dir, f"{base}/silver"))
    if reject_dir and rejects is not None:
        queries.append(start(rejects, reject_dir, f"{base}/rejects"))
    return queries
