"""Session construction and lineage cutting.

The shared folder is always read from the session (``spark.checkpoint.dir``).
A folder of our own is set only when the setting is absent *and* the master
is local (tests, laptops); on a cluster an absent setting is an error, because
a machine-local folder would not survive the loss of the executor that wrote
it.  Tables written there on the way belong to the application: they are
removed by :func:`release`, at the latest when the driver ends.
"""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import threading
import uuid

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # ANSI mode stays on (Spark 4 default): bad casts fail loudly; silver
    # uses try_cast where a reject table is wanted.
}


def get_session(master: str | None = None, app_name: str = "tidemark",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as configured:
    the same path in every session that has the same setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster run needs a shared "
                "folder (it is never defaulted to a local temp dir)")
        app = spark.sparkContext.applicationId
        if app not in _UNSET:
            _UNSET[app] = tempfile.mkdtemp(prefix="tidemark-shared-")
            atexit.register(shutil.rmtree, _UNSET[app], ignore_errors=True)
        configured = _UNSET[app]
    return configured.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder, for tables written
    on the way; removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(release, spark, path)
    return path


HELD = 8  # frames that executors keep at a time
_KEPT: list[DataFrame] = []
_OWN: set[str] = set()
_WRITTEN = threading.local()  # .paths: tables that this thread wrote on the way, in order
_UNSET: dict[str, str] = {}  # local runs without the setting, by application


def release(spark: SparkSession, path: str | None = None) -> None:
    """Remove the tables that this application wrote on the way.  Frames that
    still read them can't be used afterwards."""
    path = path or f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        return
    _OWN.discard(path)
    _delete(spark, path)


def _paths() -> list[str]:
    if not hasattr(_WRITTEN, "paths"):
        _WRITTEN.paths = []
    return _WRITTEN.paths


def written() -> int:
    """How many tables this thread has written on the way so far."""
    return len(_paths())


def release_between(spark: SparkSession, first: int, last: int) -> None:
    """Remove the tables that this thread wrote on the way between two calls of
    :func:`written`, when all that reads them has been written elsewhere."""
    paths = _paths()
    for k in range(first, last):
        if paths[k]:
            _delete(spark, paths[k])
            paths[k] = ""


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = spark._jsparkSession.sessionState().newHadoopConf()  # with spark.hadoop.* settings
        target.getFileSystem(conf).delete(target, True)
    except (OSError, Py4JError) as e:  # at the latest moment the JVM may have gone before the driver's Python
        logging.getLogger(__name__).warning("%s was not removed: %s", path, type(e).__name__)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the application's part of the shared folder."""
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths().append(path)
    return path


def hold(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept by the executors (memory, else their disk)
    while several jobs read it.

    Nothing depends on the kept copy: blocks that are lost with an executor, or
    let go, are computed again from the sources.  The last ``HELD`` frames are kept,
    earlier ones are let go.  A column of its own keeps the copy from standing in
    for an equal plan of a later query, whose files may have changed.
    """
    tag = "_held"
    while tag in df.columns:
        tag = f"_{tag}"
    kept = df.withColumn(tag, F.lit(uuid.uuid4().hex)).persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(kept)
    while len(_KEPT) > HELD:
        let_go(_KEPT.pop(0))
    return kept.drop(tag)


def let_go(df: DataFrame) -> None:
    """End what :func:`hold` keeps, or remove the table that :func:`materialize` wrote:
    for frames that nothing will read again."""
    if path := getattr(df, "_table", None):
        _delete(df.sparkSession, path)
        paths = _paths()
        if path in paths:
            paths[paths.index(path)] = ""
        return
    try:
        df.unpersist()
    except (OSError, Py4JError):  # its session has ended
        pass


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the application's
    part of the shared folder and reading it back.

    Used where one intermediate feeds several jobs, so that the upstream joins
    and shuffles run once.  The files outlive any executor; Parquet gives
    columnar reads and a count from footers.  Never a local checkpoint.
    ``options`` go to the Parquet writer.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.mode("overwrite").options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out
