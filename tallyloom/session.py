"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for. On a cluster, size
# spark.sql.shuffle.partitions to the data; AQE merges what is too small.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine, without a web page."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyloom")
    settings = {
        **RECOMMENDED,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-checkpoint-"))
    return spark


# Intermediates written by this process and not deleted yet.
_written: list[str] = []
# (application, folder) whose name does not tell that it is shared, and a trial did.
_tried: set[tuple[str, str]] = set()


def scratch_path(spark: SparkSession) -> str | None:
    """A new path in the shared checkpoint folder; None where the session names no folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. On a
    cluster a path without a scheme may be local to each machine if the default
    file system is: each would write to its own disk, and a later read would
    find a part of the table. Such a folder is tried once, and refused if not
    all that the tasks write there is found again. A ``file:`` path says that
    the folder is a mount that all machines share.
    """
    folder = _folder(spark)
    if folder is None:
        return None
    context = spark.sparkContext
    default = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if (context.applicationId, folder) not in _tried:
        try:
            _require_shared(folder, context.master, default)
        except ValueError:
            if not _all_found_again(spark, folder):
                raise
            _tried.add((context.applicationId, folder))
    path = f"{folder.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def _require_shared(folder: str, master: str, default_fs: str) -> None:
    if not master.startswith("local") and "://" not in folder and not folder.startswith("file:") and default_fs.startswith("file:"):
        raise ValueError(f"spark.checkpoint.dir names {folder!r}, which is local to each machine; name a shared folder")


def _all_found_again(spark: SparkSession, folder: str) -> bool:
    """Whether a small table that all cores write to ``folder`` is whole when it is read."""
    path = f"{folder.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    n = 2 * spark.sparkContext.defaultParallelism
    rows = spark.range(0, n, 1, n)
    try:
        rows.write.parquet(path)
        found = spark.read.schema(rows.schema).parquet(path).count()
    except (PySparkException, Py4JError):
        found = 0
    with suppress(Py4JError):
        _delete(spark, path)
    return found == n


# Spark's own setting: files of a query's shuffles go when it ends, not when the driver next collects garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, *more: DataFrame, since: int | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    A lost executor then costs no recomputation beyond the table, and several
    consumers share one computation. Parquet keeps column pruning, which a
    checkpointed RDD has not. A session without a folder gets ``df`` back
    unchanged: the same result, recomputed by each consumer.

    The tables stay until their result has been used; ``intermediates`` and
    ``drop_intermediates`` delete them. With ``since`` (of ``written``), those written
    from then on go as soon as this one is there: they were for it alone. Files of the
    shuffles behind it go too. Of several frames each is written by itself into one table,
    so only one's shuffles are there at a time. ``compression`` names another codec than
    the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    if path is None:
        return reduce(DataFrame.unionByName, more, df)
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        for part in (df, *more):
            part.write.parquet(path, mode="append", compression=compression)
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    if since is not None:
        _written.remove(path)
        drop_intermediates(spark, since)
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables this process has written and not deleted."""
    return len(_written)


def drop_intermediates(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that ``cut_lineage`` wrote in this process; returns their number.

    Results that are still to be computed from them can no longer be.
    """
    paths = _written[since:]
    del _written[since:]
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``cut_lineage`` wrote inside.

    ::

        with intermediates(spark):
            customer_clv_rank(orders, items, customers).write.parquet(target)
    """
    since = len(_written)
    try:
        yield
    finally:
        drop_intermediates(spark, since)
