"""Session helpers: the shared folder for checkpoints and written tables.

The folder is ``spark.checkpoint.dir`` of the session.  Where that is unset it
is an error on any cluster; a master ``local[..]``, whose one process is driver
and executor, gets a temporary folder.  Written tables go under a folder of the
session's own in it, which is deleted when the session's process ends.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


_KEPT: set[str] = set()  # folders that are deleted at the end


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Also registers it as the SparkContext checkpoint folder so that
    ``DataFrame.checkpoint()`` writes there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        current = sc.getCheckpointDir()  # set by the user, or by this function before
        if current:
            return current
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder every executor shares")
        # one process is driver and executor (tests, a laptop), so its disk is shared
        base = tempfile.mkdtemp(prefix="panelcast-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder for a written table."""
    own = f"{shared_dir(spark).rstrip('/')}/panelcast/{spark.sparkContext.applicationId}"
    if own not in _KEPT:
        # what is left of it goes with the driver's process
        where = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _KEPT.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def local_session(app: str = "panelcast", cores: str | int = "*", shuffle_partitions: int = 8,
                  event_log_dir: str | None = None, coalesce_shuffles: bool = True) -> SparkSession:
    """Session for tests and the bench (local mode, no UI).

    ``coalesce_shuffles=False`` keeps every shuffle at ``shuffle_partitions``
    tasks: with a few MB of test data AQE would otherwise merge a whole
    shuffle into one task and run all series' windows serially.  On a
    cluster with real volumes leave AQE coalescing on.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PANELCAST_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call-site capture per Column operation (driver-side cost only)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.enabled", str(coalesce_shuffles).lower())
        # remove checkpoint files once their RDD is garbage-collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`fresh_path` named, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
