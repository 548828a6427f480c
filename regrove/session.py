"""Session settings and the shared folders a job may write to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "regrove", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partitions are left to the caller: AQE coalesces them downwards, so on a
    cluster set `spark.sql.shuffle.partitions` high (2-4 x cores) and let it shrink.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # tuning trials and folds are submitted from several driver threads
        "spark.scheduler.mode": "FAIR",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Root of the folder every executor can reach.

    The cluster names it in `spark.checkpoint.dir`. A local master (tests, a laptop) gets a
    fresh local folder where that is unset; any other master without it is an error, since
    executors would each write to a disk of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
    local = tempfile.mkdtemp(prefix="regrove-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def let_workers_import(spark: SparkSession) -> None:
    """Put this package on the path of Python workers started from now on, wherever the session was started.

    On a cluster the package is installed or shipped; there the extra folder does no harm.
    """
    environment = spark.sparkContext.environment
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in known:
        environment["PYTHONPATH"] = os.pathsep.join([folder, *known])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make `checkpoint()` and the tree learners' lineage cutting usable."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


#: Scratch paths given out by this process, by application.
_GIVEN: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Remove the scratch tables that this session has written; returns how many there were.

    Frames that operators returned may read them: write what is still wanted first.
    """
    removed = 0
    for path in _GIVEN.pop(spark.sparkContext.applicationId, []):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return removed
