"""Session helpers.

The cluster names its shared, fault-tolerant folder in ``spark.checkpoint.dir``; every
job that must cut lineage or keep streaming state writes below it. Only a local-mode
session without that setting (unit tests) gets a fresh scratch folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "larder", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench (a cluster brings its own)."""
    # Python workers find the package wherever the driver was started (a cluster ships the wheel)
    root = str(Path(__file__).resolve().parents[1])
    seen = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in seen:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, seen)])
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in _LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder for checkpoints, snapshots and stream state.

    Read from the session (``spark.checkpoint.dir`` / the context's checkpoint dir).
    Set here only when unset and the master is local, as in unit tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster run needs a shared folder")
    scratch = tempfile.mkdtemp(prefix="larder-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, unique folder below the shared folder (never reused; deleted only by ``removed``)."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/larder-{kind}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``scratch_path`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in the block go when each of them ends; else they stay until the driver happens to collect
    its garbage, so that a job of many steps holds those of all at once."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


#: Bytes of rows that one partition of an ordered pass should hold.
PARTITION_BYTES = 128 << 20


def partitions(spark: SparkSession, rows: DataFrame | None = None) -> int:
    """Partitions of a shuffle: the session's number, or more if ``rows`` (stored, so that counting is cheap) need
    more to stay at ``PARTITION_BYTES`` each."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions") or os.cpu_count() or 8)
    if rows is None:
        return least
    return max(least, -(-rows.count() * rows._jdf.schema().defaultSize() // PARTITION_BYTES))
