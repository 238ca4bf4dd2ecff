"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Conservative defaults; a cluster session normally arrives pre-configured
# and only unset keys are filled in.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "voxlex",
                shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Return the active session or build a local one for tests and benches.

    In local mode the executors live in the driver JVM, so ``driver_memory``
    is the heap every task shares (the JVM default of 1 GB makes shuffles
    GC-bound).  It only takes effect when this call starts the JVM.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as given.  Only when the key is unset and the session is local (tests)
    a fresh scratch folder is created and registered; on a cluster executors
    do not share a local folder, so the key must be set.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc
    current = jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not path:
        if not re.match(r"local(\[[^-,]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="voxlex-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint (never a local one): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder, removed when the
    session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)
    fs.deleteOnExit(hpath)
    return fs.makeQualified(hpath).toString()
