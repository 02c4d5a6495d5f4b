"""The folder that a session's driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set on the context.

    Where neither is set, a local session (as in tests) gets a folder of this
    machine; on a cluster that would be one folder for each machine, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(f"file:///tmp/checkpoints/filingloom-{context.applicationId}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, removed when the session's JVM ends."""
    import uuid

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
