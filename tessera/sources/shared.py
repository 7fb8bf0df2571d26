"""The shared folder, and making the package known to Python workers."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Of text that is sent to a Python worker at once, unless the session has a limit of its own.
BATCH_BYTES = 8 << 20
UNLIMITED = str(2**31 - 1)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, and bound the batches they get.

    Records are counted in batches of 10,000 by default, whatever their length; a
    bound in bytes keeps a worker's memory the same for long texts.
    On a cluster the package is installed or sent with --py-files; in local mode
    the driver may have found it through sys.path alone, which workers don't see.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if root not in sys.path:
        sys.path.append(root)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, UNLIMITED) in (UNLIMITED, "-1"):
        spark.conf.set(limit, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; that setting is made only where unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm_dir.get() if jvm_dir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: the lineage ends there, and executors may be lost."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
