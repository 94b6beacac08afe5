"""Results that are written to the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session gets one of its own."""
    sc = spark.sparkContext
    root, current = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if not root and current.isDefined():
        return current.get()
    if not root and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or tempfile.mkdtemp(prefix="lorekeep-")
    if current.isEmpty():
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of its own that goes when the driver ends."""
    folder, sc = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def written(df: DataFrame) -> DataFrame:
    """The rows as they are now, with no lineage before them: lost executors cost nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
