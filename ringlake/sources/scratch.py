"""The folder that driver and executors share, and what is cut off there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query deletes its shuffle files when it ends.
RELEASES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, as a URI, which the whole cluster shares.

    Where that is unset and driver and executors are one process (tests, a single machine), a
    temporary folder is set; on a cluster, whose executors couldn't see it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    folder = folder if ":" in folder else f"file://{folder}"
    return folder.replace("file:///", "file:/").replace("file:/", "file:///")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that isn't there yet; it is deleted when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and cut the lineage there.

    Spark deletes a checkpoint when its rows can no longer be used, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """`checkpoint`, after which the shuffle files that the rows came through are deleted at once.

    Otherwise they stay until the driver collects its garbage: a search of many steps then
    holds the files of all of them. Rows that are asked of ``df`` itself later are made anew.
    """
    conf = df.sparkSession.conf
    before = conf.get(RELEASES, None)
    conf.set(RELEASES, "true")
    try:
        ready = df.select("*")  # a query takes the setting as it is when the query is made
    finally:
        conf.unset(RELEASES) if before is None else conf.set(RELEASES, before)
    return checkpoint(ready)
