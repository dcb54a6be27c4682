"""Tables between the rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SWEPT: set[str] = set()


def _shared(spark: SparkSession) -> str:
    """The folder of the setting or of ``setCheckpointDir``; in local mode one of its own where neither is."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='strandwise-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; the session's are removed when the driver ends."""
    root = _shared(spark)
    own = f"{root}/{spark.sparkContext.applicationId}/engine"
    if own not in _SWEPT:
        _SWEPT.add(own)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(_remove, system, path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _remove(system, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone first
        system.delete(path, True)


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint()


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its real size known to the planner."""
    folder = scratch_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
