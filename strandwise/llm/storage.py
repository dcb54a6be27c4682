"""Shared scratch space: tables and files that every executor can reach.

Everything is kept below ``spark.checkpoint.dir``, so a lost executor costs a
task retry and never data.  Files are written under a temporary name and moved
into place, which makes a retried or speculative task harmless.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_SWEPT: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session, by setting or by call; in local mode one of its own where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        if own := spark.sparkContext.getCheckpointDir():
            return own.rstrip("/")
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _ROOTS[app] = tempfile.mkdtemp(prefix="strandwise-")
        atexit.register(shutil.rmtree, _ROOTS[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_ROOTS[app]}")
    return f"file://{_ROOTS[app]}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; the session's are removed when the driver ends."""
    own = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/corpus"
    if own not in _SWEPT:
        _SWEPT.add(own)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_remove, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _remove(system, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone first
        system.delete(path, True)


def write_table(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it again."""
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table from :func:`write_table` once no plan needs it."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        drop_folder(spark, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url if "://" in url else f"file://{url}")


@contextlib.contextmanager
def atomic_output(url: str) -> Iterator:
    """A stream whose content appears at ``url`` only when it is complete."""
    system, path = _open(url)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(part) as out:
            yield out
        system.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(part)
        raise


def open_input(url: str):
    """A seekable reader of the file at ``url``."""
    system, path = _open(url)
    return system.open_input_file(path)


def open_stream(url: str):
    """A forward-only reader of the raw bytes at ``url``."""
    system, path = _open(url)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)
