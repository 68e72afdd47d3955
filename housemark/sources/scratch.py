"""Shared scratch space: staged tables that cut lineage and carry real sizes."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="housemark-")


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``.

    A folder of this machine is used only in local mode, where driver and tasks
    share it; a cluster without the setting is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/housemark-{spark.sparkContext.applicationId}"


_made: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the scratch folder, which is removed when the driver exits."""
    root = scratch_root(spark)
    if root not in _made:
        files, folder = _file_system(spark, root)
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _made.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def stage(frame: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``frame`` once and read it back.

    The result survives lost executors, is cheap to scan more than once, and has
    true file sizes, so Spark broadcasts it only when it really is small.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def staged(frame: DataFrame, name: str = "stage") -> Iterator[DataFrame]:
    """Like ``stage``, for the length of a block: the table is removed at its end."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    try:
        yield spark.read.schema(frame.schema).parquet(path)
    finally:
        delete_tree(spark, path, scratch_root(spark))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer of files has finished and left its mark at ``path``."""
    files, folder = _file_system(spark, f"{path.rstrip('/')}/_SUCCESS")
    return files.exists(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or a folder that is not empty."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return False
    return not files.getFileStatus(target).isDirectory() or len(files.listStatus(target)) > 0


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below ``path``."""
    files, folder = _file_system(spark, path)
    return sorted(f.getPath().toString() for f in files.listStatus(folder) if f.isDirectory())


def delete_tree(spark: SparkSession, path: str, inside: str) -> bool:
    """Delete ``path`` through its file system, only if it lies below ``inside``."""
    files, target = _file_system(spark, path)
    _, base = _file_system(spark, inside)
    prefix = base.toUri().getPath().rstrip("/") + "/"
    if ".." in path or not target.toUri().getPath().startswith(prefix):
        raise ValueError(f"{path} is not inside {inside}")
    return files.delete(target, True)


def release(spark: SparkSession) -> bool:
    """Remove everything this application staged."""
    root = scratch_root(spark)
    _made.discard(root)
    return delete_tree(spark, root, root.rsplit("/", 1)[0])
