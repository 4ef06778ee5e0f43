"""Session settings and the shared folder for checkpoints and streaming state."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Slices, labels and day partitions are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local session without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = _local_dirs.setdefault(context.applicationId, "")
        if not folder:
            folder = _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="plugload-")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, **options) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and fixes partition-dependent columns."""
    folder = new_folder(df.sparkSession, "table")
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, folder: str) -> bool:
    """Whether a path names a folder, on whatever file system it is."""
    path, files = _path(spark, folder)
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders within a folder; none if it does not exist."""
    path, files = _path(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(path) if f.isDirectory()) if files.exists(path) else []


def file_times(spark: SparkSession, folder: str, order: Callable[[str], tuple]) -> bool:
    """Give the data files of a folder times a second apart along ``order`` of their paths; whether they have them then."""
    top, files = _path(spark, folder)

    def found() -> dict:
        listed, out = files.listFiles(top, True), {}
        while listed.hasNext():
            status = listed.next()
            if not status.getPath().getName().startswith(("_", ".")):
                out[status.getPath().toString()] = status
        return out

    paths = found()
    first = round(time.time()) * 1000 - 1000 * len(paths)
    wanted = {path: first + 1000 * i for i, path in enumerate(sorted(paths, key=order))}
    for path, at in wanted.items():
        files.setTimes(paths[path].getPath(), at, -1)
    return {path: status.getModificationTime() for path, status in found().items()} == wanted


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this package wrote, if it is there."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def rename(spark: SparkSession, folder: str, target: str) -> None:
    """Give a folder its final name; on HDFS and local disks readers see all of it or nothing."""
    path, files = _path(spark, folder)
    if not files.rename(path, _path(spark, target)[0]):
        raise OSError(f"cannot rename {folder} to {target}")
