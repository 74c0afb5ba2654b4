"""Files of any file system that Spark can read and write, from the driver and from workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def absolute(path: str) -> str:
    """Spark's JVM and its workers have working directories of their own."""
    return path if "://" in path else os.path.abspath(path)


def _of(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(absolute(path))
    return target, target.getFileSystem(conf)


def listed(spark: SparkSession, folder: str) -> dict[str, bool] | None:
    """The names in a folder, and whether each is a folder itself; None if it is not one."""
    target, system = _of(spark, folder)
    if not system.exists(target) or not system.getFileStatus(target).isDirectory():
        return None
    return {s.getPath().getName(): s.isDirectory() for s in system.listStatus(target)}


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _of(spark, path)
    return system.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file under another name and then give it its own, so that no reader sees a part of it."""
    target, system = _of(spark, path)
    part, _ = _of(spark, f"{path}.part")
    system.mkdirs(target.getParent())
    stream = system.create(part, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"cannot write {path}")
