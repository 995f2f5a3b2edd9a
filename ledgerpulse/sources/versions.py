"""Folders that are replaced as a whole: versions, of which only complete ones are read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: An empty file whose creation, one atomic step on every file system, makes a version the current one.
COMPLETE = "_COMPLETE"
#: Complete versions that stay, so that a reader of the one before is not disturbed.
KEPT = 2


def _file_system(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/versions")
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names in order, and whether each is complete."""
    root, fs = _file_system(spark, path)
    if not fs.exists(root):
        return []
    names = sorted(status.getPath().getName() for status in fs.listStatus(root))
    child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [(name, fs.exists(child(f"{root.toString()}/{name}/{COMPLETE}"))) for name in names]


def latest_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete version below ``path``."""
    complete = [name for name, done in _versions(spark, path) if done]
    if not complete:
        raise FileNotFoundError(f"no complete version below {path}")
    return f"{path.rstrip('/')}/versions/{complete[-1]}"


@contextmanager
def new_version(spark: SparkSession, path: str) -> Iterator[str]:
    """A new folder to write into. It counts once the block ends without an error; until then, and if the job dies,
    readers see the version before. Versions older than the last ``KEPT`` complete ones are deleted."""
    before = [name for name, _ in _versions(spark, path)]
    number = int(before[-1].split("-")[0]) + 1 if before else 1
    name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/versions/{name}"
    yield folder
    root, fs = _file_system(spark, path)
    child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.create(child(f"{folder}/{COMPLETE}"), False).close()
    complete = [name for name, done in _versions(spark, path) if done]
    for old in before:
        if len(complete) > KEPT and old < complete[-KEPT]:
            fs.delete(child(f"{root.toString()}/{old}"), True)
