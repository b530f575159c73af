"""Folders that driver and executors share, through Spark's file systems."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may run without it and then gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="corviq-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop(spark, path)
    return fs.exists(where)


def mark(spark: SparkSession, path: str) -> str | None:
    """A name for the files at ``path`` as they are: another one as soon as any is added, removed or changed."""
    fs, where = hadoop(spark, path)
    if not fs.exists(where):
        return None
    files, it = [], fs.listFiles(where, True)
    while it.hasNext():
        f = it.next()
        files.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()[:32]


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes into a folder beside ``path`` and renames it; if another was first, its result stays."""
    beside = f"{path}-{uuid.uuid4().hex}"
    write(beside)
    fs, target = hadoop(spark, path)
    if fs.exists(target) or not fs.rename(hadoop(spark, beside)[1], target):
        fs.delete(hadoop(spark, beside)[1], True)


def until_the_end(spark: SparkSession, path: str) -> str:
    """The folder goes when the driver ends."""
    fs, where = hadoop(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path
