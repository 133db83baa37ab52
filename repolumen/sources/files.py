"""Small files and folders through Hadoop's file systems, from the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path as ``open`` takes it, or None in a store that only Hadoop reads."""
    target, fs = _opened(spark, path)
    if fs.getUri().getScheme() != "file":
        return None
    return fs.makeQualified(target).toUri().getPath()


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _opened(spark, path)
    return fs.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, empty if it does not exist."""
    target, fs = _opened(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def modified_ms(spark: SparkSession, path: str) -> int:
    target, fs = _opened(spark, path)
    return fs.getFileStatus(target).getModificationTime()


def delete_tree(spark: SparkSession, path: str) -> None:
    target, fs = _opened(spark, path)
    fs.delete(target, True)


def read_small_text(spark: SparkSession, path: str) -> str:
    target, fs = _opened(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file in place as a whole; false if there is one of that name already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    target, fs = _opened(spark, path)
    draft, _ = _opened(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
