"""Small files in folders that all executors share, by whatever file system the path names: manifests, maps, versions."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, sorted; none if it isn't there."""
    fs, at = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def load(spark: SparkSession, path: str) -> Any:
    """The JSON value of a small file."""
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, value: Any) -> bool:
    """Write a JSON value as a file that mustn't exist yet; False if it does. The file is written under another name and renamed
    without overwriting, so that readers see all of it or nothing, and of two writers one wins."""
    fs, at = _hadoop(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    temporary = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(temporary, at, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(temporary, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)
