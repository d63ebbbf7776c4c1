"""Small files that say which folders hold committed data, replaced in one step.

Data is written to new folders first and counts from the moment its manifest is in place, so a job that dies in between
leaves what was there before. Uses the file system that Spark itself writes to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, content: dict) -> None:
    """Write a manifest; readers see the old one or the new one."""
    files, new = _files(spark, path), f"{path}.{uuid.uuid4().hex}"
    out = files.create(_path(spark, new), True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    options = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(_path(spark, new)), files.makeQualified(_path(spark, path)), options)


def get(spark: SparkSession, path: str) -> dict | None:
    """What a manifest says, None where there is none."""
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return None
    source = files.open(_path(spark, path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; none where it does not exist."""
    files = _files(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(_path(spark, folder)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it; nothing happens where there is none."""
    _files(spark, path).delete(_path(spark, path), True)
