"""Small files on whatever file system Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value) -> None:
    """Replaces the file as a whole: it is written beside and renamed."""
    fs, p = at(spark, path)
    beside = at(spark, path + ".new")[1]
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(beside, p)


def read_json(spark: SparkSession, path: str):
    """The value of such a file; none where there is none."""
    fs, p = at(spark, path)
    if not fs.exists(p):
        fs, p = at(spark, path + ".new")  # between delete and rename
        if not fs.exists(p):
            return None
    file = fs.open(p)
    text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(file))
    file.close()
    return json.loads(text)
