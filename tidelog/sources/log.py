"""The append-only record log as a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import RECORD
from tidelog.sources import files


def append(records: DataFrame, path: str) -> None:
    """Add records to the log. Empty and null keys are refused before anything is written."""
    if not records.filter("key is null or key = ''").isEmpty():
        raise ValueError("a record needs a key")
    records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD]).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def replay(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """What recovery reads: records above the low watermark, in order of arrival."""
    return read(spark, path).filter(F.col("seq") > after).orderBy("seq")


def stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def segments(spark: SparkSession, path: str) -> list[str]:
    """The log's files, in name order."""
    fs, p = files.at(spark, path)
    if not fs.exists(p):
        return []
    return sorted(x for s in fs.listStatus(p) if (x := s.getPath().toString()).endswith(".parquet") and not s.getPath().getName().startswith(("_", ".")))


def low_watermark(spark: SparkSession, path: str) -> int | None:
    """The smallest ``seq`` that the log still holds; none if it is empty."""
    return read(spark, path).agg(F.min("seq")).first()[0] if segments(spark, path) else None


def retain(spark: SparkSession, path: str, low_watermark: int) -> int:
    """Delete the segments all of whose records are at or below ``low_watermark``,
    that is flushed; returns how many. A segment with a later record stays whole."""
    if not segments(spark, path):
        return 0
    top = read(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.max("seq").alias("top"))
    gone = {r["file"].rsplit("/", 1)[1] for r in top.filter(F.col("top") <= low_watermark).collect()}  # one row a file
    return drop(spark, [f for f in segments(spark, path) if f.rsplit("/", 1)[1] in gone])


def drop(spark: SparkSession, names: list[str]) -> int:
    for name in names:
        fs, p = files.at(spark, name)
        fs.delete(p, False)
    return len(names)


def media(spark: SparkSession, path: str, code: int) -> DataFrame:
    """Files as tagged values: the kind's code before the bytes."""
    d = spark.read.format("binaryFile").load(path)
    return d.select(F.col("path").alias("key"), F.concat(F.lit(bytes([code])), "content").alias("value"), F.unix_micros("modificationTime").alias("timestamp"))
