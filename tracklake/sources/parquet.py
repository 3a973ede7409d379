"""Parquet and CSV sinks, and the file operations they need, by Hadoop's file system: any store that Spark reads."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
CODECS = ("zstd", "snappy", "gzip", "lz4")


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def size_of(spark: SparkSession, path: str) -> int:
    fs, where = file_system(spark, path)
    return fs.getContentSummary(where).getLength()


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", single_file: bool = False) -> None:
    if compression not in CODECS:
        raise ValueError(f"compression must be one of {CODECS}, not {compression!r}")
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("compression", compression).parquet(path)


def save_parquet(df: DataFrame, path: str, label: str | None = None, compression: str = "zstd") -> int:
    """Writes the table and logs its shape; rows are counted as they are written."""
    seen = Observation()
    write_parquet(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, compression)
    rows = seen.get["rows"]
    log.info("saved %s to %s: %d rows, %d columns", label or path, path, rows, len(df.columns))
    return rows


def save_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
