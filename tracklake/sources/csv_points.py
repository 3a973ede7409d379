"""Raw CSV to typed points, and the conversion to Parquet."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.schema import KEPT_COLUMNS, NULL_TOKENS, RAW_COLUMNS, TYPES
from tracklake.sources.parquet import delete, exists, size_of, write_parquet

log = logging.getLogger(__name__)


def chosen_columns(keep: str | list[str] | None) -> list[str]:
    """The wanted columns in the wanted order; a string lists them between commas."""
    if keep is None:
        return list(KEPT_COLUMNS)
    names = [c.strip() for c in keep.split(",")] if isinstance(keep, str) else list(keep)
    if unknown := [c for c in names if c not in RAW_COLUMNS]:
        raise ValueError(f"unknown columns {unknown}; there are {RAW_COLUMNS}")
    return names


def read_points(spark: SparkSession, path: str, columns: str | list[str] | None = None, timestamp_format: str | None = None) -> DataFrame:
    """Points of a headerless file. All null tokens, and what can't be read as its column's type, become null.

    Everything is read as text first, since the reader takes one null token only; unused columns aren't parsed.
    """
    names = chosen_columns(columns)
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])).csv(path, mode="PERMISSIVE")
    return raw.select(*[typed(c, timestamp_format).alias(c) for c in names])


def typed(column: str, timestamp_format: str | None) -> F.Column:
    text = F.trim(F.col(column))
    text = F.when(~text.isin(NULL_TOKENS), text)
    kind = TYPES.get(column, T.StringType())
    if isinstance(kind, T.TimestampNTZType):
        if timestamp_format is None:
            return text.try_cast(kind)
        return F.try_to_timestamp(text, F.lit(timestamp_format)).cast(kind)
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def convert_csv(spark: SparkSession, path: str, output: str | None = None, compression: str = "zstd", columns: str | list[str] | None = None, timestamp_format: str | None = None, single_file: bool = False) -> str:
    """The file's points as Parquet; by default beside it, with the ending changed. A failed conversion leaves nothing behind."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    where = output or (path.removesuffix(".csv") + ".parquet")
    points = read_points(spark, path, columns, timestamp_format)
    began = time.monotonic()
    try:
        write_parquet(points, where, compression, single_file)
    except Exception:
        delete(spark, where)
        raise
    log.info("converted %s in %.1f s: %d to %d bytes", path, time.monotonic() - began, size_of(spark, path), size_of(spark, where))
    return where
