"""Column profiles: one pass over the table, one row for each column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = "column string, dtype string, missing_count bigint, missing_pct double, unique bigint, mean double, std double, min string, max string"


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: type, nulls, their percentage, distinct values (null is one), mean, standard deviation, least, greatest.

    Mean and deviation are null for what is not a number. An empty table has an empty profile.
    """
    names = list(columns or df.columns)
    if missing := set(names) - set(df.columns):
        raise ValueError(f"Columns not found: {sorted(missing)}")
    parts = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        number = isinstance(df.schema[c].dataType, T.NumericType)
        parts += [F.count_if(col.isNull()).alias(f"nulls_{i}"), (F.count_distinct(col) + F.max(col.isNull().cast("int"))).alias(f"unique_{i}"), F.min(col).cast("string").alias(f"min_{i}"), F.max(col).cast("string").alias(f"max_{i}")]
        parts += [(f(col) if number else F.lit(None).cast("double")).alias(f"{n}_{i}") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts).filter("n > 0")
    told = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col(f"nulls_{i}").alias("missing_count"), (F.col(f"nulls_{i}") / F.col("n") * 100).alias("missing_pct"), F.col(f"unique_{i}").cast("bigint").alias("unique"), F.col(f"mean_{i}").cast("double").alias("mean"), F.col(f"std_{i}").alias("std"), F.col(f"min_{i}").alias("min"), F.col(f"max_{i}").alias("max")) for i, c in enumerate(names)]
    return row.select(F.inline(F.array(*told)))


def profile_as_dict(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """The profile as a dictionary by column; it has one entry for each column of the table."""
    return {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in profile(df, columns).collect()}
