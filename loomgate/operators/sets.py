"""Set operations over formats and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_values(df: DataFrame, item: str, value: str, keys: list[str] = []) -> DataFrame:
    """keys, value: those that every item of a group has (relational division); none if there is no item.

    Pairs are made distinct first, so both counts have partial sums and no group is gathered."""
    had = df.select(*keys, item, value).distinct().groupBy(*keys, value).agg(F.count("*").alias("had"))
    all_of = df.select(*keys, item).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    if not keys:
        return had.join(F.broadcast(all_of), F.col("had") == F.col("n")).select(value)
    return had.join(all_of, keys).where("had = n").select(*keys, value)


def status_counts(df: DataFrame, keys: list[str], status: str, names: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == n).alias(f"n_{n}") for n in names])
