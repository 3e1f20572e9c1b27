"""Aggregates with fixed tie rules: modes, upper medians, weighted means, extents, top shares, guards."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgate.operators import ranges


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column, order: str) -> DataFrame:
    """keys, mode, weight: of each group the value of the largest summed weight, of equal ones the first in order.

    Two aggregations, both with partial sums: no group is gathered."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"), F.min(order).alias("first"))
    best = sums.groupBy(*keys).agg(F.max_by(F.struct(value, "weight"), F.struct(F.col("weight"), -F.col("first"))).alias("best"))
    return best.select(*keys, F.col(f"best.{value}").alias("mode"), F.col("best.weight").alias("weight"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the entry at place floor(n/2), from 0, of the sorted values; no mean of two.

    Equal values are counted before they are ordered, and running counts come in ranges, so that a group of any size is spread."""
    counted = ranges.materialise(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), "counted")
    placed = ranges.sums_to_here(ranges.ranged(counted, keys, [value]), keys, {"__upto": F.col("n")})
    own = [f"__key{i}" for i in range(len(keys))]
    half = counted.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]).agg(F.floor(F.sum("n") / 2).alias("__half"))
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)], F.lit(True))
    found = placed.join(half if keys else F.broadcast(half), same)
    return found.where((F.col("__upto") > F.col("__half")) & (F.col("__upto") - F.col("n") <= F.col("__half"))).select(*keys, F.col(value).alias("median"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def extents(x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    return [F.min(x).alias("left"), F.min(y).alias("top"), F.max(x + width).alias("right"), F.max(y + height).alias("bottom")]


def top_share(df: DataFrame, keys: list[str], by: Column, order: list[str], share: float = 0.2, least: int = 8, most: int = 256) -> DataFrame:
    """The rows of each group with the largest `by`: the given share of it, at least and at most so many."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(by.desc(), *order)))
    sizes = df.groupBy(*keys).agg(F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.count("*") * share))).alias("room"))
    return ranked.where(f"place <= {most}").join(sizes, keys).where("place <= room").drop("room")


def tri_state(flag: Column) -> Column:
    """all, none or some."""
    return F.when(F.bool_and(flag), "all").when(~F.bool_or(flag), "none").otherwise("some")


def size_guard(files: DataFrame, length: str, largest: int = 2 * 1024**3, total: int = 4 * 1024**3) -> DataFrame:
    """One row n, bytes; an error if a file or the sum is too large."""
    sums = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes"), F.max(length).alias("most"))
    return sums.select("n", F.when(F.col("most") > largest, F.raise_error(F.lit("A file exceeds the size limit")).cast("long")).when(F.col("bytes") > total, F.raise_error(F.lit("The batch exceeds the size limit")).cast("long")).otherwise(F.col("bytes")).alias("bytes"))


def not_empty(df: DataFrame, message: str) -> DataFrame:
    """df, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def at_most(df: DataFrame, n: int, what: str) -> DataFrame:
    """df, or an error if it has more than n rows; only n + 1 of them are counted."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"More than {n} {what}")
    return df
