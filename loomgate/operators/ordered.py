"""Ordered operations: islands, offsets, carried values, unique names. Groups may be of any size (see ranges)."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.operators import ranges

_PLACES = (ranges.PART, ranges.AT)


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Callable[[Column], Column], needs: list[str], name: str = "island") -> DataFrame:
    """df with the number of the island of each row, from 0; a row where breaks holds begins a new one.

    breaks gets a struct of the columns `needs` of the row before (null for the first row of a group)."""
    placed = ranges.row_before(ranges.ranged(df, keys, order), keys, needs, "__before")
    new = F.coalesce(breaks(F.col("__before")), F.lit(False)).cast("int")
    return ranges.sums_to_here(placed, keys, {name: new}).drop("__before", *_PLACES)


def joined_text(df: DataFrame, keys: list[str], text: str, order: list[str], separator: str) -> DataFrame:
    """keys, text: the texts of each group in order, joined."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"]), separator).alias(text))


def running_offsets(df: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """df with start and end: each row begins where the one before ends. A null length counts as 0."""
    found = ranges.sums_to_here(ranges.ranged(df, keys, order), keys, {"end": F.col(length)})
    return found.withColumn("start", F.col("end") - F.coalesce(length, F.lit(0))).drop(*_PLACES)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with the number of the row in its group, from 1."""
    return ranges.sums_to_here(ranges.ranged(df, keys, order), keys, {name: F.lit(1).cast("long")}).drop(*_PLACES)


def lead_ranges(df: DataFrame, keys: list[str], offset: str, order: tuple[str, ...] = ()) -> DataFrame:
    """df with end: the next offset, null for the last. Rows with the same offset follow each other in the order of numeric columns."""
    down = {f"__down{i}": -F.col(c) for i, c in enumerate((offset, *order))}
    placed = ranges.ranged(df.withColumns(down), keys, list(down))
    return ranges.row_before(placed, keys, [offset], "__next").withColumn("end", F.col(f"__next.`{offset}`")).drop(*down, "__next", *_PLACES)


def with_neighbours(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """df with before and next: the column in the rows before and after, by a numeric order; null at the ends of a group."""
    placed = ranges.row_before(ranges.ranged(df, keys, [order]), keys, [column], "__before")
    back = placed.withColumn("before", F.col(f"__before.`{column}`")).drop("__before", *_PLACES).withColumn("__down", -F.col(order))
    return ranges.row_before(ranges.ranged(back, keys, ["__down"]), keys, [column], "__next").withColumn("next", F.col(f"__next.`{column}`")).drop("__down", "__next", *_PLACES)


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null, up to each row."""
    return ranges.last_to_here(ranges.ranged(df, keys, order), keys, value, name).drop(*_PLACES)


def running_mean(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "mean") -> DataFrame:
    """df with the mean of the values up to each row, nulls left out."""
    sums = ranges.sums_to_here(ranges.ranged(df, keys, order), keys, {"__sum": F.col(value), "__n": F.col(value).isNotNull().cast("long")})
    return sums.withColumn(name, F.try_divide("__sum", "__n")).drop("__sum", "__n", *_PLACES)


def numbered_names(df: DataFrame, keys: list[str], name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """df with names made unique in each group: the first of equal names keeps it, the others get -2, -3, … before the extension.

    Numbers with which a made name would be one that stands in the data are passed over. Repeats
    of names with the same stem and extension share their numbers, so that no two made names are equal. A
    taken number t, the i-th of its stem, has t - 2 - i free ones before it; put in one order with the repeats, running counts of the taken give each repeat its number."""
    base, ext = F.regexp_replace(name, r"\.[^.]+$", ""), F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    stem = F.when(F.length(base) > 0, base).otherwise("converted-file")
    places = numbered(df.withColumns({"__stem": stem, "__ext": ext}), [*keys, name], order, "__n")
    firsts, repeats = places.where("__n = 1"), places.where("__n > 1")
    group = [*keys, "__stem", "__ext"]
    tail = F.regexp_extract("__stem", r"^(.*)-([1-9][0-9]{0,8})$", 2)
    exact = F.concat("__stem", F.when(F.col("__ext") != "", F.concat(F.lit("."), "__ext")).otherwise(""))  # what made names look like
    taken = firsts.where((tail != "") & (F.col(name) == exact)).select(*keys, F.regexp_extract("__stem", r"^(.*)-([1-9][0-9]{0,8})$", 1).alias("__stem"), "__ext", tail.cast("long").alias("__t")).where("__t >= 2")
    taken = numbered(taken, group, ["__t"], "__i").select(*group, (F.col("__t") - 1 - F.col("__i")).alias("__at0"), F.lit(0).alias("__side"), F.lit(1).cast("long").alias("__one"))
    waiting = numbered(repeats, group, order, "__r")
    both = waiting.withColumns({"__at0": F.col("__r") - 1, "__side": F.lit(1), "__one": F.lit(0).cast("long")}).unionByName(taken, allowMissingColumns=True)
    passed = ranges.sums_to_here(ranges.ranged(both, group, ["__at0", "__side"]), group, {"__passed": F.col("__one")}).where("__side = 1")
    made = F.concat("__stem", F.lit("-"), (F.col("__at0") + 2 + F.col("__passed")).cast("string"), F.when(F.col("__ext") != "", F.concat(F.lit("."), "__ext")).otherwise(""))
    return firsts.select(*df.columns, F.col(name).alias(out)).unionByName(passed.select(*df.columns, made.alias(out)))


def padded_label(place: Column, total: Column, prefix: str) -> Column:
    """prefix and the place, filled with zeros to the width of total."""
    return F.concat(F.lit(prefix), F.lpad(place.cast("string"), F.length(total.cast("string")), F.lit("0")))


def gap_spaces(gap: Column, height: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """The blanks for a gap between two pieces of text: none if it is narrow or null, else 1 to 6. If the texts
    before and after it are given, none beside white space either."""
    n = F.floor(gap / (height * 0.42) + 0.5).cast("int")
    spaced = [c.rlike(p) for c, p in ((before, r"(?U)\s$"), (after, r"(?U)^\s")) if c is not None]
    beside = F.coalesce(functools.reduce(operator.or_, spaced), F.lit(False)) if spaced else F.lit(False)
    return F.when(gap.isNull() | (gap <= height * 0.08) | beside, "").otherwise(F.repeat(F.lit(" "), F.greatest(F.lit(1), F.least(F.lit(6), n))))
