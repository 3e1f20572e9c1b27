"""Levels of a table of contents from the indents of its entries, for tables of any size.

An entry with a larger indent than the one before it is one level below that; with the same indent it is on its level; with a smaller one it is on the
level that this indent had last, or, if it never stood before, one above the entry before (the top level stays). So each entry hangs on one earlier entry by a
function max(floor, level + step), and such functions compose to one of their kind: entries follow their pointers by doubling, in rounds
that grow with the logarithm of the longest chain, whatever table holds most rows.

Where no table has more rows than one task may hold (see ranges), tables are sorted whole and their entries followed one after the other: one shuffle, and
nothing is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomgate.operators import ordered, ranges
from loomgate.operators.ranges import materialise

#: No floor.
_DEEP = -(1 << 40)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., __indent, __first) of tables in order -> those without the last two, with the level as __level."""
    last, at, had = 0.0, 0, {}
    for b in batches:
        out = []
        for x, first in zip(b.column("__indent").to_pylist(), b.column("__first").to_pylist(), strict=True):
            if first:
                last, at, had = 0.0, 0, {}
            x = 10**400 + (x != x) if x != x or x == float("inf") else x  # noqa: PLW2901 - Spark's order: NaN equals itself and is above infinity
            if x > last:
                at += 1
            elif x < last:
                at = had.get(x, max(0, at - 1))
            last, had[x] = x, at
            out.append(at)
        kept = b.drop_columns(["__indent", "__first"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], names=[*kept.schema.names, "__level"])


def levels(df: DataFrame, keys: list[str], order: list[str], indent: str, name: str = "level") -> DataFrame:
    """df with the level of each entry, from 0. A null indent counts as 0.

    The entry before the first is taken to have indent and level 0. Entries that are equal in order are told apart as ranges does."""
    own = df.withColumn("__indent", F.coalesce(F.col(indent).cast("double"), F.lit(0.0)))
    whole = ranges.ranged(own, keys, order)
    if ranges.PART not in whole.columns:
        first = (F.row_number().over(Window.partitionBy(*keys).orderBy(ranges.AT)) == 1).alias("__first")
        schema = StructType([*df.schema.fields, StructField("__level", IntegerType())])
        return whole.select(*[F.col(f"`{c}`") for c in df.columns], "__indent", first).mapInArrow(_followed, schema).withColumnRenamed("__level", name)
    placed = materialise(ranges.sums_to_here(whole, keys, {"__place": F.lit(1).cast("long")}).drop(ranges.PART, ranges.AT), "entries")
    before = ranges.row_before(ranges.ranged(placed, keys, ["__place"]), keys, ["__indent"], "__before").drop(ranges.PART, ranges.AT)
    same = ranges.row_before(ranges.ranged(before, [*keys, "__indent"], ["__place"]), [*keys, "__indent"], ["__place"], "__same").drop(ranges.PART, ranges.AT)
    last = F.coalesce(F.col("__before.__indent"), F.lit(0.0))
    down, up = F.col("__indent") > last, F.col("__indent") < last
    back = up & F.col("__same").isNotNull()
    state = same.select(
        *keys, "__place", F.when(back, F.col("__same.__place")).otherwise(F.col("__place") - 1).alias("to"),
        F.when(down, 1).when(up & ~back, -1).otherwise(0).cast("long").alias("step"), F.when(up & ~back, 0).otherwise(F.lit(_DEEP)).cast("long").alias("floor"),
    )
    state = materialise(state, "levels")
    while not (waiting := state.where("to > 0")).isEmpty():
        own_keys = [f"__k{i}" for i in range(len(keys))]
        above = state.select(*[F.col(k).alias(o) for k, o in zip(keys, own_keys, strict=True)], F.col("__place").alias("__at"), F.col("to").alias("to2"), F.col("step").alias("step2"), F.col("floor").alias("floor2"))
        same_group = F.col("to") == F.col("__at")
        for k, o in zip(keys, own_keys, strict=True):
            same_group = same_group & F.col(k).eqNullSafe(F.col(o))
        followed = waiting.join(above.hint("merge"), same_group).select(*keys, "__place", F.col("to2").alias("to"), (F.col("step") + F.col("step2")).alias("step"), F.greatest(F.col("floor"), F.col("floor2") + F.col("step")).alias("floor"))
        state = materialise(followed.unionByName(state.where("to = 0")), "levels")
    found = state.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__place").alias("__at"), F.greatest("floor", "step").cast("int").alias(name))
    match = F.col("__place") == F.col("__at")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(found, match).drop("__indent", "__place", "__at", *[f"__k{i}" for i in range(len(keys))])
