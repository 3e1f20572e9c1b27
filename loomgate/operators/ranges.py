"""Ordered work over groups of any size: rows in sampled ranges, and what crosses the ends of ranges.

A window over a group puts the whole group in one task. Here rows are sorted by keys and order and
cut into ranges by sampled splitters, so a group may lie over many ranges. The ranges are written once, in
the folder that the cluster shares, as sampling again would cut elsewhere. Only the first group of a range can go on from an
earlier one; so what enters ranges is a row for each range at most, and is broadcast.
"""

from __future__ import annotations

import functools
import operator
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that ranged() adds: the number of the range, and the place of the row in the whole order.
PART, AT = "__part", "__at"
#: Rows of a group up to which one task may hold it.
WINDOW_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it isn't set, a local session gets a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/loomgate-checkpoints"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, among those that discard() deletes."""
    return f"{shared_dir(spark)}/loomgate-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> bool:
    """Delete the tables that materialise() wrote in this application; call it when no query needs them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomgate-{spark.sparkContext.applicationId}")
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage and holds row order-dependent values still; as the files are shared,
    a lost executor costs nothing that was finished. The job runs at once, while the query is built; discard() deletes the files."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with PART and AT. Rows that are equal in keys and order are told apart by a hash of all their columns, so their order doesn't depend on their number; rows
    that are equal in that too (or hold maps, which have no hash) by a row number, so that they spread.

    Where no group has more than WINDOW_ROWS rows there is AT only, and a group is one window: the same results without a
    written copy of the rows."""
    hashed = all(not re.search(r"\b(map<|variant)", f.dataType.simpleString()) for f in df.schema)
    own = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if hashed else F.lit(0)
    if hashed and (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= WINDOW_ROWS:
        return df.withColumn(AT, F.struct(*order, own))
    by = [*keys, *order, "__hash", "__tie"]
    tied = df.withColumns({"__hash": own, "__tie": F.monotonically_increasing_id()})
    placed = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("__hash", "__tie").withColumn(AT, F.monotonically_increasing_id())
    return materialise(placed, "ranges").withColumn(PART, F.shiftright(AT, 33))


def _inside(placed: DataFrame, keys: list[str]):
    return Window.partitionBy(*([PART] if PART in placed.columns else []), *keys).orderBy(AT)


def _entering(placed: DataFrame, keys: list[str], totals: dict[str, Column], fold: Callable[[str], Column]) -> DataFrame:
    """placed with, under each name, the fold of the totals that the row's group has in earlier ranges; null if it has none."""
    if PART not in placed.columns:
        return placed.withColumns({n: F.lit(None) for n in totals})
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(PART, *keys).agg(*[c.alias(n) for n, c in totals.items()])
    found = sums.withColumns({n: fold(n).over(before) for n in totals}).where(functools.reduce(operator.or_, [F.col(n).isNotNull() for n in totals]))
    own = [f"__key{i}" for i in range(len(keys))]
    found = found.select(F.col(PART).alias("__of"), *[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *totals)
    same = [F.col(PART) == F.col("__of"), *[F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]]
    return placed.join(F.broadcast(found), functools.reduce(operator.and_, same), "left").drop("__of", *own)


def sums_to_here(placed: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """placed with, under each name, the sum of the group's values up to and with the row; nulls count as 0."""
    names = list(values)
    upto = _inside(placed, keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enters = [f"__in_{n}" for n in names]
    wide = _entering(placed.withColumns({n: F.coalesce(v, F.lit(0)) for n, v in values.items()}), keys, {e: F.sum(n) for e, n in zip(enters, names, strict=True)}, F.sum)
    return wide.withColumns({n: F.sum(n).over(upto) + F.coalesce(e, F.lit(0)) for n, e in zip(names, enters, strict=True)}).drop(*enters)


def last_to_here(placed: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """placed with the group's last value that isn't null, up to and with the row."""
    upto = _inside(placed, keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn(name, value)
    wide = _entering(own, keys, {"__last": F.max_by(name, F.when(F.col(name).isNotNull(), F.col(AT)))}, lambda n: F.last(n, ignorenulls=True))
    return wide.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(upto), "__last")).drop("__last")


def row_before(placed: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """placed with a struct of columns of the row before in the group; null for the first."""
    row = F.struct(*columns)
    wide = _entering(placed, keys, {"__last": F.max_by(row, AT)}, F.last)
    return wide.withColumn(name, F.coalesce(F.lag(row).over(_inside(placed, keys)), "__last")).drop("__last")
