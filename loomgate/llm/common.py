"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgate.operators.ranges import materialise

__all__ = ["bounded_broadcast", "materialise", "meetings", "read", "text_of", "type_of", "unused", "without"]

#: Rows, and bytes of texts, up to which a side of a join may be broadcast; above it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows and BROADCAST_BYTES of texts, else unchanged (the join then shuffles).

    df must be cheap to count: a materialised table, whose files tell their row counts."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    if not texts:
        return F.broadcast(df) if df.count() <= limit else df
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(reduce(add, texts)), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key isn't in ids (one column, materialised). Null keys stay."""
    name = unused(df, "__gone")
    gone = ids.select(F.col(ids.columns[0]).alias(name))
    return df.join(bounded_broadcast(gone), F.col(key) == F.col(name), "left_anti")


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, i, j -> a table for each of those."""
    held: pa.Table | None = None
    for b in batches:
        if b.num_rows:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            at = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist()]
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield table.slice(start, end - start)
            held = table.slice(cuts[-1])
    if held is not None:
        yield held
