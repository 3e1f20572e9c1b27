"""Contiguous shards of balanced bytes, from global prefix sums.

Rows are put in the order of the identifier (sampled ranges), numbered and summed inside
each range; the totals of the ranges, one row each, give every range its start. A row's place on
the byte line decides its shard: the line is cut at equal targets, and a row goes where its middle
lies, so no shard is off by more than the largest row. Only built-in DataFrame functions.

Defined results: null text has no bytes and size 1; null identifiers come first; rows that repeat an
identifier follow each other by size and checksum; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgate.llm.common import materialise, unused


def balanced_shards(df: DataFrame, shards: int, size_col: str, order: list[str]) -> DataFrame:
    """df with shard (0 to shards-1) and slot (gapless from 0 in each shard).

    order must be total up to rows that are equal in all columns; a row number breaks such ties when
    ranges are cut, so that a key on a third of all rows still spreads. df is written to
    the shared folder once: pass the columns that are needed, not the texts."""
    keys = [f"k{i}" for i in range(len(order))]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(size_col).alias("size"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], F.monotonically_increasing_id().alias("tie"))
    ranged = packed.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").select("row", "size")
    # the range and the place in it, in one number: fixed by the write, whatever is run again later
    placed = materialise(ranged.withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("at", 33))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, not for each document
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r0"), F.sum("bytes").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("part").orderBy("at")
    lined = placed.withColumns({"b": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"), "r": F.row_number().over(inside) - 1})
    lined = lined.join(F.broadcast(starts), "part")  # a row for each range
    twice = lined.withColumn("twice", F.lit(2) * (F.col("b") + F.col("b0")) + F.col("size"))  # twice the middle: whole numbers throughout
    cut = F.expr(f"CAST(least({shards - 1}, twice * {shards} DIV greatest(1, 2 * `all`)) AS INT)")
    numbered = twice.select("row", cut.alias("shard"), (F.col("r") + F.col("r0")).alias("rank"))
    firsts = numbered.groupBy("shard").agg(F.min("rank").alias("first"))
    out = numbered.join(F.broadcast(firsts), "shard")  # a row for each shard
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in ("shard", "slot")], "shard", (F.col("rank") - F.col("first")).alias("slot"))


def document_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law `bytes`."""
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    cut = balanced_shards(slim, shards, "size", ["doc_id", "size", "text_crc32"])
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs to path/shard=N. An identifier on several rows goes where its first row goes."""
    own = unused(docs, "__id")
    placed = document_shards(docs, shards, id_col, text_col).groupBy(F.col("doc_id").alias(own)).agg(F.min("shard").alias("shard"))
    docs.drop("shard").join(placed, F.col(id_col).eqNullSafe(F.col(own))).drop(own).write.partitionBy("shard").parquet(path)
