"""Records that may hold their own separator, out of files that many tasks read at once: CSV rows whose quoted cells hold line ends.

Spark cuts a file into blocks at any byte and gives each block the lines that begin there. Whether a line end ends a row depends on
the quotes before it, in the whole file, but only on their parity:

1. A first pass counts each block's lines and quotes; prefix sums over the blocks of a file give each the parity before it.
2. A second pass counts each block's rows, and keeps the text before the first row end of a block that begins inside a row, and the text
   behind the last row end. Prefix sums give each block the number of its first row.
3. A third pass gives the rows that lie in one block. Rows over several blocks are put together from the texts of the second.

Between passes there is one small row for each block. No row is sent anywhere but those texts, and every row knows its number in the file.

Defined results: line ends are \\n or \\r\\n; those inside quotes stay as they are; an open quote at the end of a file leaves one last row; a mark of byte
order at the start is dropped; an empty file has no rows. All passes have to see the same blocks: should the number of
executors change Spark's choice in between, a pass fails instead of giving other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomgate.operators.ranges import materialise

FILE, BLOCK = "__file", "__block"


def blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """FILE, BLOCK (the byte at which Spark's block starts), value: the pieces between separators, in order in a block."""
    return spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), "value")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of batches that lie in one block, each with whether a block begins there."""
    before = None
    for b in batches:
        if b.num_rows:
            file, block = b.column(0), b.column(1).to_numpy()
            same_file = pc.equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | ~same_file) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                key = (file[start].as_py(), int(block[start]))
                yield key != before, b.slice(start, end - start)
                before = key


def _row(schema: dict[str, pa.DataType], values: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.values(), strict=True)], names=list(schema))


def same_block(left: str, right: str) -> Column:
    return (F.col(FILE) == F.col(left)) & (F.col(BLOCK) == F.col(right))


def with_blocks(pieces: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pieces with columns of a table of blocks, which is broadcast: a few numbers for each block."""
    own = table.select(F.col(FILE).alias("__f"), F.col(BLOCK).alias("__b"), *columns)
    return pieces.join(F.broadcast(own), same_block("__f", "__b"), "left").select(FILE, BLOCK, "value", *columns)


def parities(pieces: DataFrame, quotes: Column) -> DataFrame:
    """FILE, BLOCK, pieces (their number), odd, parity: whether the quotes of the block, and those before it in the file, are odd. Written."""
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    counts = pieces.groupBy(FILE, BLOCK).agg(F.count("*").alias("pieces"), (F.sum(quotes) % 2).cast("int").alias("odd"))
    return materialise(counts.withColumn("parity", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int")), "blocks")


def changed(key: tuple[str, int], seen: int, wanted: int | None) -> RuntimeError:
    return RuntimeError(f"{key[0]} was cut into other blocks than before: {seen} pieces at {key[1]}, not {wanted}")


_EDGES = {FILE: pa.string(), BLOCK: pa.int64(), "ends": pa.int64(), "head": pa.string(), "tail": pa.string()}
_EDGES_SQL = f"{FILE} string, {BLOCK} long, ends long, head string, tail string"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(FILE, BLOCK, line, parity before the block) -> a row for each block: the rows that end in it, the text up to the first end if a row of
    before goes on there, and the text behind the last end if a row is open."""
    key, parity, ends, head, tail = None, 0, 0, None, []

    def close() -> pa.RecordBatch:
        left = "\n".join(tail) if parity and (ends or head is None) else None
        return _row(_EDGES, (*key, ends, None if head is None else "\n".join(head), left))

    for new, run in runs(batches):
        if new:
            if key is not None:
                yield close()
            key, parity, ends = (run.column(0)[0].as_py(), run.column(1)[0].as_py()), run.column(3)[0].as_py(), 0
            if parity is None:
                raise changed(key, 0, None)
            head, tail = [] if parity else None, []
        value = run.column(2)
        after = (np.cumsum(pc.count_substring(value, '"').to_numpy()) + parity) & 1
        at = np.flatnonzero(after == 0)
        if head is not None and not ends:
            head += value[: int(at[0]) + 1 if len(at) else len(value)].to_pylist()
        if len(at):
            tail = []
        if ends or len(at) or head is None:
            tail += value[int(at[-1]) + 1 if len(at) else 0 :].to_pylist()
        ends, parity = ends + len(at), int(after[-1])
    if key is not None:
        yield close()


_ROWS = {FILE: pa.string(), "row": pa.int64(), "value": pa.string()}


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(FILE, BLOCK, line, parity before the block, its first row, its lines) -> FILE, row, value of the rows that lie in the block."""
    key, seen, lines, row, parity, skip = None, 0, 0, 0, 0, False
    held: list[str] = []

    def check() -> None:
        if seen != lines:
            raise changed(key, seen, lines)

    for new, run in runs(batches):
        value = run.column(2)
        if new:
            if key is not None:
                check()
            key, seen, held = (run.column(0)[0].as_py(), run.column(1)[0].as_py()), 0, []
            parity, row, lines = (run.column(i)[0].as_py() for i in (3, 4, 5))
            if lines is None:
                raise changed(key, 0, None)
            skip = parity == 1  # the first row began in an earlier block
        seen += len(value)
        after = (np.cumsum(pc.count_substring(value, '"').to_numpy()) + parity) & 1
        parity = int(after[-1])
        ends = np.flatnonzero(after == 0)
        if not len(ends):
            held += value.to_pylist()
            continue
        starts = np.concatenate([[0], ends[:-1] + 1])
        texts = value.take(pa.array(ends))
        several = np.flatnonzero(starts != ends).tolist()
        if several or held:
            listed = texts.to_pylist()
            for i in {0, *several}:
                listed[i] = "\n".join([*(held if i == 0 else []), *value[int(starts[i]) : int(ends[i]) + 1].to_pylist()])
            texts = pa.array(listed, pa.string())
        numbers = row + np.arange(len(ends))
        first = int(skip)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * (len(ends) - first), pa.string()), pa.array(numbers[first:]), texts[first:]], names=list(_ROWS))
        row, skip, held = row + len(ends), False, value[int(ends[-1]) + 1 :].to_pylist()
    if key is not None:
        check()


def quoted_rows(spark: SparkSession, path: str) -> DataFrame:
    """FILE, row (its number in the file, from 0), value: the rows of text files whose quoted parts may hold line ends."""
    lines = blocks(spark, path, "\n")
    found = parities(lines, F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    edges = with_blocks(lines, found, ["parity"]).mapInArrow(_edges, _EDGES_SQL)
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    placed = materialise(edges.join(found, [FILE, BLOCK]).withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0))), "placed")

    parts = F.array(F.struct(F.col("first").alias("row"), F.lit(0).alias("side"), F.col("head").alias("text")), F.struct((F.col("first") + F.col("ends")).alias("row"), F.lit(1).alias("side"), F.col("tail").alias("text")))
    cut = placed.select(FILE, BLOCK, F.explode(parts).alias("p")).where("p.text IS NOT NULL").groupBy(FILE, F.col("p.row").alias("row")).agg(F.array_sort(F.collect_list(F.struct(F.col(BLOCK), "p.side", "p.text"))).alias("parts"))
    over = cut.select(FILE, "row", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("value"))
    inside = with_blocks(lines, placed, ["parity", "first", "pieces"]).mapInArrow(_whole_rows, f"{FILE} string, row long, value string")
    text = F.regexp_replace(F.col("value"), r"\r$", "")
    return inside.unionByName(over).select(FILE, "row", F.when(F.col("row") == 0, F.regexp_replace(text, "^﻿", "")).otherwise(text).alias("value"))


def _parsed(rows: DataFrame, separator: str, **options) -> DataFrame:
    """A column of texts, each one row, through Spark's own CSV reader, which takes a dataset of texts from the JVM only."""
    spark = rows.sparkSession
    reader = spark.read.options(sep=separator, quote='"', escape='"', multiLine=True, **{k: v for k, v in options.items() if k != "schema"})
    reader = reader.schema(options["schema"]) if "schema" in options else reader
    return reader._df(reader._jreader.csv(getattr(rows._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())))


def _names(cells: list[str | None]) -> list[str]:
    """Column names as Spark's reader makes them of a header: places for empty ones, and behind all that stand twice, whatever their case."""
    lowered = [(c or "").lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lowered.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_quoted(spark: SparkSession, path: str, separator: str = ",", infer: bool = True, in_order: bool = False, null: str | None = None) -> DataFrame:
    """Rows of separated files with a header, as Spark's own reader gives them, whatever quoted cells hold; each file is read by many tasks.

    The names are those of the first file's header; all files have to have the same columns. Without infer all columns are texts. With in_order
    rows are sorted by file and place, which moves them; else those over several blocks come last. Empty cells are null; if a text for null is given, quoted ones
    are empty texts."""
    options = {} if null is None else {"nullValue": null}
    rows = quoted_rows(spark, path)
    first = _parsed(rows.where("row = 0").orderBy(FILE).limit(1).select("value"), separator).first() or ()
    fields = [StructField(name, StringType()) for name in _names(list(first))]
    body = rows.where("row > 0")
    body = (body.orderBy(FILE, "row") if in_order else body).select("value")
    if infer and fields:
        kinds = _parsed(rows.where("row > 0").select("value"), separator, inferSchema=True, **options).schema
        fields = [StructField(f.name, kinds[i].dataType if i < len(kinds) else StringType()) for i, f in enumerate(fields)]
    return _parsed(body, separator, schema=StructType(fields), **options)
