"""Large JSON documents by many tasks: a structural index finds the members of the record array without holding a document.

Spark cuts a file at commas and gives each block the pieces that begin there. A block's brackets depend on whether it begins inside a
string, and their meaning on the brackets that are open before it. So:

1. A first pass counts each block's quotes; prefix sums tell whether a block begins inside a string.
2. A second pass finds how many open brackets of earlier blocks each block closes, and which of its own it leaves open, with
   their places. A fold over the blocks of a file, one row each, gives a block its start: the number of open objects, the
   array that is open in them and the depth in it.
3. A third pass cuts the arrays that stand in objects only (or at the root) at their commas; its parts are written, as counting, choosing and joining
   all read them. What lies over several blocks is put together by the number of its member. Counts for each block number the members.

The record array is the first, in the order of the document, that has no members but objects and arrays and is at most
MAX_DEPTH objects deep; else the root, if it is an array. A document with neither is one row, and is read whole.

Defined results: an empty record array gives no rows; of equal keys all count, in order; a document that ends inside a string or
a bracket is an error; an empty file is one too; all passes have to see the same blocks, or one of them fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgate.operators.ranges import materialise
from loomgate.sources.split import BLOCK, FILE, blocks, changed, parities, runs, with_blocks
from loomgate.sources.structured import row_texts

MAX_DEPTH = 5
_OPEN_OBJECT, _OPEN_ARRAY, _COMMA = b"{["[0], b"{["[1], b","[0]
#: What a byte outside strings does to the depth.
_DELTA = np.zeros(256, np.int64)
_DELTA[list(b"{[")], _DELTA[list(b"}]")] = 1, -1
_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[list(b"{}[],")] = True


def lexed(data: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, bytes, depths after them, whether the end is inside a string) of the brackets and commas outside strings; inside: 1 if data begin in one."""
    a = np.frombuffer(data, np.uint8)
    quote = a == b'"'[0]
    slash = a == b"\\"[0]
    if slash.any():  # a quote behind an odd number of backslashes ends no string
        at = np.arange(len(a))
        length = at - np.maximum.accumulate(np.where(slash, -1, at))
        quote[1:] &= length[:-1] % 2 == 0
    parity = (np.cumsum(quote) + inside) & 1
    places = np.flatnonzero(_STRUCTURE[a] & (parity == 0))
    kinds = a[places]
    return places, kinds, np.cumsum(_DELTA[kinds]), int(parity[-1]) if len(a) else inside


def _left_open(places: np.ndarray, kinds: np.ndarray, depths: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """How many brackets of before are closed, and the (byte, place) of those that stay open."""
    if not len(depths):
        return 0, []
    least = np.minimum.accumulate(depths[::-1])[::-1]
    stay = (_DELTA[kinds] == 1) & (least >= depths)
    return max(0, -int(depths.min())), list(zip(kinds[stay].tolist(), places[stay].tolist(), strict=True))


def _bytes(run: pa.RecordBatch) -> bytes:
    return ",".join(run.column(2).to_pylist()).encode() + b","


_INDEX = f"{FILE} string, {BLOCK} long, pieces long, parity int, odd int, closed long, open array<array<long>>"
_INDEX_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64())))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(FILE, BLOCK, piece, pieces, parity, odd) -> a row for each block; see _INDEX. open: (byte, place) of each bracket."""
    known, offset, inside, closed, stack = None, 0, 0, 0, []

    def close() -> pa.RecordBatch:
        values = (*known, closed, [list(x) for x in stack])
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _INDEX_TYPES, strict=True)], names=[FILE, BLOCK, "pieces", "parity", "odd", "closed", "open"])

    for new, run in runs(batches):
        if new:
            if known is not None:
                yield close()
            known = tuple(run.column(i)[0].as_py() for i in (0, 1, 3, 4, 5))
            if known[2] is None:
                raise changed(known[:2], 0, None)
            offset, inside, closed, stack = 0, known[3], 0, []
        data = _bytes(run)
        places, kinds, depths, inside = lexed(data, inside)
        n, left = _left_open(places, kinds, depths)
        closed += max(0, n - len(stack))
        stack = stack[: max(0, len(stack) - n)] + [(k, offset + at) for k, at in left]
        offset += len(data)
    if known is not None:
        yield close()


_STARTS = f"{FILE} string, {BLOCK} long, pieces long, parity int, objects int, of_block long, of_place long, depth int"


def _starts(found: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one file, a row each -> the state in which each begins; of_block and of_place name the open array by the place of its bracket."""
    stack, out, inside = [], [], 0
    for r in found.sort_values(BLOCK).to_dict("records"):
        objects = next((i for i, (kind, *_) in enumerate(stack) if kind == _OPEN_ARRAY), len(stack))
        array = stack[objects] if objects < len(stack) else None
        out.append((r[FILE], r[BLOCK], r["pieces"], r["parity"], objects, array and array[1], array and array[2], len(stack) - objects - 1 if array else 0))
        if r["closed"] > len(stack):
            raise ValueError(f"{r[FILE]} closes a bracket that isn't open")
        stack = stack[: len(stack) - int(r["closed"])] + [(int(k), r[BLOCK], int(at)) for k, at in r["open"]]
        inside = r["parity"] ^ r["odd"]
    if stack or inside:
        raise ValueError(f"{found[FILE].iloc[0]} ends inside a {'string' if inside else 'bracket'}")
    return pd.DataFrame(out, columns=[FILE, BLOCK, "pieces", "parity", "objects", "of_block", "of_place", "depth"]).astype({"of_block": "Int64", "of_place": "Int64"})


_MEMBERS = {FILE: pa.string(), BLOCK: pa.int64(), "of_block": pa.int64(), "of_place": pa.int64(), "depth": pa.int32(), "k": pa.int64(), "whole": pa.bool_(), "ends": pa.bool_(), "begins": pa.bool_(), "text": pa.string()}
_MEMBERS_SQL = f"{FILE} string, {BLOCK} long, of_block long, of_place long, depth int, k long, whole boolean, ends boolean, begins boolean, text string"


class _Cutter:
    """Cuts the arrays of one block, fed in order; state is what _starts gives."""

    def __init__(self, file: str, block: int, inside: int, objects: int, array: tuple[int, int] | None, depth: int):
        self.file, self.block, self.inside, self.objects, self.array, self.depth = file, block, inside, objects, array, depth
        self.held: list[bytes] = []  # of a member that goes on in the next piece
        self.k = 0  # members that ended in this block, of the open array
        self.begins = array is not None and not inside and depth == 0  # a block begins behind a comma
        self.offset, self.out = 0, []

    def _emit(self, text: bytes | None, ends: bool) -> None:
        whole = text is not None and ends and self.begins
        self.out.append((self.file, self.block, *self.array, self.objects, self.k, whole, ends, self.begins, None if text is None else text.decode()))

    def feed(self, data: bytes) -> None:
        places, kinds, depths, self.inside = lexed(data, self.inside)
        i, at = 0, 0  # structural bytes and bytes that are done
        base = -self.depth  # depth of the open array's members, where this feed begins at 0
        while i < len(places):
            if self.array is None:
                kind = kinds[i]
                if kind == _OPEN_OBJECT:
                    self.objects += 1
                elif kind == _OPEN_ARRAY:
                    self.array, self.k, self.held, self.begins = (self.block, self.offset + int(places[i])), 0, [], True
                    at, base = int(places[i]) + 1, int(depths[i])
                elif kind != _COMMA:
                    self.objects -= 1
                i += 1
                continue
            below = depths[i:] < base
            end = i + int(below.argmax()) if below.any() else len(places)
            for j in (i + np.flatnonzero((kinds[i:end] == _COMMA) & (depths[i:end] == base))).tolist():
                self._emit(b"".join([*self.held, data[at : int(places[j])]]), True)
                self.held, self.begins, self.k, at = [], True, self.k + 1, int(places[j]) + 1
            i = end
            if end < len(places):  # the array closes
                text = b"".join([*self.held, data[at : int(places[end])]])
                self._emit(None if self.begins and not self.k and not text.strip() else text, True)
                self.array, self.held, i, at = None, [], end + 1, int(places[end]) + 1
        if self.array is not None:
            self.held.append(data[at:])
            self.depth = int(depths[-1] if len(depths) else 0) - base
        self.offset += len(data)

    def finish(self) -> None:
        """The block ends; a member that is open goes on in the next one, behind the comma that was added here."""
        if self.array is not None and (text := b"".join(self.held)):
            self._emit(text.removesuffix(b","), False)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(FILE, BLOCK, piece, pieces, parity, objects, of_block, of_place, depth) -> the parts of members in the block; see _MEMBERS."""
    cutter, seen, pieces = None, 0, 0

    def drained() -> Iterator[pa.RecordBatch]:
        if cutter.out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cutter.out), _MEMBERS.values(), strict=True)], names=list(_MEMBERS))
            cutter.out = []

    def done() -> Iterator[pa.RecordBatch]:
        if seen != pieces:
            raise changed((cutter.file, cutter.block), seen, pieces)
        cutter.finish()
        yield from drained()

    for new, run in runs(batches):
        if new:
            if cutter is not None:
                yield from done()
            file, block, _, pieces, inside, objects, of_block, of_place, depth = (c[0].as_py() for c in run.columns)
            if pieces is None:
                raise changed((file, block), 0, None)
            cutter, seen = _Cutter(file, block, inside, objects, None if of_block is None else (of_block, of_place), depth), 0
        seen += run.num_rows
        cutter.feed(_bytes(run))
        yield from drained()
    if cutter is not None:
        yield from done()


def members(spark: SparkSession, path: str) -> DataFrame:
    """FILE, of_block, of_place, depth, ord, text: the members of all arrays that stand in objects only; text is null where an array is empty."""
    pieces = blocks(spark, path, ",")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes, which end in the piece that they begin in
    found = parities(pieces, F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))))
    index = materialise(with_blocks(pieces, found, ["pieces", "parity", "odd"]).mapInArrow(_indexed, _INDEX), "index")
    starts = materialise(index.groupBy(FILE).applyInPandas(_starts, _STARTS), "starts")  # a row for each block of a file
    known = with_blocks(pieces, starts, ["pieces", "parity", "objects", "of_block", "of_place", "depth"])
    parts = materialise(known.mapInArrow(_members, _MEMBERS_SQL), "parts")

    array = [FILE, "of_block", "of_place"]
    before = Window.partitionBy(*array).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of an array
    counts = materialise(parts.groupBy(*array, BLOCK).agg(F.sum(F.col("ends").cast("long")).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    names = [f"__a{i}" for i in range(4)]
    firsts = counts.select(*[F.col(c).alias(n) for c, n in zip([*array, BLOCK], names, strict=True)], "before").where("before > 0")
    same = (F.col(FILE) == F.col(names[0])) & (F.col("of_block") == F.col(names[1])) & (F.col("of_place") == F.col(names[2])) & (F.col(BLOCK) == F.col(names[3]))
    placed = parts.join(F.broadcast(firsts), same, "left").withColumn("ord", F.coalesce("before", F.lit(0)) + F.col("k"))
    of = [*array, "depth", "ord"]
    cut = placed.where("NOT whole AND text IS NOT NULL").groupBy(*of).agg(F.array_sort(F.collect_list(F.struct(F.col(BLOCK), "text"))).alias("p"))
    over = cut.select(*of, F.array_join(F.transform("p", lambda x: x["text"]), ",").alias("text"))
    return placed.where("whole OR text IS NULL").select(*of, "text").unionByName(over).withColumn("text", F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def record_rows(spark: SparkSession, path: str) -> DataFrame:
    """FILE, ord, row: a JSON text for each member of each document's record array."""
    found = members(spark, path)
    record = F.coalesce(F.col("text").rlike(r"^[\{\[]"), F.lit(True))
    arrays = found.groupBy(FILE, "of_block", "of_place", "depth").agg(F.bool_and(record).alias("records"))
    fit = arrays.where(((F.col("depth") <= MAX_DEPTH) & F.col("records")) | (F.col("depth") == 0))
    chosen = materialise(fit.groupBy(FILE).agg(F.min(F.struct((~F.col("records")).alias("worse"), "of_block", "of_place")).alias("a")), "arrays")
    own = chosen.select(F.col(FILE).alias("__f"), F.col("a.of_block").alias("__b"), F.col("a.of_place").alias("__p"))
    rows = found.join(F.broadcast(own), (F.col(FILE) == F.col("__f")) & (F.col("of_block") == F.col("__b")) & (F.col("of_place") == F.col("__p")), "left_semi")  # a row for each file
    rows = rows.where("text IS NOT NULL").select(FILE, F.col("ord").cast("int").alias("ord"), F.col("text").alias("row"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias(FILE))
    none = [r[0] for r in files.join(chosen, FILE, "left_anti").collect()]  # documents without an array to take rows from
    if none:
        whole = spark.read.text(none, wholetext=True).select(F.col("_metadata.file_path").alias(FILE), "value")
        rows = rows.unionByName(row_texts(whole, "value", "json", [FILE]).select(FILE, F.col("ord").cast("int").alias("ord"), "row"))
    return rows
