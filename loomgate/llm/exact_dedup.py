"""Exact deduplication by content sort.

Texts are normalised, dealt by sampled splitters into ranges of their bytes and sorted
there (Spark's sort spills to disk), so that equal texts are neighbours. One pass compares each
text in full with the one before it. The sort key ends in the identifier, so the first row of a
run is the one that stays, and a group of any size may be cut over several ranges: only the first
and last run of a range can go on in another one, and those are joined afterwards, by their texts.

Defined results: null text counts as empty; a null identifier sorts last; of rows that repeat
both identifier and text exactly one is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.llm.common import materialise, text_of, type_of, unused, without

#: A run of white space that isn't a single space already: what normalisation has to change.
_UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Characters of the text that splitters are sampled from; the hash after it parts longer common starts.
SPLITTER_CHARS = 24


def normalised(text: str | Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] becomes one space; null becomes the empty text."""
    return F.regexp_replace(text_of(text), _UNEVEN_SPACE, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, norm) in sorted order -> (id, keep, size, sha, first, part, edge, text).

    edge: 1 for the first run of the range, 2 for the last, else 0; text: of such a run, on its first row."""
    part = TaskContext.get().partitionId()
    open_ids: list[pa.Array] = []  # of the run that may go on in the next batch: identifiers only
    open_text: pa.Scalar | None = None
    at_edge = True  # the first run of the range

    def sha(text: pa.Scalar) -> str:
        return hashlib.sha256(text.as_buffer() or b"").hexdigest()

    def rows(ids: pa.Array, sizes: np.ndarray, texts: list[pa.Scalar], edge: list[int]) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        run = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(len(run), bool)
        first[starts] = True
        ends = np.full(len(run), None, object)
        for start, text, at in zip(starts.tolist(), texts, edge, strict=True):
            if at:
                ends[start] = text.as_py()
        return pa.RecordBatch.from_arrays(
            [ids, ids.take(pa.array(starts)).take(pa.array(run)), pa.array(sizes[run].astype(np.int64)), pa.array([sha(t) for t in texts]).take(pa.array(run)), pa.array(first), pa.array(np.full(len(run), part, np.int32)), pa.array(np.array(edge, np.int8)[run]), pa.array(ends, pa.string())],
            names=["id", "keep", "size", "sha", "first", "part", "edge", "text"],
        )

    def close(edge: int) -> pa.RecordBatch:
        ids = pa.concat_arrays(open_ids)
        return rows(ids, np.array([len(ids)]), [open_text], [edge])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, norm = batch.column(0), batch.column(1)
        same = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(~same.astype(bool)) + 1])
        if open_text is not None and norm[0].equals(open_text):
            end = int(starts[1]) if len(starts) > 1 else batch.num_rows
            open_ids.append(ids[:end])
            starts = starts[1:]
        if not len(starts):
            continue
        if open_text is not None:
            yield close(int(at_edge))
            at_edge = False
        last = int(starts[-1])
        if len(starts) > 1:
            sizes = np.diff(starts)
            yield rows(ids[int(starts[0]) : last], sizes, [norm[int(i)] for i in starts[:-1]], [int(at_edge), *[0] * (len(sizes) - 1)])
            at_edge = False
        open_ids, open_text = [ids[last:]], norm[last]
    if open_text is not None:
        yield close(1 if at_edge else 2)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    The runs at the ends of ranges, at most two for each range, are the only ones joined across
    ranges: their texts are compared in full, and what comes out, a few numbers for each such run, is broadcast, as its
    size is bound by the number of ranges."""
    keyed = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumns({"start": F.substring("norm", 1, SPLITTER_CHARS), "h": F.xxhash64("norm")})
    ranged = keyed.repartitionByRange("start", "h", F.col("id").asc_nulls_last())
    ordered = ranged.sortWithinPartitions("start", "h", "norm", F.col("id").asc_nulls_last()).select("id", "norm")
    kind = type_of(df, id_col)
    runs = materialise(ordered.mapInArrow(_runs, f"id {kind}, keep {kind}, size long, sha string, first boolean, part int, edge tinyint, text string"), "runs")

    ends = runs.where("edge > 0 AND first").select("part", "edge", "keep", "size", "text")
    whole = ends.groupBy("text").agg(F.min("keep").alias("all_keep"), F.sum("size").alias("all_size"), F.min("part").alias("all_part"), F.count("*").alias("parts")).where("parts > 1")
    joined = ends.join(whole, "text").select("part", "edge", "all_keep", "all_size", "all_part")
    fixed = runs.drop("text").join(F.broadcast(joined), ["part", "edge"], "left")
    return fixed.select(
        F.col("id").alias("doc_id"),
        F.coalesce("all_keep", "keep").alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce(F.col("part") == F.col("all_part"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all its columns.

    The dropped identifiers are taken out by an anti-join (broadcast below a checked size). An
    identifier that stands on several rows is settled by identifier and text; rows with a null
    identifier can't be named and stay."""
    found = materialise(exact_duplicates(df, id_col, text_col), "exact")
    repeated = materialise(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    out = without(df, found.where("NOT kept").select("doc_id"), id_col)
    if repeated.isEmpty():
        return out
    once = without(out, repeated, id_col)
    own, of, sha = unused(df, "__own"), unused(df, "__id"), unused(df, "__sha")
    named = found.where("kept").join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha))
    again = df.withColumn(own, F.sha2(normalised(text_col), 256)).join(named, (F.col(id_col) == F.col(of)) & (F.col(own) == F.col(sha)), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col, own]).drop(own))
