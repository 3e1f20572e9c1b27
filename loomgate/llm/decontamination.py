"""Benchmark decontamination by spaced seeds.

Texts become lower-case word tokens. A seed is a mask over neighbouring tokens of which some positions
count and the others are ignored, so that a substituted word there does not hide a hit. Hashes of the benchmark's seeds are joined
with those of all positions of all documents; each pair gives an alignment of item and document, which is verified token by token:
the longest stretch of which four fifths are the same must have at least MIN_TOKENS tokens, or be the whole item where that is
shorter (under LEAST_ITEM tokens an item is no passage).

With SEEDS no stretch of 13 tokens or more with a fifth substituted is missed, with SHORT_SEEDS none of the shorter items (tests
enumerate them). Insertions and deletions shift the alignment and split a stretch.

The documents are read once for their hashes, however large the benchmark is: a filter of the benchmark's hashes, at most FILTER_BITS
in size, is broadcast, and only hashes that pass it are joined. The texts of the documents that have an alignment are read once more and
meet their alignments in sorted order, a document after the other. Benchmark sides of joins are broadcast below a counted size; beyond it
they shuffle, and Spark splits the seeds that very many documents share.

Defined results: null texts are empty and match nothing; items with null id are
kept under a null id; an item that stands in a document several times is reported once, at its longest stretch
(the one with more equal tokens, then the leftmost); rows that repeat id and text are reported each; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.llm.common import bounded_broadcast, materialise, text_of, type_of, without

#: Offsets that count, for stretches of MIN_TOKENS and more, and for shorter items.
SEEDS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7))
SHORT_SEEDS = ((0, 1, 3), (0, 2, 3))
MIN_TOKENS, SIMILARITY, LEAST_ITEM = 13, 0.8, 5
#: Bits of the filter: some FILTER_SHARE for each seed, within these powers of two.
FILTER_SHARE, FILTER_BITS = 1024, (16, 28)
#: Tokens that are hashed at once in a task.
_CHUNK = 400_000
_tokens = re.compile(r"\w+").findall
#: Odd, so that no token is lost in the product.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _tokens((text or "").lower())


def token_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def seed_hashes(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Of every position where the mask fits; a mask's hashes are its own."""
    n = max(0, len(ids) - mask[-1])
    h = np.full(n, sum(1 << o for o in mask), np.uint64)
    for offset in mask:
        h = (h ^ (h >> np.uint64(29))) * _BASE + ids[offset : offset + n]
    return h


def _seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item key, text) -> (h, key, place, short) of all seeds of each item."""
    for b in batches:
        for key, text in zip(b.column(0), b.column(1), strict=True):
            ids = token_hashes(tokens(text.as_py()))
            short = len(ids) < MIN_TOKENS
            if len(ids) < LEAST_ITEM:
                continue
            found = [seed_hashes(ids, m) for m in (SHORT_SEEDS if short else SEEDS)]
            h = np.concatenate(found).view(np.int64)
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), key.as_py())), pa.array(place), pa.array(np.full(len(h), short))], names=["h", "key", "place", "short"])


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the seeds' hashes, in words of 64 bits; its size is bounded, and so is what comes to the driver."""
    n = seeds.count()
    bits = int(np.clip(np.ceil(np.log2(max(1, n) * FILTER_SHARE)), *FILTER_BITS))
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = seeds.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("m")).toArrow()
    found = np.zeros(1 << bits - 6, np.int64)
    found[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return found.view(np.uint64)


def passes(filter_words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in h of hashes that may be seeds."""
    at = h & np.uint64(len(filter_words) * 64 - 1)
    return np.flatnonzero(filter_words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))


def _hits(shipped, masks: tuple[tuple[int, ...], ...]):
    """(document key, text) -> (doc, h, at): seeds of the document that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value

        def search(keys: list[int], docs: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(d) for d in docs], np.int64)
            ids, starts = np.concatenate([np.zeros(0, np.uint64), *docs]), np.cumsum(sizes) - sizes
            which = np.repeat(np.arange(len(docs)), sizes)
            left = np.repeat(starts + sizes, sizes) - np.arange(len(ids))  # tokens of the document from here on
            out = []
            for mask in masks:
                h = seed_hashes(ids, mask)
                at = passes(words, h)
                at = at[left[at] > mask[-1]]  # no seed spans two documents
                out.append((h[at], at))
            at = np.concatenate([x for _, x in out])
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[which[at]]), pa.array(np.concatenate([x for x, _ in out]).view(np.int64)), pa.array((at - starts[which[at]]).astype(np.int32))], names=["doc", "h", "at"])

        for b in batches:
            keys, docs, n = [], [], 0
            for key, text in zip(b.column(0), b.column(1), strict=True):
                keys.append(key.as_py())
                docs.append(token_hashes(tokens(text.as_py())))
                n += len(docs[-1])
                if n >= _CHUNK:
                    yield search(keys, docs)
                    keys, docs, n = [], [], 0
            if keys:
                yield search(keys, docs)

    return run


def overlap(doc: np.ndarray, item: np.ndarray, start: int) -> tuple[int, int, int, int] | None:
    """The longest stretch, four fifths the same, of item laid at start over doc (token hashes): (document token, item token, tokens, same)."""
    a, b, least = max(0, start), min(len(doc), start + len(item)), min(MIN_TOKENS, len(item))
    if b - a < least:
        return None
    same = item[a - start : b - start] == doc[a:b]
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])  # a stretch that gains 0 or more is four fifths the same
    low = np.minimum.accumulate(gain)
    begins = np.searchsorted(-low, -gain, "left")  # of each end, the first start from which it doesn't lose
    n = np.arange(len(gain)) - begins
    end = int(n.argmax())
    begin = int(begins[end])
    return (a + begin, a - start + begin, end - begin, int(same[begin:end].sum())) if end - begin >= least else None


def _verified(kind: str, item_kind: str):
    """Rows sorted by (doc, part, key, start): documents (part 0) before their alignments (part 1, with the item's text)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(f"a {kind}, b {item_kind}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, ids, words = None, [], np.zeros(0, np.uint64)  # the document at hand: its key, its rows' identifiers, its tokens
        key, item, own, best = None, None, np.zeros(0, np.uint64), None  # the item at hand

        def close(rows: list) -> None:
            if best is not None:
                rows += [(i, item, *best[1], len(own)) for i in ids]

        for b in batches:
            rows: list[tuple] = []
            texts = b.column(6)
            for n, (d, part, k, start, doc_id, item_id) in enumerate(zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)):
                if d != doc:
                    close(rows)
                    doc, ids, key, best = d, [], None, None
                if part == 0:
                    if not ids:
                        words = token_hashes(tokens(texts[n].as_py()))
                    ids.append(doc_id)
                    continue
                if k != key:
                    close(rows)
                    key, item, own, best = k, item_id, token_hashes(tokens(texts[n].as_py())), None
                if cut := overlap(words, own, start):
                    rank = (cut[2], cut[3], -cut[0])
                    if best is None or rank > best[0]:
                        best = (rank, cut)
            yield _leaks(rows, types)
        rows = []
        close(rows)
        yield _leaks(rows, types)

    return run


def _leaks(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types, *[pa.int32()] * 5], strict=True)], names=["doc_id", "item_id", "doc_token", "item_token", "n_tokens", "n_same", "item_tokens"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that overlap: doc_id, item_id, doc_token, item_token,
    n_tokens, n_same, item_tokens, similarity."""
    kind, item_kind = type_of(docs, id_col), type_of(benchmark, item_col)
    slim = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), text_of(item_text_col).alias("text")).distinct()
    items = materialise(items.select(F.xxhash64("item_id", "text").alias("key"), "item_id", "text"), "items")
    seeds = materialise(items.select("key", "text").mapInArrow(_seeds_of, "h long, key long, place int, short boolean"), "seeds")
    masks = SEEDS + (() if seeds.where("short").isEmpty() else SHORT_SEEDS)
    shipped = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds))
    hits = slim.select("doc", "text").mapInArrow(_hits(shipped, masks), "doc long, h long, at int")
    laid = hits.join(bounded_broadcast(seeds.drop("short")), "h").select("doc", "key", (F.col("at") - F.col("place")).alias("start")).distinct()
    laid = materialise(laid, "alignments")
    wanted = slim.join(bounded_broadcast(materialise(laid.select("doc").distinct(), "aligned")), "doc", "left_semi")
    texts = wanted.select("doc", F.lit(0).alias("part"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("start"), "doc_id", F.lit(None).cast(item_kind).alias("item_id"), "text")
    pairs = laid.join(items, "key").select("doc", F.lit(1).alias("part"), "key", "start", F.lit(None).cast(kind).alias("doc_id"), "item_id", "text")
    both = texts.unionByName(pairs).repartition("doc").sortWithinPartitions("doc", "part", "key", "start")
    schema = f"doc_id {kind}, item_id {item_kind}, doc_token int, item_token int, n_tokens int, n_same int, item_tokens int"
    return both.mapInArrow(_verified(kind, item_kind), schema).withColumn("similarity", F.col("n_same") / F.col("n_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that overlap with an item; all columns stay."""
    gone = materialise(contaminated(docs, benchmark, id_col, text_col).select("doc_id").distinct(), "leaks")
    return without(docs, gone, id_col)
