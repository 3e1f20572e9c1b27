"""SimHash fingerprints and near duplicates by pivot distance tables.

A table holds the Hamming distances of each fingerprint to reference fingerprints (pivots). It is used twice. Its entries
make the cells in which fingerprints meet, and in a cell a pair is discarded if any coordinate differs by more than the
bits allowed (triangle inequality); the survivors are verified bit by bit. Cells are dealt by key and sorted there, and a
task reads them one after the other.

Two searches are built on this:

- `near_duplicates` is exact: 64 bits of three-word shingles, linked at two or fewer differing bits. A cell is a row of the
  pivot table. A flipped bit moves every coordinate by one, so each fingerprint is listed in its own cell
  and in the 64 cells of one flipped bit; two fingerprints within two bits share one of them, whatever their bits are, as
  the one between them is a flip away from both. A cell holds the 65 fingerprints around one value at most.
- `similar_documents` looks for texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, which is
  some 39 of 256 bits. A cell is the pair of the nearest pivots from two sets of PIVOTS, within a class of
  sizes; the second nearest count too. TABLES such tables find about nine in ten of the pairs at 0.8 and almost all at 0.9.
  Survivors are verified by their shingles. In a cell each document is linked to the smallest and
  to the nearest before it; cells above PAIRS documents are cut by leaders, a document within reach of a
  leader being linked to it and not compared further. Cells may lie over several sorted ranges, so that a group of copies
  of any size is spread; the leaders of cells at the ends of ranges meet once more. That round only joins what is easily joined. Where a cell
  still holds several components, all its pairs across them within WIDE_BITS are tried on their full sets of shingles (`links_across`), so none that a
  cell holds is lost. Cells are cut into blocks of BLOCK documents that meet pairwise in tasks of their own; pairs are never rows.

Distances of fingerprints to pivots alone, taken as coordinates of a grid, are no search: those of 64 random bits
lie within a few bits of each other, so that nearly all pairs would be compared.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle
are hashed whole; rows with a null identifier get the component of their fingerprint
(null if nobody in it has an identifier); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.llm.common import bounded_broadcast, materialise, meetings, type_of, without

SHINGLE, MAX_BITS = 3, 2
#: References of 64 bits, and what their coordinates count in the key of a cell.
REFERENCES, FACTORS = np.random.default_rng(64).integers(0, 2**64, (2, 24), np.uint64, endpoint=False)
#: Of the wide search: 64-bit words of a fingerprint, bits that may differ, tables, pivots in each half of a table.
WORDS, WIDE_BITS, TABLES, PIVOTS = 4, 52, 16, 256
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Width of a class of sizes in natural logarithms, twice what 0.8 allows; its ends lie elsewhere in each table.
SIZE_CLASS = 2 * np.log(1 / 0.8)
#: Documents of a cell that are compared with each other; larger cells are cut by leaders.
PAIRS = 128
#: Pairs laid out at once in a task, some 150 bytes each where all are alike.
MEETINGS = 1 << 17
#: Documents of a cell that are compared in one task of the second round.
BLOCK = 512
#: Rows of one fingerprint above which it is dealt over several tasks.
HOT = 1_000_000
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the text's shingles of so many words, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes: A-Z only, and exactly [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, max(1, len(words) - size + 1))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """hashes (words, n) -> (words): a bit is set if it is set in over half of the n."""
    ones = np.zeros((len(hashes), 64), np.int64)
    n = hashes.shape[1]
    for i in range(0, n, _CHUNK):
        part = np.ascontiguousarray(hashes[:, i : i + _CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1, 8), axis=2, bitorder="little").sum(1, dtype=np.int32)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64."""
    return int(_majority(shingle_hashes(text, SHINGLE)[None])[0])


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, int]:
    """(WORDS words, number of different shingles): SimHash of the set of shingles, hashed anew for each word."""
    h = np.unique(shingle_hashes(text, shingle))
    x = h[None] + (np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed values: a mixing function of 64 bits
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(x ^ (x >> np.uint64(31))), len(h)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "f0"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0 (the fingerprint as a signed long) of every row."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, f"doc_id {type_of(df, id_col)}, f0 long")


def wide_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, f0 to f3, size (different shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wide_fingerprint(t.as_py(), shingle) for t in b.column(1)]
            words = np.array([w for w, _ in found], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)), pa.array([n for _, n in found], pa.int32())], names=["doc_id", *(f"f{i}" for i in range(WORDS)), "size"])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {type_of(df, id_col)}, {', '.join(f'f{i} long' for i in range(WORDS))}, size int")


def covering_keys(fps: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """fps (n, 1) -> (n, 65): keys of the pivot table's rows of each fingerprint and of its 64 neighbours at one bit.

    A key is the sum of the coordinates, each times its factor, modulo 2^64; rows that only share the key are told apart
    by verification. With bit i flipped a coordinate grows by one if the bit was the pivot's, else it shrinks by one."""
    at = np.arange(64, dtype=np.uint64)
    sign = lambda x: 1 - 2 * ((x[:, None] >> at) & np.uint64(1)).astype(np.int64)
    step = (FACTORS.view(np.int64)[:, None] * sign(REFERENCES)).sum(0)  # of bit i set to 0
    own = (np.bitwise_count(fps ^ REFERENCES).astype(np.int64) * FACTORS.view(np.int64)).sum(1)
    return np.concatenate([own[:, None], own[:, None] + sign(fps[:, 0]) * step], 1)


def _halves() -> np.ndarray:
    """The pivots of all tables, side by side: (bits, TABLES x 2 x PIVOTS) of 1 and -1."""
    return np.random.default_rng(256).integers(0, 2, (64 * WORDS, TABLES * 2 * PIVOTS)).astype(np.float32) * 2 - 1


def nearest_keys(fps: np.ndarray, sizes: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """fps (n, WORDS) -> (n, 3 x TABLES): in each table the nearest pivots of both halves, and with the second nearest of one."""
    signs = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").astype(np.float32) * 2 - 1
    rows = np.arange(len(fps))[:, None]
    near = (signs @ pivots).reshape(len(fps), TABLES * 2, PIVOTS)  # bits less twice the Hamming distance
    first = near.argmax(2)
    near[rows, np.arange(TABLES * 2), first] = -np.inf
    second = near.argmax(2)
    logs, offsets = np.log(np.maximum(1, sizes))[:, None], np.arange(TABLES) / TABLES
    table = np.arange(TABLES) * 4096 + np.floor(logs / SIZE_CLASS + offsets).astype(np.int64)
    a, b, a2, b2 = first[:, ::2], first[:, 1::2], second[:, ::2], second[:, 1::2]
    return np.concatenate([(table * PIVOTS + x) * PIVOTS + y for x, y in ((a, b), (a2, b), (a, b2))], 1)


def _alike(fps: np.ndarray, bits: int) -> np.ndarray:
    """fps (cells, n, words) -> (cells, n, n): which pairs differ in so many bits at most; survivors of the pivots are verified."""
    pivots = REFERENCES[: 24 // fps.shape[2] * fps.shape[2]].reshape(-1, fps.shape[2])
    table = np.bitwise_count(fps[:, :, None] ^ pivots).sum(3, dtype=np.int16)
    alike = np.ones((len(fps), fps.shape[1], fps.shape[1]), bool)
    for k in range(len(pivots)):  # discard by the largest difference of any coordinate
        alike &= np.abs(table[:, :, None, k] - table[:, None, :, k]) <= bits
    c, i, j = np.nonzero(alike)
    alike[c, i, j] = np.bitwise_count(fps[c, i] ^ fps[c, j]).sum(1) <= bits
    return alike


def _forests(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, entry, smaller entry) of links that join all components of each cell."""
    alike, n = _alike(fps, bits), fps.shape[1]
    label = np.broadcast_to(np.arange(n), alike.shape[:2])
    while True:
        least = np.where(alike, label[:, None, :], n).min(2)
        if (least == label).all():
            break
        label = least
    c, i = np.nonzero(label != np.arange(n))
    return c, i, label[c, i]


def _neighbours(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, entry, earlier entry): of each entry the first and the nearest before it that are within bits."""
    alike, n = np.tril(_alike(fps, bits), -1), fps.shape[1]
    first = alike.argmax(2)
    c, i, j = np.nonzero(alike)
    far = np.full(alike.shape, 1 << 14, np.int16)
    far[c, i, j] = np.bitwise_count(fps[c, i] ^ fps[c, j]).sum(1)
    c, i = np.nonzero(alike.any(2))
    both = [np.stack([c, i, x[c, i]]) for x in (first, far.argmin(2))]
    return tuple(np.unique(np.concatenate(both, 1), axis=1))


def _leaders(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fps (n, words) -> (leaders, entries, their leaders): entries within bits of a leader are linked to the first such."""
    left, leaders, entries, theirs = np.arange(len(fps)), [], [], []
    while len(left):
        near = np.bitwise_count(fps[left] ^ fps[left[0]]).sum(1) <= bits
        near[0] = False
        leaders.append(left[0])
        entries.append(left[near])
        theirs.append(np.full(int(near.sum()), left[0]))
        near[0] = True
        left = left[~near]
    return np.array(leaders, np.int64), np.concatenate(entries), np.concatenate(theirs)


def _linker(words: int, bits: int, exact: bool, ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, rep, f0, ...) sorted by key -> links (a, b), and with ends the leaders (key, a, f0, ...) of the first and last cell, b null."""

    def links(rep: pa.Array, fps: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
        sizes = np.diff(cuts)
        for n in np.unique(sizes[sizes > 1]).tolist():
            starts = cuts[:-1][sizes == n]
            if exact or n <= PAIRS:
                step = max(1, MEETINGS // (n * n))
                for k in range(0, len(starts), step):
                    at = starts[k : k + step, None] + np.arange(n)
                    c, i, j = (_forests if exact else _neighbours)(fps[at], bits)
                    yield rep.take(pa.array(at[c, j])), rep.take(pa.array(at[c, i]))
            else:
                for start in starts.tolist():
                    _, i, j = _leaders(fps[start : start + n], bits)
                    yield rep.take(pa.array(start + j)), rep.take(pa.array(start + i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", *(f"f{i}" for i in range(words))]
        held: pa.Table | None = None  # the last cell, which may go on in the next batch
        first = True

        def out(a: pa.Array, b: pa.Array, key: np.ndarray | None = None, fps: np.ndarray | None = None) -> pa.RecordBatch:
            more = [pa.nulls(len(a), pa.int64())] * (words + 1) if key is None else [pa.array(key), *(pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(words))]
            return pa.RecordBatch.from_arrays([a, b, *more], names=names)

        def cells(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, first
            key = table.column(0).to_numpy()
            rep = table.column(1).combine_chunks()
            fps = np.stack([table.column(2 + i).to_numpy() for i in range(words)], 1).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            done = len(cuts) - 1 if last else len(cuts) - 2
            for a, b in links(rep, fps, cuts[: done + 1]):
                if len(a):
                    yield out(a, b)
            at_ends = {*([0] if first else []), *([done - 1] if last else [])} if ends and done else set()
            for k in sorted(at_ends):
                own = np.arange(cuts[k], cuts[k + 1])
                own = own[_leaders(fps[own], bits)[0]]
                yield out(rep.take(pa.array(own)), pa.nulls(len(own), rep.type), key[own], fps[own])
            if done:
                first = False
            held = None
            if not last:
                held = table.slice(int(cuts[-2]))
                if not exact and held.num_rows > 32 * PAIRS:  # a large cell goes on with its leaders only
                    tail = fps[cuts[-2] :]
                    keep, i, j = _leaders(tail, bits)
                    yield out(rep.take(pa.array(cuts[-2] + j)), rep.take(pa.array(cuts[-2] + i)))
                    held = held.take(pa.array(keep))

        for b in batches:
            if b.num_rows:
                part = pa.Table.from_batches([b])
                yield from cells(part if held is None else pa.concat_tables([held, part]), False)
        if held is not None and held.num_rows:
            yield from cells(held, True)

    return run


def _keyed(nodes: DataFrame, words: int, keys: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int) -> DataFrame:
    """nodes (rep, f0, ..., size) -> key, rep, f0, ...: a row for each cell of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                fps = np.stack([b.column(1 + i).to_numpy() for i in range(words)], 1).view(np.uint64)
                found = keys(fps, b.column(words + 1).to_numpy())
                at = pa.array(np.repeat(np.arange(len(fps)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *(b.column(k).take(at) for k in range(words + 1))], names=["key", "rep", *(f"f{i}" for i in range(words))])

    schema = f"key long, rep {type_of(nodes, 'rep')}, {', '.join(f'f{i} long' for i in range(words))}"
    return nodes.select("rep", *(f"f{i}" for i in range(words)), "size").mapInArrow(run, schema)


def _schema(kind: str, words: int) -> str:
    return f"a {kind}, b {kind}, key long, {', '.join(f'f{i} long' for i in range(words))}"


def near_links(nodes: DataFrame) -> DataFrame:
    """nodes (rep, f0), f0 distinct, rep not null -> links (a, b) that join all components at MAX_BITS."""
    keyed = _keyed(nodes.withColumn("size", F.lit(0)), 1, covering_keys, 4096)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(1, MAX_BITS, True, False), _schema(type_of(nodes, "rep"), 1)).select("a", "b")


def wide_cells(nodes: DataFrame) -> DataFrame:
    """nodes (rep, f0, ..., size) -> key, rep, f0, ...: a row for each cell of each, written, as both rounds read them."""
    shipped = nodes.sparkSession.sparkContext.broadcast(_halves())
    return materialise(_keyed(nodes, WORDS, lambda fps, sizes: nearest_keys(fps, sizes, shipped.value), 512), "keyed")


def similar_links(keyed: DataFrame) -> DataFrame:
    """wide_cells -> candidate links (a, b) within WIDE_BITS: of a document the first and the nearest, or a leader."""
    kind = type_of(keyed, "rep")
    ranged = keyed.repartitionByRange("key", F.xxhash64("rep")).sortWithinPartitions("key", F.xxhash64("rep"))
    found = materialise(ranged.mapInArrow(_linker(WORDS, WIDE_BITS, False, True), _schema(kind, WORDS)), "cells")
    ends = found.where("b IS NULL").select("key", F.col("a").alias("rep"), *(f"f{i}" for i in range(WORDS)))
    more = ends.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(WORDS, WIDE_BITS, False, False), _schema(kind, WORDS))
    both = found.where("b IS NOT NULL").select("a", "b").unionByName(more.select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


class _Meeting:
    """Rows (key, i, j, own, rep, comp, size, f0, ...) of one key, i and j: blocks i and j of a cell; comp: a number of the component."""

    def __init__(self, group: pa.Table, similarity: float):
        self.comp, self.size, own = (group.column(c).to_numpy() for c in ("comp", "size", "own"))
        self.fps = np.stack([group.column(f"f{i}").to_numpy() for i in range(WORDS)], 1).view(np.uint64)
        self.similarity = similarity
        i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
        self.same = i == j
        self.left, self.right = (np.arange(len(own)),) * 2 if self.same else (np.flatnonzero(own == i), np.flatnonzero(own == j))

    def allowed(self) -> Iterator[tuple[int, np.ndarray]]:
        """Of each row, the rows of other components that sizes and fingerprints allow; of a pair in one block the later one."""
        for x in self.left.tolist():
            y = self.right[self.right > x] if self.same else self.right
            y = y[self.comp[y] != self.comp[x]]
            y = y[np.minimum(self.size[y], self.size[x]) >= self.similarity * np.maximum(self.size[y], self.size[x])]
            y = y[np.bitwise_count(self.fps[y] ^ self.fps[x]).sum(1) <= WIDE_BITS]
            if len(y):
                yield x, y


def links_across(keyed: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between documents of different components by labels (node, component): all that cells (wide_cells) hold, as far as they join components.

    nodes (rep, size), texts (rep, text). A document's set is sent to a meeting of two blocks only if it has a pair to try there; a pair is tried in the first cell that it shares."""
    kind, words = type_of(keyed, "rep"), [f"f{i}" for i in range(WORDS)]
    own = labels.select(F.col("node").alias("rep"), F.xxhash64("component").alias("comp"))
    labelled = keyed.join(bounded_broadcast(materialise(own, "labels")), "rep", "left").select("key", "rep", F.coalesce("comp", F.xxhash64("rep")).alias("comp"), *words)
    several = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low < high").select("key", "blocks")
    rows = labelled.join(bounded_broadcast(materialise(several, "several")), "key").join(nodes.select("rep", F.col("size").cast("long").alias("size")), "rep")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["key", "i", "j", "own", "rep", "comp", "size", *words]
    together = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    schema = f"key long, i long, j long, own long, rep {kind}, comp long, size long, {', '.join(f'{w} long' for w in words)}"

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in meetings(batches):
            if group.num_rows > 1 and (found := [np.append(y, x) for x, y in _Meeting(group, similarity).allowed()]):
                yield from group.take(pa.array(np.unique(np.concatenate(found)))).combine_chunks().to_batches()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], names=["rep", "held"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in meetings(batches):
            meeting, rep, key = _Meeting(group, similarity), group.column("rep"), group.column("key")[0].as_py()
            held = [np.frombuffer(h, np.uint64) for h in group.column("held").to_pylist()]
            cells = [np.array(k) for k in group.column("cells").to_pylist()]
            up: dict[int, int] = {}

            def root(c: int, up: dict[int, int] = up) -> int:
                while c in up:
                    c = up[c]
                return c

            links = []
            for x, others in meeting.allowed():
                for y in others.tolist():
                    mine, its = root(int(meeting.comp[x])), root(int(meeting.comp[y]))
                    if mine == its or np.intersect1d(cells[x], cells[y], assume_unique=True)[0] != key:
                        continue
                    shared = len(np.intersect1d(held[x], held[y], assume_unique=True))
                    if shared >= similarity * (len(held[x]) + len(held[y]) - shared):
                        up[max(mine, its)] = min(mine, its)
                        links.append((x, y))
            if links:
                yield pa.RecordBatch.from_arrays([rep.take(pa.array([p[k] for p in links], pa.int64())).combine_chunks() for k in (0, 1)], names=["a", "b"])

    blocks = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns[3:])
    found = materialise(together(blocks).mapInArrow(involved, schema), "involved")
    ends = bounded_broadcast(materialise(found.select("rep").distinct(), "ends"))
    needed = texts.join(ends, "rep", "left_semi").groupBy("rep").agg(F.min("text").alias("text")).mapInArrow(sets, f"rep {kind}, held binary")
    cells = keyed.select("key", "rep").join(ends, "rep", "left_semi").groupBy("rep").agg(F.collect_list("key").alias("cells"))
    return together(found.join(materialise(needed.join(cells, "rep"), "sets"), "rep").select(*columns, "held", "cells")).mapInArrow(linked, f"a {kind}, b {kind}")


def verified_links(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts (rep, text) have so similar sets of shingles."""
    kind = type_of(texts, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.unique(shingle_hashes(t.as_py(), shingle)) for t in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= similarity * (len(p) + len(q) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).distinct()
    of = texts.join(bounded_broadcast(materialise(ends, "ends")), "rep", "left_semi")
    needed = materialise(of.groupBy("rep").agg(F.min("text").alias("text")), "texts")  # an identifier on several rows stands for one of them
    named = lambda n: needed.select(F.col("rep").alias(n), F.col("text").alias(f"text_{n}"))
    return links.join(named("b"), "b").join(named("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, component): for every node with a link, the smallest reachable node.

    Alternating star contraction: each round every node is handed to the smallest of its neighbours,
    rounds grow with the logarithm of the component's size; nothing is gathered in one place."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    size = edges.count()
    for _ in range(max_rounds):
        if not size:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, was = edges, size
        edges = materialise(small.distinct(), "edges")
        size = edges.count()
        if size == was and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _with_component(rows: DataFrame, nodes: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """rows with component_id, by the fingerprint columns `by`; nodes (by, rep, n), labels (node, component).

    A fingerprint of more than HOT rows is dealt over several tasks: its node is listed once for each share."""
    of = nodes.join(labels, F.col("rep") == F.col("node"), "left").select(*by, F.coalesce("component", "rep").alias("component_id"), F.floor(F.col("n") / HOT).alias("more"))
    hot = materialise(of.where("more > 0").select(*[F.col(c).alias(f"hot_{c}") for c in by], "more"), "hot")  # a row for each HOT rows at most
    if hot.isEmpty():
        return rows.join(of.drop("more"), by)
    same = [F.col(c) == F.col(f"hot_{c}") for c in by]
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn("share", F.pmod(F.monotonically_increasing_id(), F.coalesce("more", F.lit(0)) + 1)).select(*rows.columns, "share")
    return dealt.join(of.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), "more"))).drop("more"), [*by, "share"]).drop("share")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialise(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = materialise(fps.groupBy("f0").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    labels = connected_components(near_links(nodes.where("rep IS NOT NULL")))
    found = _with_component(fps, nodes, labels, ["f0"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of df: doc_id, component_id. Links are texts whose sets of shingles have that similarity or more, or the same wide fingerprint."""
    by = [f"f{i}" for i in range(WORDS)]
    fps = materialise(wide_fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = materialise(fps.groupBy(*by).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("size").alias("size")), "nodes")
    keyed = wide_cells(nodes.where("rep IS NOT NULL"))
    texts = df.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text"))
    links = materialise(verified_links(materialise(similar_links(keyed), "links"), texts, shingle, similarity), "verified")
    more = links_across(keyed, connected_components(links), nodes, texts, shingle, similarity)
    return _with_component(fps, nodes, connected_components(links.unionByName(more)), by).select("doc_id", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """df with one document of each component of similar documents, the one with the smallest identifier.

    An identifier on several rows counts as one document and stays if any of its rows does."""
    found = similar_documents(df, id_col, text_col, shingle, similarity).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    return without(df, materialise(found.where("NOT kept").select("doc_id"), "near"), id_col)
