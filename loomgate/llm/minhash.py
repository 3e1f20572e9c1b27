"""MinHash near duplicates: documents whose sets of four-word shingles have a Jaccard similarity of 0.8 or more.

HASHES universal hashes of a document's shingles have each a minimum; two documents share a minimum as often as
their sets are similar. Bands of ROWS minima are keys of buckets: a pair at 0.8 misses all of them with a probability of
5e-8, so the search loses no pair in practice. Documents with equal sets are one node from then on.

Links are confirmed on full sets, in two rounds, so that a group of copies never meets itself in full:

1. Each node is tried with one leader: of the first nodes of its buckets the one that most of them share.
2. Where a bucket still holds several components, signatures are compared across components (never within one). What they allow is tried in
   the bucket, where components grow together as links are found and pairs within one aren't tried any more. Nothing else is left out. A
   pair is tried in the first of the buckets that it shares.

A signature allows a pair if so many minima agree as a pair at 0.8 has all but surely (six standard deviations less than the mean). Components
come from alternating large-star and small-star. A bucket is cut into blocks of BLOCK nodes that meet pairwise in tasks of their own, a node's set is sent to
such a meeting once, and only if its signature allows a pair there; the partners of a leader are dealt over tasks too. So no bucket and no leader has to fit one task,
and pairs are never rows.

Shingles are 64-bit hashes, sets are told apart by 128 bits of a cryptographic hash.

Defined results: null and empty texts have an empty set, are linked with nothing and kept; a text of fewer words than a shingle is one
shingle; rows with a null identifier take the component of their set (null if nobody in it has an identifier, and then kept); rows
that repeat an identifier are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.llm.common import bounded_broadcast, materialise, meetings, type_of, without
from loomgate.llm.simhash import connected_components

SHINGLE = 4
#: A pair is linked if PARTS times its shared shingles are LEAST times those of both or more.
LEAST, PARTS = 80, 100
HASHES, ROWS = 128, 4
#: Equal minima that a signature must have to be tried.
LEAST_EQUAL = math.floor(HASHES * LEAST / PARTS - 6 * math.sqrt(HASHES * LEAST / PARTS * (1 - LEAST / PARTS)))
#: Factors (odd) and offsets of the universal hashes, modulo 2^64, of which the upper half counts.
FACTORS, OFFSETS = np.random.default_rng(128).integers(0, 2**64, (2, HASHES), np.uint64, endpoint=False) | np.array([[1], [0]], np.uint64)
#: Nodes of a bucket that are compared in one task; partners that meet their leader in one.
BLOCK, PARTNERS = 512, 256
_CHUNK, _MEMORY = 512, 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed values: a mixing function of 64 bits
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """XXH64 of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hash_of = _Words().__getitem__


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and exactly that white space
    width = min(len(words), size)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    n = len(words) - width + 1
    x = _mixed(h[:n] + np.uint64(width))
    for i in range(1, width):
        x = _mixed(x + h[i : n + i])
    return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash, 32 bits."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        hashed = FACTORS[:, None] * shingles[None, i : i + _CHUNK]
        hashed += OFFSETS[:, None]
        np.minimum(least, hashed.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def alike(shared: int, p: int, q: int) -> bool:
    return PARTS * shared >= LEAST * (p + q - shared)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(identifier, text) -> (node, doc_id, d0, d1, size, sig); node: a number of the row's own."""
    node = TaskContext.get().partitionId() << 33
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(1)]
        digests = [_digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(node, node + len(sets)), pa.int64()), b.column(0), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
            names=["node", "doc_id", "d0", "d1", "size", "sig"],
        )
        node += len(sets)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, doc_id, d0, d1 (of the set of shingles), size (of it), sig of every row. Write it before nodes are used twice."""
    return _slim(df, id_col, text_col).mapInArrow(_sign, f"node long, doc_id {type_of(df, id_col)}, d0 long, d1 long, size long, sig binary")


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """sigs (n, HASHES) -> (n, HASHES / ROWS) keys of buckets."""
    bands = sigs.reshape(len(sigs), -1, ROWS).astype(np.uint64)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None]
    for i in range(ROWS):
        key = _mixed(key + bands[:, :, i])
    return key.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, sig) -> (key, node, size), a row for each band."""
    for b in batches:
        keys = band_keys(_matrix(b.column(2)))
        at = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(at), b.column(1).take(at)], names=["key", "node", "size"])


def in_buckets(nodes: DataFrame) -> DataFrame:
    """nodes (node, size, sig) -> key, node, size, leader (the bucket's smallest node) of all buckets with several nodes."""
    banded = nodes.select("node", "size", "sig").mapInArrow(_band, "key long, node long, size long")
    keys = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    return banded.join(bounded_broadcast(materialise(keys, "keys")), "key")


def _tester(test: Callable[[bytes, bytes], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, share, b, held) sorted so, with b null for what a itself holds -> the (a, b) that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: bytes | None = None
        for batch in batches:
            kept = []
            for a, b, held in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:
                    own = held.as_py()
                elif test(own, held.as_py()):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def met(pairs: DataFrame, held: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) whose held (node, held) pass the test. A node's holding is sent once to each PARTNERS of its partners, not to each."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("shares")).where("shares > 1")
    dealt = pairs.join(bounded_broadcast(materialise(shares, "shares")), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).alias("share"))
    named = lambda n: held.select(F.col("node").alias(n), "held")
    partners = dealt.join(named("b"), "b").select("a", "share", "b", "held")
    own = dealt.select("a", "share").distinct().join(named("a"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "held")
    ordered = own.unionByName(partners).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(_tester(test), "a long, b long")


def _signed_alike(p: bytes, q: bytes) -> bool:
    return int((np.frombuffer(p, np.uint32) == np.frombuffer(q, np.uint32)).sum()) >= LEAST_EQUAL


def _sets_alike(p: bytes, q: bytes) -> bool:
    p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    if not alike(min(len(p), len(q)), len(p), len(q)):
        return False
    return alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(identifier, text) -> (d0, d1, held): the set of shingles."""
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(1)]
        digests = [_digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays([*(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["d0", "d1", "held"])


def sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, held (its set) of the nodes in wanted (a column node, repeats allowed); nodes (node, id, d0, d1), texts (doc_id, text). Written.

    Texts are found by identifier, sets by their digest, so that identifiers on several rows don't matter."""
    ends = materialise(wanted.select("node").distinct(), "ends")
    needed = materialise(nodes.select("node", "id", "d0", "d1").join(bounded_broadcast(ends), "node", "left_semi"), "needed")
    ids = materialise(needed.select(F.col("id").alias("__needed")).distinct(), "ids")
    rows = texts.join(bounded_broadcast(ids), F.col("doc_id").eqNullSafe(F.col("__needed")), "left_semi")
    sets = rows.mapInArrow(_set_rows, "d0 long, d1 long, held binary").join(bounded_broadcast(needed), ["d0", "d1"])
    return materialise(sets.groupBy("node").agg(F.any_value("held").alias("held")), "sets")


class _Meeting:
    """The rows (key, i, j, own, node, comp, size, sig) of one key, i and j: blocks i and j of a bucket."""

    def __init__(self, group: pa.Table):
        self.node, self.comp, self.size, own = (group.column(c).to_numpy() for c in ("node", "comp", "size", "own"))
        self.sig = _matrix(group.column("sig").combine_chunks())
        i, j, key = (group.column(c)[0].as_py() for c in ("i", "j", "key"))
        self.band = int(np.flatnonzero(band_keys(self.sig[:1])[0] == key)[0])
        self.same = i == j
        self.left, self.right = (np.arange(len(own)),) * 2 if self.same else (np.flatnonzero(own == i), np.flatnonzero(own == j))

    def allowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pairs of different components that sizes and signatures allow, and that share no earlier bucket; the first sorted."""
        found = [np.zeros((2, 0), np.int64)]
        for k in range(0, len(self.left), 32):
            x = self.left[k : k + 32]
            least, most = np.minimum(self.size[x][:, None], self.size[self.right]), np.maximum(self.size[x][:, None], self.size[self.right])
            ok = (self.comp[x][:, None] != self.comp[self.right]) & (PARTS * least >= LEAST * most)
            if self.same:
                ok &= x[:, None] < self.right
            r, c = np.nonzero(ok)
            for at in range(0, len(r), 1 << 15):
                y, z = x[r[at : at + (1 << 15)]], self.right[c[at : at + (1 << 15)]]
                equal = self.sig[y] == self.sig[z]
                first = equal.reshape(len(equal), -1, ROWS).all(2).argmax(1)
                keep = (equal.sum(1) >= LEAST_EQUAL) & (first == self.band)
                found.append(np.stack([y[keep], z[keep]]))
        return tuple(np.concatenate(found, 1))


_MEETING = "key long, i long, j long, own long, node long, comp long, size long, sig binary"


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _MEETING that have a pair to try there."""
    for group in meetings(batches):
        at = np.unique(np.concatenate(_Meeting(group).allowed()))
        if len(at):
            yield from group.take(pa.array(at)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _MEETING with held -> links (a, b) between components whose full sets are alike, as many as join what can be joined there."""
    for group in meetings(batches):
        meeting = _Meeting(group)
        sets = [np.frombuffer(h, np.uint64) for h in group.column("held").to_pylist()]
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        left, right = meeting.allowed()
        links = []
        for x in np.unique(left).tolist():
            own = root(int(meeting.comp[x]))
            rest = [y for y in right[np.searchsorted(left, x) : np.searchsorted(left, x, "right")].tolist() if root(int(meeting.comp[y])) != own]
            if not rest:
                continue
            sizes = [len(sets[y]) for y in rest]
            hits = np.isin(np.concatenate([sets[y] for y in rest]), sets[x], assume_unique=False)
            shared = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64).tolist()
            for y, size, n in zip(rest, sizes, shared, strict=True):
                mine, its = root(int(meeting.comp[x])), root(int(meeting.comp[y]))
                if mine != its and alike(n, len(sets[x]), size):
                    up[max(mine, its)] = min(mine, its)
                    links.append((int(meeting.node[x]), int(meeting.node[y])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links_across(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of buckets (key, node, size) between nodes of different components by labels (node, component)."""
    labelled = buckets.join(bounded_broadcast(labels), "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("comp"))
    several = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low < high").select("key", "blocks")
    rows = labelled.join(bounded_broadcast(materialise(several, "several")), "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    signed = rows.join(nodes.select("node", "sig"), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = signed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "size", "sig")
    together = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    involved = materialise(together(blocks).mapInArrow(_involved, _MEETING), "involved")
    held = sets_of(involved, nodes, texts)
    return together(involved.join(held, "node").select("key", "i", "j", "own", "node", "comp", "size", "sig", "held")).mapInArrow(_linked, "a long, b long")


def near_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join all components: nodes (node, id, d0, d1, size, sig) with different sets; texts (doc_id, text)."""
    buckets = materialise(in_buckets(nodes), "buckets")
    shared = buckets.where("node <> leader").groupBy("node", "leader").count()
    led = materialise(shared.groupBy("node").agg(F.max(F.struct("count", (-F.col("leader")).alias("down"))).alias("best")).select((-F.col("best.down")).alias("a"), F.col("node").alias("b")), "led")
    tried = materialise(met(led, nodes.select("node", F.col("sig").alias("held")), _signed_alike), "tried")
    ends = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node")))
    links = materialise(met(tried, sets_of(ends, nodes, texts), _sets_alike), "links")
    return materialise(links.unionByName(links_across(buckets, connected_components(links), nodes, texts)), "all_links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the smallest identifier reachable), kept."""
    signed = materialise(signatures(df, id_col, text_col), "signed")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("least")
    classes = materialise(signed.where("size > 0").groupBy("d0", "d1").agg(F.min("node").alias("node"), smallest, F.count("*").alias("n")).select("d0", "d1", "node", "least", "n"), "classes")
    repeated = materialise(classes.where("n > 1").select("d0", "d1", F.col("node").alias("first")), "repeated")
    spare = signed.select("d0", "d1", "node").join(bounded_broadcast(repeated), ["d0", "d1"]).where("node <> first").select("node")
    of = classes.select("node", F.col("least.id").alias("id"))
    nodes = without(signed.where("size > 0").select("node", "d0", "d1", "size", "sig"), materialise(spare, "spare"), "node")
    nodes = materialise(nodes.join(of, "node"), "nodes")
    links = near_links(nodes, _slim(df, id_col, text_col))

    below = connected_components(links)  # of all nodes but the smallest of each component
    labels = materialise(below.unionByName(below.select(F.col("component").alias("node"), "component").distinct()), "labels")
    linked = labels.join(classes.select("node", "least"), "node")
    whole = linked.groupBy("component").agg(F.min("least").alias("least"))
    named = linked.select("node", "component").join(whole, "component").select("node", F.col("least.id").alias("reached"))
    known = classes.join(named, "node", "left").where("n > 1 OR reached IS NOT NULL").select("d0", "d1", F.coalesce("reached", "least.id").alias("reached"), F.lit(True).alias("known"))
    # a class of any size stands on the left of this join, whose large partitions Spark splits
    rows = signed.select("doc_id", "d0", "d1", "size").join(bounded_broadcast(materialise(known, "known")), ["d0", "d1"], "left")
    component = F.when(F.col("known"), F.col("reached")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each component, the one with the smallest identifier. An identifier on several rows stays if any of them does."""
    found = near_duplicates(df, id_col, text_col).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return without(df, materialise(found.where("NOT kept").select("doc_id"), "near"), id_col)
