"""Language-model scores of whole documents: a gated recurrent network over an open vocabulary.

Counts of all tokens come from all training documents (map-side sums, one shuffle). The VOCABULARY most frequent
tokens and BUCKETS classes of the others, by a hash of their first two bytes, are the network's tokens; a token of a
bucket has the network's probability of the bucket times its smoothed share among the bucket's
training tokens, so every text has a probability. The network (module gru) starts as the unigram model and is
trained on all training documents at every size: each belongs to one of ROUNDS rounds by a hash of its text, and in a round each
partition of about TRAINER_TOKENS tokens trains on its own documents and the weights are averaged. A token's
probability is MIX of the network's and the rest of the base's.

Scoring streams all documents once with the weights and the counts of up to FREQUENT tokens; these
are chosen by a count limit, so the table is bounded at any size of the corpus. Counts of all other
tokens are found by a join with the full table: no count is approximated.

Defined results: null text is empty and consists of the end token only; if nothing can be learned,
all tokens are unknown and the network is the even one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.llm import gru
from loomgate.llm.common import materialise, type_of
from loomgate.llm.langid import crc_mod

VOCABULARY, BUCKETS, FREQUENT = 4096, 64, 250_000
#: Tokens scored at once in a task, some 60 bytes each; a document is never split. Documents above LONG tokens wait for each
#: other, so that the network doesn't go through one long document after the other with nothing beside it.
SCORED_TOKENS, LONG = 1_500_000, 2048
#: Tokens of a partition that trains, and those laid out at once there.
ROUNDS, TRAINER_TOKENS, LAID_TOKENS = 2, 2_000_000, 500_000
#: Of a token's probability, what the network gives; the rest is the base's.
MIX = 0.95
#: The end token; no word holds a line end.
END = b"\n"
#: Distinct tokens a task counts before it hands them on.
_FLUSH = 300_000
_CHUNK = 1 << 14
#: Bytes of texts split at once.
_SPLIT = 8 << 20


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # on bytes: A-Z only, and exactly [\x20\x09-\x0D]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts in a row, binary; how many each text has): what tokens() gives for each, by Arrow's kernels."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, starts = found.flatten(), found.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full).cast(pa.binary()), np.diff(before[starts - starts[0]])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some _SPLIT bytes."""
    for b in batches:
        step = max(1, b.num_rows * _SPLIT // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def bucket_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[:2], 42) % BUCKETS


def token_counts(texts: DataFrame) -> DataFrame:
    """texts (text) -> (word binary, n) over all rows, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["word", "n"])
            counter.clear()
            return out

        for b in pieces(batches):
            words, sizes = split(b.column(0))
            found = pc.value_counts(words)
            for w, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                counter[w] += n
            counter[END] += len(sizes)
            if len(counter) >= _FLUSH:
                yield flush()
        yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Frequent tokens with their counts, the network's tokens, and what smoothing needs of the rest."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int, by_bucket: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        frequent = sorted(frequent, key=lambda x: (-x[1], x[0]))
        own = [w for w, _ in frequent if w != END][: VOCABULARY - BUCKETS - 1]
        counts = dict(frequent)
        rest = {b: list(by_bucket.get(b, (0, 0))) for b in range(BUCKETS)}
        for w in own:
            b = bucket_of(w)
            rest[b][0] -= counts[w]
            rest[b][1] -= 1
        named = [(counts.get(END, 0), END), *((counts[w], w) for w in own), *((rest[b][0], b) for b in range(BUCKETS))]
        named += [(0, None)] * (VOCABULARY - len(named))  # a small corpus leaves numbers unused
        named.sort(key=lambda x: -x[0])
        self.unigrams = np.array([c for c, _ in named], np.float64)
        number = {key: i for i, (_, key) in enumerate(named) if key is not None}
        self.end = number[END]
        self.bucket_number = np.array([number[b] for b in range(BUCKETS)], np.int32)
        # of a bucket: log10 of what its tokens' counts are divided by
        self.bucket_log = np.array([np.log10(max(0, rest[b][0]) + 0.5 * (max(0, rest[b][1]) + 1)) for b in range(BUCKETS)])
        self.frequent = pa.array([w for w, _ in frequent], pa.binary())
        self.end_place = next((i for i, (w, _) in enumerate(frequent) if w == END), -1)
        at = np.array([bucket_of(w) for w, _ in frequent], np.int64)
        alone = np.array([number.get(w, -1) for w, _ in frequent], np.int32)
        self.number = np.where(alone < 0, self.bucket_number[at], alone)
        self.count_log = np.log10(np.array([c for _, c in frequent], np.float64) + 0.5)
        self.share_log = np.where(alone < 0, self.count_log - self.bucket_log[at], 0.0)
        self.base_log = float(np.log10(total + 0.5 * (distinct + 1)))
        self.buckets: dict[bytes, int] = {}

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of all texts in a row, each with its end: (places among the frequent tokens, -1 for others; tokens of each text;
        where tokens aren't frequent, ends left out; those tokens)."""
        words, sizes = split(texts)
        found = pc.index_in(words, value_set=self.frequent)
        rare = words.filter(found.is_null()).to_pylist()
        at = found.fill_null(-1).to_numpy(zero_copy_only=False)
        texts_before = np.repeat(np.arange(len(sizes)), sizes)
        where = np.flatnonzero(at < 0)
        return np.insert(at, np.cumsum(sizes), self.end_place), sizes + 1, where + texts_before[where], rare

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """Network tokens of each text with its end."""
        at, sizes, where, rare = self.places(texts)
        out = self.number[at]
        out[where] = self.bucket_number[[self.bucket(w) for w in rare]] if rare else 0
        return np.split(out, np.cumsum(sizes)[:-1])

    def bucket(self, word: bytes) -> int:
        start = word[:2]
        if (b := self.buckets.get(start)) is None:
            b = self.buckets[start] = bucket_of(word)
        return b

    def look_up(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, Counter[bytes]]]:
        """Of each text with its end: network tokens, log10 share in the bucket, log10 base probability, known
        tokens, and the tokens that aren't frequent; log10(c + 0.5) of those is left out of both logs and to be added."""
        at, sizes, where, rare = self.places(texts)
        ends = np.cumsum(sizes)
        if len(self.number):
            numbers, share, base = self.number[at], self.share_log[at], self.count_log[at] - self.base_log
        else:
            numbers, share, base = np.full(len(at), self.end, np.int32), np.zeros(len(at)), np.zeros(len(at))
        if self.end_place < 0:  # no training document at all
            numbers[ends - 1], share[ends - 1], base[ends - 1] = self.end, 0.0, np.log10(0.5) - self.base_log
        if rare:
            b = np.array([self.bucket(w) for w in rare])
            numbers[where], share[where], base[where] = self.bucket_number[b], -self.bucket_log[b], -self.base_log
        upto, start = np.searchsorted(where, ends).tolist(), 0
        known, last = np.add.reduceat(at >= 0, ends - sizes, dtype=np.int64).tolist() if len(at) else [], 0
        for i, (end, stop) in enumerate(zip(ends.tolist(), upto, strict=True)):
            yield numbers[start:end], share[start:end], base[start:end], known[i], Counter(rare[last:stop])
            start, last = end, stop


def lexicon(counts: DataFrame) -> Lexicon:
    """From the materialised counts. To the driver come sums, and the tokens above the count that at most FREQUENT reach."""
    sums = counts.groupBy(_bucket_column().alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).first()
    by_bucket = {r["b"]: (r["n"], r["v"]) for r in sums}
    total, distinct = sum(n for n, _ in by_bucket.values()), sum(v for _, v in by_bucket.values())
    if ends is not None:
        b = bucket_of(END)
        by_bucket[b] = (by_bucket[b][0] - ends["n"], by_bucket[b][1] - 1)
    room, least = FREQUENT, 1
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        room -= r["words"]
        if room < 0:
            least = r["n"] + 1
            break
    rows = counts.where((F.col("n") >= least) | (F.col("word") == F.lit(bytearray(END)))).toArrow()
    frequent = list(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
    return Lexicon(frequent, total, distinct, by_bucket)


def _bucket_column():
    """bucket_of on the JVM: the hash is the same, read as unsigned."""
    return F.xxhash64(F.substring("word", 1, 2)).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def of_round(texts: DataFrame, k: int) -> DataFrame:
    """The texts that train in round k; each is in one round, equal ones in the same."""
    return texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k)


def train(texts: DataFrame, lex: Lexicon) -> gru.Weights:
    """texts (text). Rounds of training in the partitions and averaging between them, which pass over every text once."""
    spark = texts.sparkSession
    weights = gru.start(lex.unigrams)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if not size:
        return weights
    trainers = max(1, round(size / 6 / TRAINER_TOKENS / ROUNDS))
    groups = max(1, int(trainers**0.5))
    shipped_lex = spark.sparkContext.broadcast(lex)
    for k in range(ROUNDS):
        shipped = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            trainer, own, n, docs, held = gru.Trainer(shipped.value.like(shipped.value.flat())), shipped_lex.value, 0, [], 0
            for b in pieces(batches):
                for found in own.numbers(b.column(0)):
                    docs.append(found)
                    held += len(found)
                    if held >= LAID_TOKENS:
                        n += trainer.learn(docs, own.end)[1]
                        docs, held = [], 0
            if docs:
                n += trainer.learn(docs, own.end)[1]
            if n:
                flat, part = trainer.w.flat(), TaskContext.get().partitionId()
                parts = [flat[i : i + _CHUNK].tobytes() for i in range(0, len(flat), _CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([part % groups] * len(parts), pa.int32()), pa.array([float(n)] * len(parts)), pa.array(parts, pa.binary())], names=["chunk", "part", "n", "w"])

        def mean(table: pa.Table) -> pa.Table:
            n = table.column("n").to_numpy()
            w = sum(x * np.frombuffer(v, np.float32).astype(np.float64) for x, v in zip(n, table.column("w").to_pylist(), strict=True)) / n.sum()
            return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": pa.array([0], pa.int32()), "n": pa.array([n.sum()]), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

        schema = "chunk int, part int, n double, w binary"
        found = of_round(texts, k).repartition(trainers).mapInArrow(run, schema)
        for by in (["chunk", "part"], ["chunk"]) if groups > 1 else (["chunk"],):
            found = found.groupBy(*by).applyInArrow(mean, schema)
        parts = sorted(found.collect(), key=lambda r: r["chunk"])  # one set of weights
        if parts:
            weights = weights.like(np.concatenate([np.frombuffer(r["w"], np.float32) for r in parts]))
    return weights


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs;
    learned from rows whose crc32(doc_id) mod folds isn't 1."""
    spark = docs.sparkSession
    training = docs.where(crc_mod(id_col, folds) != 1)
    counts = materialise(token_counts(training.select(F.col(text_col).alias("text"))), "counts")
    lex = lexicon(counts)
    weights = train(training.select(F.col(text_col).alias("text")), lex)
    shipped_lex, shipped = spark.sparkContext.broadcast(lex), spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ln10 = np.log(10)
        own, net, at = shipped_lex.value, shipped.value, TaskContext.get().partitionId() << 33

        def score(rows: list) -> pa.RecordBatch:
            nonlocal at
            ids, held_out, found = zip(*rows, strict=True)
            share, base = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
            mixed = np.logaddexp(gru.score(net, [x[0] for x in found], own.end) + ln10 * share + np.log(MIX), ln10 * base + np.log1p(-MIX)) / ln10
            starts = np.cumsum([0, *(len(x[0]) for x in found[:-1])])
            keys = np.arange(at, at + len(rows))
            at += len(rows)
            ends = pa.array(np.cumsum([0, *(len(x[4]) for x in found)], dtype=np.int32))
            words = pa.StructArray.from_arrays([pa.array([w for x in found for w in x[4]], pa.binary()), pa.array([n for x in found for n in x[4].values()], pa.int32())], names=["word", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(held_out, pa.bool_()), pa.array(keys), pa.array([len(x[0]) for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64()), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(mixed, starts)), pa.ListArray.from_arrays(ends, words)],
                names=["doc_id", "held_out", "key", "n_tokens", "known", "base", "own", "rare"],
            )

        waiting: list[list] = [[], []]  # documents up to LONG, and longer ones
        held = [0, 0]
        for b in pieces(batches):
            kind = b.schema.types[0]
            for doc, out, found in zip(b.column(0), b.column(1), own.look_up(b.column(2)), strict=True):
                long = len(found[0]) > LONG
                waiting[long].append((doc.as_py(), out.as_py(), found))
                held[long] += len(found[0])
                if held[long] >= SCORED_TOKENS:
                    yield score(waiting[long])
                    waiting[long], held[long] = [], 0
        for rows in waiting:
            if rows:
                yield score(rows)

    slim = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, folds) == 1).alias("held_out"), F.col(text_col).alias("text"))
    rows = slim.mapInArrow(run, f"doc_id {type_of(docs, id_col)}, held_out boolean, key long, n_tokens long, known long, base double, own double, rare array<struct<word: binary, n: int>>")
    rows = materialise(rows, "scores")
    rare = rows.select("key", F.explode("rare").alias("r")).select("key", "r.word", F.col("r.n").alias("times"))
    more = rare.join(counts, "word", "left").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    whole = rows.drop("rare").join(more, "key", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("own") + extra).alias("score"))
