"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's subwords are its character 2- to 4-grams, with marks at both ends, and itself, hashed
into buckets. A text is the mean of the embeddings of all subwords of all its words. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows
(PER_LANGUAGE texts of at most MAX_BYTES for each language, and about SAMPLE in all). A fifth of the sample is kept out of the training; there a
temperature is fitted, so that scores are probabilities, and the rejection threshold is set: the
score that all but REJECT of the kept-out texts reach, at most MAX_THRESHOLD.

Prediction reads whole texts. As the model is linear after the mean, a word needs its summed
logits only, and a worker remembers those of a bounded number of words.

Labels beyond the MAX_LANGUAGES most frequent, and languages all of whose texts are longer than MAX_BYTES, aren't learned.

Defined results: null text and text without a letter give `und`, score 0, rejected; if nothing can be
learned (no labelled row), every text does; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.llm.common import type_of, unused

PER_LANGUAGE, SAMPLE, MAX_BYTES, MAX_LANGUAGES = 600, 6000, 20_000, 200
BUCKETS, DIM, EPOCHS, RATE, STEP = 1 << 16, 16, 3, 10.0, 0.3
REJECT, MAX_THRESHOLD = 0.002, 0.5
UNKNOWN = "und"
#: Words a worker remembers; some 50 MB.
MEMORY = 250_000
#: Numbers that the word class of `re` takes for letters, such as fractions and Roman numerals.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_GAPS = str.maketrans(dict.fromkeys(_NUMBERS, " "))
_runs = re.compile(r"[^\W\d_]+").findall


def _words(text: str) -> list[str]:
    """Runs of letters. Texts with other numbers than digits are rare, so these aren't in the pattern, which they would slow down."""
    return _runs(text if _NUMBERS.isdisjoint(text) else text.translate(_GAPS))


#: Words whose subwords are hashed at once.
_AT_ONCE = 20_000
#: Odd factors of the hash of a run of characters.
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the buckets of each word's subwords, word after word, and where each word's begin.

    All words are laid in a row with marks at their ends; runs of 2 to 4 characters are hashed side by side."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters of the word from here on
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    hashes, owners, h = [whole * _STEP], [np.arange(len(words))], codes
    for n in (2, 3, 4):
        h = h[:-1] * _STEP + codes[n - 1 :]
        inside = left[: len(h)] >= n
        hashes.append(h[inside] ^ np.uint64(n))
        owners.append(owner[: len(h)][inside])
    all_owners = np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    buckets = (np.concatenate(hashes)[order] * _MIX >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
    counts = np.bincount(all_owners, minlength=len(words))
    return buckets, np.cumsum(counts) - counts


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


class Predictor:
    """Scores texts; remembers the summed logits and the number of subwords of words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages)), np.float32)
        self.sizes = np.zeros(1024, np.int32)

    def _learn(self, words: set[str]) -> None:
        if len(self.index) + len(words) > max(MEMORY, 2 * len(words)):
            raise OverflowError
        need = len(self.index) + len(words)
        if need > len(self.sizes):
            room = max(need, 2 * len(self.sizes)) - len(self.sizes)
            self.sums = np.concatenate([self.sums, np.zeros((room, self.sums.shape[1]), np.float32)])
            self.sizes = np.concatenate([self.sizes, np.zeros(room, np.int32)])
        new = list(words)
        for k in range(0, len(new), _AT_ONCE):
            part, at = new[k : k + _AT_ONCE], len(self.index)
            buckets, starts = subwords(part)
            self.index.update(zip(part, range(at, at + len(part)), strict=True))
            self.sums[at : at + len(part)] = np.add.reduceat(self.model.logits[buckets], starts)
            self.sizes[at : at + len(part)] = np.diff(np.append(starts, len(buckets)))

    def score(self, text: str | None) -> tuple[str, float]:
        words = _words((text or "").lower())
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        if new := set(words).difference(self.index):
            try:
                self._learn(new)
            except OverflowError:
                self.forget()
                self._learn(set(words))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        raw = self.sums[at].sum(0, dtype=np.float64) / self.sizes[at].sum() + self.model.bias
        p = softmax(raw / self.model.temperature)
        best = int(p.argmax())
        return self.model.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _examples(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, shares, label): each whole text, and some runs of a few of its words, so that short texts are met too."""
    out = []
    for text, label in zip(texts, labels, strict=True):
        words = _words(text.lower())
        if not words:
            continue
        different = list(dict.fromkeys(words))
        grams, starts = subwords(different)
        of = dict(zip(different, np.split(grams, starts[1:]), strict=True))
        for run in [words, *(words[i : i + int(rng.integers(1, 12))] for i in rng.integers(0, len(words), 3))]:
            own = np.concatenate([of[w] for w in run])
            buckets, n = np.unique(own, return_counts=True)
            out.append((buckets, (n / len(own)).astype(np.float32), int(label)))
    return out


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Train on texts and their languages."""
    languages = sorted(set(langs))
    labels = np.array([languages.index(x) for x in langs], np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept_out = order[: len(texts) // 5] if len(texts) >= 50 else order
    train = order[len(texts) // 5 :] if len(texts) >= 50 else order
    data = _examples([texts[i] for i in train], labels[train], rng)
    # each language pulls alike, however many texts it has
    weight = len(data) / np.maximum(1, np.bincount([x[2] for x in data], minlength=len(languages))) / max(1, len(languages))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            buckets, share, label = data[i]
            ease = (1 - done / steps) * min(4.0, float(weight[label]))
            done += 1
            hidden = share @ emb[buckets]
            grad = softmax(hidden @ out + bias)
            grad[label] -= 1
            pull = out @ grad
            # no step moves the text's own logits by more than STEP of its error, however short the text is
            rate = ease * min(RATE, STEP / float(share @ share) / max(1.0, float((out * out).sum())))
            out -= ease * min(0.5, STEP / max(1.0, float(hidden @ hidden))) * np.outer(hidden, grad)
            bias -= ease * 0.01 * grad
            emb[buckets] -= rate * np.outer(share, pull)
    model = Model(languages, emb @ out, bias.astype(np.float64), 1.0, 0.0)
    calib = [(share @ model.logits[b] + model.bias, label) for b, share, label in _examples([texts[i] for i in kept_out], labels[kept_out], rng)]
    if calib:
        raw, want = np.array([x for x, _ in calib], np.float64), np.array([y for _, y in calib])
        doubt = 1 / (len(want) + 2)  # rule of succession: so many faultless examples prove no more certainty

        def loss(t: float) -> float:
            logs = np.log(np.maximum(1e-12, softmax(raw / t)))
            return float(-(1 - doubt) * logs[np.arange(len(want)), want].mean() - doubt * logs.mean())

        model.temperature = float(min(np.geomspace(0.5, 50, 61), key=loss))
        judge = Predictor(model)
        whole = [judge.score(texts[i])[1] for i in kept_out]
        model.threshold = min(MAX_THRESHOLD, float(np.quantile([x for x in whole if x > 0] or [0.0], REJECT)))
    return model


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the identifier as text, mod n; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit a model on a sample of the labelled rows of docs where usable holds.

    Row counts come from the two small columns; a hash then selects about PER_LANGUAGE rows of each
    language, and only those texts are read. At most MAX_LANGUAGES of the most frequent labels are learned."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1.0, 1.2 * each / r["count"]) * 1e6))]), F.col(lang_col)), F.lit(0))
    small = F.octet_length(text_col) <= MAX_BYTES
    hashed = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_000))
    picked = labelled.where(F.col(lang_col).isin([r["lang"] for r in counts]) & small & (hashed < share)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), hashed.alias("h"))
    rows = sorted(picked.limit(2 * each * len(counts)).collect(), key=lambda r: (r["h"], r["text"]))
    kept: list = []
    taken: dict[str, int] = {}
    for r in rows:
        if taken.get(r["lang"], 0) < each and _words(r["text"]):
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            kept.append(r)
    if not kept:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    return fit([r["text"] for r in kept], [r["lang"] for r in kept])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected added (columns of those names are replaced)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Predictor(shipped.value)
        for b in batches:
            found = [judge.score(t.as_py()) for t in b.column(b.num_columns - 1)]
            score = np.array([x for _, x in found], np.float64)
            lang = [x for x, _ in found]
            reject = (score < shipped.value.threshold) | np.array([x == UNKNOWN for x in lang], bool)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(reject, pa.bool_())], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    rest = docs.drop("lang_pred", "score", "rejected")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "lang_pred string", "score double", "rejected boolean"])
    return docs.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(text_col).cast("string").alias(unused(docs, "__text"))).mapInArrow(run, schema)


def predicted_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from rows whose crc32(doc_id) mod folds isn't 1."""
    model = train(docs, crc_mod(id_col, folds) != 1, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, folds) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return predict(slim, model).drop("text")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3) -> DataFrame:
    """docs without the rows whose language is rejected; all columns stay as they were."""
    model = train(docs, crc_mod(id_col, folds) != 1, id_col, text_col, lang_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Predictor(shipped.value)
        for b in batches:
            found = [judge.score(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([lang != UNKNOWN and score >= shipped.value.threshold for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
