"""Byte-level BPE: exact encoding in linear time, and decoding.

A text is split by the tokenizer's pattern. Bytes of a piece are read as Latin-1 characters, so that
one automaton over the vocabulary gives the longest token at every position in a single pass. The
encoder takes longest matches and backtracks where two neighbours could not stand side by side in a
merge result; whether two tokens can is worked out once by the merges of just those two and
remembered. A sequence whose neighbours are all compatible is the merge result, so ids
equal those of merging by rank. No text is cut short, and a piece of any length costs time in proportion.

Defined results: null text is empty; an empty text has no ids; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgate.llm.common import type_of, unused

#: Entries at which a worker's memories of words, of matches and of token pairs are emptied; some 200 MB for all.
WORDS, PIECES, PAIRS = 400_000, 150_000, 400_000
#: Fixed value: the pattern for which encode() may go word by word (see there); others are split as a whole.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space behind other white space and before more of it or the end: there the pattern looks further than the space.
_INNER_SPACE = regex.compile(r"\s (?:\s|$)").search
_CODERS: dict[tuple[str, str], Coder] = {}


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public multilingual vocabulary installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, blob.splitlines()))}


class Coder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.by_words = pattern == WORD_PATTERN
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size, self.shorter = [0] * (max(ranks.values()) + 1), [-1] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():  # by rank: length, and the longest token that is a proper prefix
            self.size[rank] = len(token)
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.fits: dict[int, bool] = {}
        self.halves_of: dict[int, tuple[int, int] | None] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}  # a match of the pattern -> ids
        self.words: dict[str, tuple[int, ...]] = {}  # what follows a space, up to the next one -> ids, the space's included

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """Ids by repeated merging of the lowest rank, leftmost first, down to stop parts; for a token's bytes only."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > stop:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token, None for a single byte."""
        if token not in self.halves_of:
            data = self.bytes_of[token]
            self.halves_of[token] = (*self.merge(data, 2),) if len(data) > 1 else None
        return self.halves_of[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves exactly these two tokens of their joined bytes.

        The merges of both sides are taken back, latest first. Whatever stands at the border
        meanwhile must not merge earlier than what was taken back last."""
        if (known := self.fits.get(left << 32 | right)) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[left << 32 | right] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        ranks, bytes_of = self.ranks, self.bytes_of
        a, b, before = left, right, 1 << 60  # merges of a rank below `before` still come before what was taken back
        while True:
            joined = ranks.get(bytes_of[a] + bytes_of[b], 1 << 60)
            if joined < before:
                return False
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a and (not of_b or a > b):
                a, before = of_a[1], a
            elif of_b:
                b, before = of_b[0], b + 1  # at equal rank the left one merges first
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        size, shorter, fits, n = self.size, self.shorter, self.fits, len(data)
        longest = [0] * n
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            longest[end - size[rank] + 1] = rank  # ends ascend, so the longest of a start comes last
        is_open = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if is_open[end]:
                    if before < 0:
                        break
                    if (fit := fits.get(before << 32 | token)) is None:
                        fit = self.compatible(before, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before = end, token
                if at < n:
                    token = longest[at]
            else:  # nothing can stand here: this place is closed for good, and the token before it gets shorter
                is_open[at] = 0
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
        return tuple(out)

    def encode_span(self, span: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.split(span):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(ids) <= 64:  # longer ones are rare, and would fill the memory
                    if len(self.pieces) >= PIECES:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of text. A space that has something other than white space on one of its sides begins
        a match of the pattern, so what lies between such spaces can be encoded by itself."""
        if not self.by_words or _INNER_SPACE(text):
            return list(self.encode_span(text))
        first, *rest = text.split(" ")
        words = self.words
        new = set(rest).difference(words)
        if len(words) + len(new) > WORDS:
            words.clear()
            new = set(rest)
        for word in new:
            words[word] = self.encode_span(f" {word}")
        return [*self.encode_span(first), *chain.from_iterable(map(words.__getitem__, rest))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def coder(blob: bytes, pattern: str) -> Coder:
    """One for each vocabulary and Python worker."""
    key = (hashlib.md5(blob).hexdigest(), pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(parse_ranks(blob), pattern)
    return _CODERS[key]


def _shipped(spark: SparkSession, vocabulary: str | None, pattern: str | None):
    path, default_pattern = default_vocabulary()
    with open(vocabulary or path, "rb") as f:  # an installed file of a few MB at most, not an input
        return spark.sparkContext.broadcast(f.read()), pattern or default_pattern


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with out_col, the array of token ids of text_col."""
    blob, split = _shipped(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(blob.value, split)
        for b in batches:
            ids = [own.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*b.schema.names[:-1], out_col])

    rest = df.drop(out_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out_col}` array<int>"])
    return df.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(text_col).alias(unused(df, "__text"))).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with out_col, the bytes (binary) of ids_col; null for null."""
    blob, split = _shipped(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(blob.value, split)
        for b in batches:
            data = [None if ids is None else own.decode(ids) for ids in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(data, pa.binary())], names=[*b.schema.names[:-1], out_col])

    rest = df.drop(out_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out_col}` binary"])
    return df.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(ids_col).alias(unused(df, "__ids"))).mapInArrow(run, schema)


def coding_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, and decoded from the ids, in one pass."""
    blob, split = _shipped(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(blob.value, split)
        shown = {i: str(i) for i in own.bytes_of}
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for text in b.column(1):
                ids = own.encode(text.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {type_of(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
