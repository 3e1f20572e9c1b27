"""Tokens of op9 are split, counted and looked up a batch at a time, with the results of text by text."""

from collections import Counter

import numpy as np
import pyarrow as pa

from loomgate.llm import gru, language_model

TEXTS = ["", None, " ", "\x0b\x0cA b\tA\r\n", "Ünï ÜNÏ   x\x1cy\x85z", "a" * 300 + " a", "  the  cat\x00 the\x1f ", "的 漢字　𝒳 的"]


def test_split_like_tokens():
    for texts in (pa.array(TEXTS), pa.array(["skipped", *TEXTS, "left"]).slice(1, len(TEXTS)), pa.array([], pa.string())):
        words, sizes = language_model.split(texts)
        own = [language_model.tokens(t) for t in texts.to_pylist()]
        assert words.to_pylist() == [w for doc in own for w in doc] and sizes.tolist() == [len(doc) for doc in own]
    rows = pa.RecordBatch.from_arrays([pa.array(TEXTS * 3)], names=["text"])
    assert pa.Table.from_batches(language_model.pieces(iter([rows]))).column(0).to_pylist() == TEXTS * 3


def test_look_up_like_one_by_one():
    counts = Counter(w for t in TEXTS for w in [*language_model.tokens(t), language_model.END])
    by_bucket: dict[int, tuple[int, int]] = {}
    for w, n in counts.items():
        if w != language_model.END:
            b = language_model.bucket_of(w)
            by_bucket[b] = (by_bucket.get(b, (0, 0))[0] + n, by_bucket.get(b, (0, 0))[1] + 1)
    frequent = [(w, n) for w, n in counts.items() if n > 1]
    for known in (frequent, []):
        lex = language_model.Lexicon(known, sum(counts.values()), len(counts), by_bucket)
        named, logs = dict(known), np.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
        for t, (numbers, share, base, n_known, left) in zip(TEXTS, lex.look_up(pa.array(TEXTS)), strict=True):
            words = [*language_model.tokens(t), language_model.END]
            assert len(numbers) == len(share) == len(base) == len(words) and n_known == sum(w in named for w in words)
            assert left == Counter(w for w in words[:-1] if w not in named)
            assert np.allclose(base, [np.log10(named.get(w, 0) + 0.5) - logs if w in named or w == language_model.END else -logs for w in words])
            assert numbers[-1] == lex.end
        if known:
            assert [x.tolist() for x in lex.numbers(pa.array(TEXTS))] == [x[0].tolist() for x in lex.look_up(pa.array(TEXTS))]


def test_adagrad_step():
    trainer = gru.Trainer(gru.start(np.ones(gru.CLASS)))
    was, sums = trainer.w.words.copy(), trainer.sums.words.copy()
    grad = np.random.default_rng(1).normal(size=was.shape).astype(np.float32)
    trainer._step("words", grad)
    assert np.allclose(trainer.sums.words, sums + grad * grad) and np.allclose(trainer.w.words, was - gru.RATE * grad / np.sqrt(sums + grad * grad))
