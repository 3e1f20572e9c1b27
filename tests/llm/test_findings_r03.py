"""What a review of round 3 found in the training-data operators, held by small tests."""

from itertools import combinations

import numpy as np
import pytest

from loomgate.llm import simhash


@pytest.mark.parametrize("block", [512, 7])
def test_all_pairs_of_a_cell(spark, monkeypatch, block):
    """two similar documents of one cell, both near a leader that neither is similar to, are linked."""
    monkeypatch.setattr(simhash, "PAIRS", 4)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(simhash, "nearest_keys", lambda fps, sizes, pivots: np.zeros((len(fps), 1), np.int64))
    rng, texts = np.random.default_rng(8), {}
    for k in range(12):
        base = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
        for i, n in enumerate((0, 9, 10)):  # the second and third are at 0.796 and 0.776 to the first, at 0.975 to each other
            words = list(base)
            for at in range(20, 20 + 30 * n, 30):
                words[at] = f"x{at}"
            texts[100 * k + i] = " ".join(words)
    made = {d: simhash.wide_fingerprint(t)[0] for d, t in texts.items()}
    sets = {d: np.unique(simhash.shingle_hashes(t, 5)) for d, t in texts.items()}
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in combinations(sorted(texts), 2):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if np.bitwise_count(made[a] ^ made[b]).sum() <= simhash.WIDE_BITS and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()} == {d: root(d) for d in texts}
