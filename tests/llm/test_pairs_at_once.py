"""Cells of near copies are compared in memory that doesn't grow with the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loomgate.llm import simhash


def _peak(cells, n):
    """(links of so many cells of n copies each, MB at most)."""
    fps = np.repeat(np.random.default_rng(5).integers(0, 2**63, (cells, simhash.WORDS)), n, 0)
    columns = [np.repeat(np.arange(cells), n), np.arange(cells * n), *fps.T]
    batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "rep", *(f"f{i}" for i in range(simhash.WORDS))])
    tracemalloc.start()
    found = {(a, b) for out in simhash._linker(simhash.WORDS, simhash.WIDE_BITS, False, False)(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return found, peak


def test_cells_of_copies_take_little_memory():
    found, peak = _peak(100, 100)
    assert {(c * 100, c * 100 + i) for c in range(100) for i in range(1, 100)} <= found
    assert all(a // 100 == b // 100 for a, b in found) and len({b for _, b in found}) == 100 * 99
    print(f"{peak:.0f} MB")
    assert peak < 60
