"""ROUGE of large batches in bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from textbench.functions import rouge


def _batch(rows: int):
    rng = np.random.default_rng(2)
    sides = [[[str(t) for t in rng.integers(0, 40, rng.integers(0, 30))] for _ in range(50)] for _ in range(2)]
    return [pa.array((side + [None]) * (rows // 51 + 1))[:rows] for side in sides]


def test_pieces_score_as_single_rows(monkeypatch):
    a, b = _batch(300)
    whole = rouge.score_arrays(a, b).to_pylist()
    assert whole == [rouge.score_arrays(a.slice(i, 1), b.slice(i, 1)).to_pylist()[0] for i in range(300)]
    monkeypatch.setattr(rouge, "PIECE", 100)
    assert len(list(rouge.pieces_of(a, b))) > 50
    assert rouge.score_arrays(a, b).to_pylist() == whole


def test_memory_does_not_follow_the_rows_of_a_batch():
    peaks = []
    for rows in (10_000, 80_000):
        a, b = _batch(rows)
        tracemalloc.start()
        rouge.score_arrays(a, b)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
