"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A chunk is a run of whole texts, so one text is never split between chunks;
memory follows the chunk size, or the longest text where that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def byte_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    if not rows:
        return
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64, rows + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(places, places[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, data[places[first] : places[last]], places[first : last + 1] - places[first]
        first = last


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of one chunk; `doc` numbers the texts of the chunk from 0."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    texts: int
    _sums: np.ndarray

    def hash(self, length: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `length` bytes."""
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        _, down = _powers(len(self._sums))
        return mix((self._sums[end] - self._sums[self.start]) * down[self.start])

    def bounds(self) -> np.ndarray:
        """First word of each text, and the number of words."""
        return np.searchsorted(self.doc, np.arange(self.texts + 1))


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    table[128:] = True
    return table


LETTERS = _letters()
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def words(data: np.ndarray, places: np.ndarray, table: np.ndarray = LETTERS) -> Words:
    """Maximal runs of the bytes that `table` marks.

    With the letter table each ideograph or kana (lead bytes E3 to E9) is a
    word of its own, as such scripts write no spaces.
    """
    inside = table[data]
    ends_text = places[1:-1]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before[ends_text[ends_text < len(data)]] = False
    starts = inside & ~before
    if table is LETTERS and len(data):
        lead = (data >= 0xE3) & (data <= 0xE9)
        if lead.any():
            at = np.flatnonzero(lead)
            starts[at] = True
            after = at + 3
            after = after[after < len(data)]
            starts[after] = inside[after]
    start = np.flatnonzero(starts)
    # A word ends at the first byte outside, at the next start or at the end of its text.
    stop = np.zeros(len(data) + 1, bool)
    stop[:-1] = ~inside
    stop[places] = True
    stop[start] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    doc = np.searchsorted(places, start, "right") - 1
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(up[: len(data)] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    return Words(start, end, doc, len(places) - 1, sums)
