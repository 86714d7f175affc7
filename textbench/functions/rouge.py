"""ROUGE-1, ROUGE-2 and ROUGE-L of token arrays.

All three are functions of one row, so they run inside the task that holds the
row and need no shuffle. A batch is scored in pieces of bounded tokens over flat Arrow buffers: tokens
of a piece become numbers once, n-grams are counted by sorting, and the longest common subsequences
of all rows grow side by side.

The subsequence is found from match points (Hunt and Szymanski 1977): `piles` holds
for each length the least end in the longer text of a common subsequence so long. Step t
takes the t-th matched token of every row's shorter text; all its places in
the longer text are put on their piles in one search. Memory follows the tokens and the match points
of a step, never the product of two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = "rouge_1_f double, rouge_2_f double, rouge_l_f double"
#: Match points of one row from which bit vectors are cheaper, and bytes of masks that are kept for them.
DENSE, MASK_BYTES = 20_000_000, 64 << 20
#: Tokens of both sides that are scored at once.
PIECE = 1 << 17


def f_measures(hits: np.ndarray, predicted: np.ndarray, referenced: np.ndarray) -> np.ndarray:
    precision = hits / np.maximum(predicted, 1)
    recall = hits / np.maximum(referenced, 1)
    return np.where(hits > 0, 2 * precision * recall / np.where(hits > 0, precision + recall, 1), 0.0)


class Tokens:
    """Token numbers of the rows of a batch, one after the other."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.codes, self.lengths = codes, lengths
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.row = np.repeat(np.arange(len(lengths)), lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second token, and row, of neighbours."""
        inside = self.row[1:] == self.row[:-1]
        return self.codes[:-1][inside], self.codes[1:][inside], self.row[1:][inside]


def both_tokens(a: pa.Array, b: pa.Array) -> tuple[Tokens, Tokens]:
    """Tokens of two arrays of lists under common numbers; a null row has none."""
    sides = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b)]
    lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in sides]
    flat = [x.flatten() for x in sides]
    together = pa.concat_arrays([x.cast(pa.large_string()) for x in flat])
    codes = together.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cut = len(flat[0])
    return Tokens(codes[:cut], lengths[0]), Tokens(codes[cut:], lengths[1])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def shared_counts(keys: np.ndarray, row: np.ndarray, others: np.ndarray, other_row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, common elements of two bags of keys."""
    wide = int(max(keys.max(initial=0), others.max(initial=0))) + 1
    if wide * rows >= 1 << 62:
        code = np.unique(np.concatenate([keys, others]), return_inverse=True)[1]
        keys, others, wide = code[: len(keys)], code[len(keys) :], len(code)
    a, n = _counted(row * wide + keys)
    b, m = _counted(other_row * wide + others)
    if not len(a) or not len(b):
        return np.zeros(rows)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    met = b[at] == a
    return np.bincount(a[met] // wide, np.minimum(n[met], m[at[met]]), rows)


def _bit_lcs(a: np.ndarray, b: np.ndarray) -> int:
    """The bit-vector recurrence of Hyyrö (2004), for long texts of frequent tokens.

    Masks of the most frequent tokens are kept, MASK_BYTES at most; others are made when they are met.
    """
    order = np.argsort(a, kind="stable")
    codes, first, many = np.unique(a[order], return_index=True, return_counts=True)
    places = dict(zip(codes.tolist(), np.split(order, first[1:])))

    def mask(code: int) -> int:
        at = places.get(code)
        if at is None:
            return 0
        bits = np.zeros(len(a), np.uint8)
        bits[at] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    often = codes[np.argsort(-many, kind="stable")][: MASK_BYTES // (len(a) // 8 + 1)]
    kept = {code: mask(code) for code in often.tolist()}
    full = (1 << len(a)) - 1
    left = full
    for code in b.tolist():
        met = left & (kept[code] if code in kept else mask(code))
        if met:
            left = ((left + met) | (left - met)) & full
    return len(a) - left.bit_count()


def lcs_lengths(a: Tokens, b: Tokens) -> np.ndarray:
    """Length of the longest common subsequence of each row."""
    rows = len(a.lengths)
    out = np.zeros(rows, np.int64)
    if not len(a.codes) or not len(b.codes):
        return out
    # Step over the shorter text of a row, pile up places of the longer one.
    swap = a.lengths > b.lengths
    wide = int(max(a.codes.max(), b.codes.max())) + 1
    code = np.concatenate([a.codes, b.codes])
    row = np.concatenate([a.row, b.row])
    place = np.concatenate([np.arange(len(a.codes)) - a.starts[a.row], np.arange(len(b.codes)) - b.starts[b.row]])
    longer = np.concatenate([swap[a.row], ~swap[b.row]])
    key = row * wide + code
    order = np.lexsort((place[longer], key[longer]))
    held, there = key[longer][order], place[longer][order]
    by_row = np.argsort(row[~longer], kind="stable")
    asked, step_row = key[~longer][by_row], row[~longer][by_row]
    low, high = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
    many = high - low
    points = np.bincount(step_row, many, rows)
    for r in np.flatnonzero(points > DENSE).tolist():
        out[r] = _bit_lcs(a.codes[a.starts[r] : a.ends[r]], b.codes[b.starts[r] : b.ends[r]])
        many[step_row == r] = 0
    met = many > 0
    low, many, step_row = low[met], many[met], step_row[met]
    # The turn of a token among the matched ones of its row; tokens come in the order of rows and places.
    first = np.searchsorted(step_row, np.arange(rows))
    turn = np.arange(len(step_row)) - first[step_row]
    order = np.lexsort((step_row, turn))
    low, many, step_row, turn = low[order], many[order], step_row[order], turn[order]
    size = np.bincount(step_row, minlength=rows)
    base = np.arange(rows) * (int(max(a.lengths.max(), b.lengths.max())) + 2)
    none = int(max(a.lengths.max(), b.lengths.max())) + 1
    piles = np.repeat(base + none, size)
    edges = np.append(np.searchsorted(turn, np.arange(int(turn[-1]) + 1 if len(turn) else 0)), len(turn))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        n = many[x:y]
        total = int(n.sum())
        at = np.arange(total) + np.repeat(low[x:y] - np.cumsum(n) + n, n)
        end = there[at] + np.repeat(base[step_row[x:y]], n)
        pile = np.searchsorted(piles, end)
        new = np.ones(total, bool)
        new[1:] = pile[1:] != pile[:-1]
        piles[pile[new]] = end[new]
    owner = np.repeat(np.arange(rows), size)
    return out + np.bincount(owner[piles < base[owner] + none], minlength=rows)


def pieces_of(preds: pa.Array, refs: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows that hold PIECE tokens of both sides, or one row that holds more."""
    tokens = sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (preds, refs))
    ends = np.cumsum(tokens)
    low = 0
    while low < len(ends):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield low, high
        low = high


def score_arrays(preds: pa.Array, refs: pa.Array) -> pa.Array:
    """Scores of a batch, piece by piece: memory follows a piece and not the rows of a batch."""
    found = [_score_piece(preds.slice(low, high - low), refs.slice(low, high - low)) for low, high in pieces_of(preds, refs)]
    return pa.concat_arrays(found) if found else _score_piece(preds, refs)


def _score_piece(preds: pa.Array, refs: pa.Array) -> pa.Array:
    a, b = both_tokens(preds, refs)
    rows = len(a.lengths)
    one = shared_counts(a.codes, a.row, b.codes, b.row, rows)
    wide = int(max(a.codes.max(initial=0), b.codes.max(initial=0))) + 1
    (p, q, row), (r, s, other) = a.pairs(), b.pairs()
    two = shared_counts(p * wide + q, row, r * wide + s, other, rows)
    fewer = [np.maximum(x.lengths - 1, 0) for x in (a, b)]
    scores = [
        f_measures(one, a.lengths, b.lengths),
        f_measures(two, *fewer),
        f_measures(lcs_lengths(a, b), a.lengths, b.lengths),
    ]
    given = pc.and_(preds.is_valid(), refs.is_valid()).to_numpy(zero_copy_only=False)
    columns = [pa.array(x, pa.float64(), mask=~given) for x in scores]
    return pa.StructArray.from_arrays(columns, ["rouge_1_f", "rouge_2_f", "rouge_l_f"])


def rouge(prediction_tokens: Column, reference_tokens: Column) -> Column:
    """struct(rouge_1_f, rouge_2_f, rouge_l_f); nulls where either side is null."""
    return F.arrow_udf(score_arrays, SCORES)(prediction_tokens, reference_tokens)
