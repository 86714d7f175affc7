"""Benchmark passages inside documents, found by edit distance.

Method: the CGK random walk embeds a sequence of n words so that few edits
change few positions. The walk holds a pointer into the sequence; each step
writes the word under it and moves on by a random bit that hangs on the step
and the word. Bit-sampling LSH reads one or two positions of the embedding as a
key; it is repeated with independent walks. Windows have the size of the item
and start at every word. Candidates are verified by exact edit distance over words.

Walks agree at ever fewer positions the longer an item is. The agreement is
measured for each group of lengths on random edits at the largest distance, and
gives the walks that reach the wanted recall there; nearer passages are met with
a higher chance, exact ones always.

Windows that cannot reach the threshold are not embedded. That bound loses
nothing: k edits break at most 2k of an item's n-1 word pairs, so a window of n
words must hold at least n-1-2k word pairs that occur in items of n words.

Everything is decided inside a document: there is no shuffle. The benchmark is
a stated query set. It is searched in blocks of at most `BLOCK` items, one
column for each, so the index an executor holds is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.wordbytes import byte_chunks, mix, words

BLOCK = 20_000
SIMILARITY = 0.8
#: Wanted of the walks for the window that starts with a passage at the largest distance;
#: the windows around it add to that.
RECALL = 0.99
#: Positions that a key reads at most, and the walks up to which it reads more than one.
SAMPLED = 2
MOST_WALKS = 64
#: Edited copies and walks of one measurement.
_COPIES, _TRIALS = 64, 32
#: Cells of the walks that are held at a time.
_CELLS = 1 << 18
HITS = "array<struct<item_id:bigint,distance:int,words:int,first_word:bigint>>"


def most_edits(n: np.ndarray | int, similarity: float):
    return np.floor(n * (1 - similarity) + 1e-9).astype(int)


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one."""
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def _bits(walks: int, step: int) -> np.ndarray:
    """Odd multipliers whose product with a word gives the walks' random bit at a step."""
    return mix(np.arange(walks, dtype=np.uint64) * np.uint64(0x1F123BB5) + np.uint64(step)) | np.uint64(1)


def walk(h: np.ndarray, at: np.ndarray, end: np.ndarray, steps: int):
    """The word that each walk (rows x walks) writes at each step; 1 beyond the end."""
    h = np.append(h, np.uint64(1))
    at = at.copy()
    for step in range(steps):
        word = h[np.where(at < end, at, len(h) - 1)]
        yield word
        at += ((word * _bits(at.shape[1], step)[None]) >> np.uint64(63)).astype(np.int64)


def edited(words_: np.ndarray, edits: int, random: np.random.Generator) -> np.ndarray:
    """A copy with words replaced, inserted and deleted at random places."""
    out = words_.tolist()
    for _ in range(edits):
        at, kind = int(random.integers(len(out))), random.integers(3)
        if kind == 0:
            del out[at]
        else:
            out[at : at + (kind == 1)] = [int(random.integers(2, 1 << 62))]
    return np.array(out, np.uint64)


@lru_cache(maxsize=256)
def agreement(n: int, similarity: float) -> np.ndarray:
    """Share of positions at which walks over an item of n words and over its edited copies agree.

    One row per copy at the largest distance, one column per walk.
    """
    random = np.random.default_rng(n)
    item = random.integers(2, 1 << 62, n, np.uint64)
    # A window reads on in the text where its passage became shorter.
    after = random.integers(2, 1 << 62, n, np.uint64)
    copies = [
        np.append(edited(item, int(most_edits(n, similarity)), random), after)[:n] for _ in range(_COPIES)
    ]
    h = np.concatenate([item, *copies])
    start = np.repeat(np.arange(_COPIES + 1)[:, None] * n, _TRIALS, axis=1)
    same = np.zeros((_COPIES, _TRIALS))
    for word in walk(h, start, start[:, :1] + n, 2 * n):
        same += word[1:] == word[:1]
    return same / (2 * n)


def plan(n: int, similarity: float, recall: float, sampled: int) -> tuple[int, int]:
    """(walks, positions per key) that meet passages of n words with the wanted chance."""
    share = agreement(n, similarity)
    for positions in range(sampled, 0, -1):
        met = (share**positions).mean(axis=1)
        walks = 1
        while (1 - (1 - met) ** walks).mean() < recall:
            walks += 1
        if walks <= MOST_WALKS:
            break
    return walks, positions


@dataclass
class Index:
    ids: np.ndarray
    tokens: list[np.ndarray]
    similarity: float
    recall: float
    sampled: int
    short: Short

    def __post_init__(self):
        self.size = np.array([len(t) for t in self.tokens], int)
        self.lengths = np.unique(self.size)
        # Lengths of one half power of two share a plan, that of the longest.
        self.group = np.floor(2 * np.log2(np.maximum(self.lengths, 1))).astype(int)
        longest = {g: int(self.lengths[self.group == g].max()) for g in np.unique(self.group)}
        plans = {g: plan(n, self.similarity, self.recall, self.sampled) for g, n in longest.items()}
        self.walks = np.array([plans[g][0] for g in self.group], int)
        self.positions = np.array([plans[g][1] for g in self.group], int)
        random = np.random.default_rng(20240607)
        self.draw = random.random((int(self.walks.max(initial=1)), self.sampled))
        # Which lengths of items hold a word pair; the bound is kept per length.
        own = [(_pairs(t), np.searchsorted(self.lengths, len(t))) for t in self.tokens]
        gram = np.concatenate([g for g, _ in own]) if own else np.zeros(0, np.uint64)
        size = np.concatenate([np.full(len(g), n) for g, n in own]) if own else np.zeros(0, int)
        order = np.lexsort((size, gram))
        gram, size = gram[order], size[order]
        if len(gram):
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (size[1:] != size[:-1])])
            gram, size = gram[new], size[new]
        self.grams, first = np.unique(gram, return_index=True)
        self.first = np.append(first, len(gram))
        self.of_length = size.astype(np.uint16)
        self.screen = np.zeros(1 << 20, bool)
        self.screen[self.grams >> np.uint64(44)] = True
        buckets, owner = [np.zeros(0, np.uint64)], [np.zeros(0, int)]
        for n in self.lengths:
            own = np.flatnonzero(self.size == n)
            rows = max(1, _CELLS // int(n))
            for part in (own[a : a + rows] for a in range(0, len(own), rows)):
                start = np.arange(len(part)) * n
                keys = self.sample(np.concatenate([self.tokens[i] for i in part]), start, start + n, n)
                buckets.append(keys.ravel())
                owner.append(np.repeat(part, keys.shape[1]))
        bucket, owner = np.concatenate(buckets), np.concatenate(owner)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.owner = bucket[order], owner[order]

    def sample(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
        """LSH keys (rows x walks) of windows of n words from `start`, padded beyond `stop`."""
        k = np.searchsorted(self.lengths, n)
        walks, positions = int(self.walks[k]), int(self.positions[k])
        step = (self.draw[:walks, :positions] * (2 * int(n))).astype(np.int64)
        read = np.empty((positions, len(start), walks), np.uint64)
        at = np.repeat(start[:, None], walks, axis=1)
        end = np.minimum(start + n, stop)[:, None]
        for t, word in enumerate(walk(h, at, end, int(step.max()) + 1)):
            for p in range(positions):
                now = np.flatnonzero(step[:, p] == t)
                if len(now):
                    read[p][:, now] = word[:, now]
        key = mix(np.uint64(n) * np.uint64(0x9E3779B9) + np.arange(walks, dtype=np.uint64))[None]
        for p in range(positions):
            key = mix(key ^ (read[p] * np.uint64(2 * p + 3)))
        return key

    def candidates(self, h, start, stop, n):
        """(start, stop, item) of windows that meet an item in some walk."""
        out = [np.zeros((3, 0), int)]
        for k in np.unique(np.searchsorted(self.lengths, n)):
            own = np.flatnonzero(n == self.lengths[k])
            rows = max(1, _CELLS // int(self.walks[k] * self.positions[k]))
            for first in range(0, len(own), rows):
                part = own[first : first + rows]
                keys = self.sample(h, start[part], stop[part], self.lengths[k])
                low = np.searchsorted(self.bucket, keys, "left")
                high = np.searchsorted(self.bucket, keys, "right")
                row, at = np.nonzero(high > low)
                count = (high - low)[row, at]
                spot = np.repeat(low[row, at] - np.cumsum(count) + count, count) + np.arange(count.sum())
                both = np.unique(np.stack([np.repeat(row, count), self.owner[spot]]), axis=1)
                out.append(np.stack([start[part][both[0]], stop[part][both[0]], both[1]]))
        return np.concatenate(out, axis=1)

    def windows(self, h: np.ndarray, doc: np.ndarray, bounds: np.ndarray):
        """(start, stop, n) of the windows that hold enough word pairs of the benchmark."""
        none = (np.zeros(0, int),) * 3
        if len(h) < 2:
            return none
        pair = _pairs(h)
        known = self.screen[pair >> np.uint64(44)]
        known &= doc[:-1] == doc[1:]
        at = np.flatnonzero(known)
        if not len(at) or not len(self.grams):
            return none
        gram = np.minimum(np.searchsorted(self.grams, pair[at]), len(self.grams) - 1)
        true = self.grams[gram] == pair[at]
        at, gram = at[true], gram[true]
        count = self.first[gram + 1] - self.first[gram]
        which = np.repeat(self.first[gram] - np.cumsum(count) + count, count) + np.arange(count.sum())
        length, at = self.of_length[which], np.repeat(at, count)
        order = np.argsort(length, kind="stable")
        length, at = length[order], at[order]
        cuts = np.searchsorted(length, np.arange(len(self.lengths) + 1))
        found = []
        for k, n in enumerate(self.lengths):
            place = at[cuts[k] : cuts[k + 1]]
            least = max(int(n - 1 - 2 * most_edits(n, self.similarity)), 1)
            if len(place) < least:
                continue
            # Runs of `least` known pairs that fit into one window of n words of one text.
            a, b = place[: len(place) - least + 1], place[least - 1 :]
            fits = (b - a <= n - 2) & (doc[a] == doc[b])
            a, b = a[fits], b[fits]
            if not len(a):
                continue
            low = np.maximum(b - (n - 2), bounds[doc[a]])
            many = a - low + 1
            start = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            start = np.unique(start)
            found.append(np.stack([start, bounds[doc[start] + 1], np.full(len(start), n)]))
        return tuple(np.concatenate(found, axis=1)) if found else none


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(31) + h[k : k + len(out)])
    return out


class Short:
    """Items of too few words for an edit: they are met as they are, word for word."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_length = {}
        for n in sorted({len(t) for _, t in items}):
            own = sorted((int(_sequences(t, n)[0]), i) for i, t in items if len(t) == n)
            self.by_length[n] = np.array([k for k, _ in own], np.uint64), [i for _, i in own]

    def met(self, h: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], dict]:
        """The first place of each (text, item)."""
        out: dict[tuple[int, int], dict] = {}
        for n, (keys, ids) in self.by_length.items():
            if len(h) < n:
                continue
            own = _sequences(h, n)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for at in np.flatnonzero((high > low) & (doc[: len(own)] == doc[n - 1 :])).tolist():
                d = int(doc[at])
                for item in ids[low[at] : high[at]]:
                    hit = {"item_id": int(item), "distance": 0, "words": n, "first_word": at - int(bounds[d])}
                    out.setdefault((d, int(item)), hit)
        return out


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any stretch of the region, and where it ends."""
    n = len(item)
    steps = np.arange(n + 1)
    row = steps.copy()
    best, end = n, 0
    for t, word in enumerate(region):
        new = np.empty(n + 1, int)
        new[0] = 0
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (item != word))
        row = np.minimum.accumulate(new - steps) + steps
        if row[n] < best:
            best, end = int(row[n]), t + 1
    return best, end


def search(index: Index, texts: pa.Array) -> list[list[dict]]:
    """Verified hits per text."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for first, data, places in byte_chunks(texts):
        found = words(data, places)
        h, bounds = found.hash(), found.bounds()
        for (d, _), hit in sorted(index.short.met(h, found.doc, bounds).items()):
            out[first + d].append(hit)
        if not len(index.ids):
            continue
        start, stop, n = index.windows(h, found.doc, bounds)
        if not len(start):
            continue
        start, stop, item = index.candidates(h, start, stop, n)
        if not len(start):
            continue
        order = np.lexsort((start, item, found.doc[start]))
        start, stop, item = start[order], stop[order], item[order]
        text = found.doc[start]
        apart = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (np.diff(start) > index.size[item[1:]])
        runs = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(start)]])
        best: dict[tuple[int, int], dict] = {}
        for a, b in zip(runs[:-1], runs[1:]):
            i, d = int(item[a]), int(text[a])
            words_ = index.tokens[i]
            n_ = len(words_)
            most = int(most_edits(n_, index.similarity))
            exact = next((s for s in start[a:b] if s + n_ <= stop[a] and (h[s : s + n_] == words_).all()), None)
            if exact is not None:
                distance, at = 0, int(exact)
            else:
                low = max(int(start[a]) - most, int(bounds[d]))
                high = min(int(start[b - 1]) + n_ + most, int(stop[a]))
                # Each edit changes one word of the item, so all others are in the region.
                if n_ - np.isin(words_, h[low:high]).sum() > most:
                    continue
                distance, end = edit_distance(words_, h[low:high])
                if distance > most:
                    continue
                at = max(low + end - n_, low)
            hit = best.get((d, i))
            if hit is None or distance < hit["distance"]:
                best[d, i] = {"item_id": int(index.ids[i]), "distance": distance, "words": n_, "first_word": at - int(bounds[d])}
        for (d, _), hit in sorted(best.items()):
            out[first + d].append(hit)
    return out


def build_index(
    items: list[tuple[int, str]],
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    sampled: int = SAMPLED,
) -> Index:
    """Index of one block of items (id, lower-case text)."""
    ids, tokens, short = [], [], []
    for first, data, places in byte_chunks(pa.array([t for _, t in items], pa.large_string())):
        found = words(data, places)
        h, bounds = found.hash(), found.bounds()
        for d in range(found.texts):
            own = h[bounds[d] : bounds[d + 1]].copy()
            if most_edits(len(own), similarity) > 0:
                ids.append(items[first + d][0])
                tokens.append(own)
            elif len(own):
                short.append((items[first + d][0], own))
    return Index(np.array(ids, np.int64), tokens, similarity, recall, sampled, Short(short))


def hits(text: Column, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", **options) -> Column:
    """Array of the benchmark items found in a text (least distance per item).

    Words are compared in lower case without punctuation. An item is found when
    a stretch of the text lies within (1 - similarity) times its words in edits.
    Items that are too short for an edit (fewer than five words at 0.8) are found as they are;
    items without words or with a null id are not searched.
    Null and empty texts have no hits.
    """
    named = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = named.select(F.col(id_col).cast("long"), F.lower(F.col(text_col))).toLocalIterator()
    blocks: list[list[tuple[int, str]]] = [[]]
    for row in rows:
        if len(blocks[-1]) == BLOCK:
            blocks.append([])
        blocks[-1].append(tuple(row))

    def searcher(block):
        kept: list[Index] = []

        def run(texts: pa.Array) -> pa.Array:
            if not kept:
                kept.append(build_index(block, **options))
            kind = pa.list_(
                pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("words", pa.int32()), ("first_word", pa.int64())])
            )
            return pa.array(search(kept[0], texts), kind)

        return F.arrow_udf(run, HITS)

    lower = F.lower(text)
    return F.flatten(F.array(*[searcher(b)(lower) for b in blocks]))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """(id, item_id, distance, words, first_word): a row per document and item found.

    The nearest stretch counts; `first_word` numbers the text's words from 0.
    Documents without a hit have no row. Repeated rows and rows with
    a null id are searched like any other. Other columns are ignored.
    """
    found = docs.select(F.col(id_col), hits(F.col(text_col), benchmark, **options).alias("_hits"))
    return found.select(id_col, F.inline("_hits"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage."""
    return docs.where(F.size(hits(F.col(text_col), benchmark, **options)) == 0)
