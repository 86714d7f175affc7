"""Repeated byte strings against a plain search of all windows."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textbench.llm import suffixes

DOCS = "doc_id long, text string"


def plain(rows, depth):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = collections.Counter(b[i : i + depth] for _, b in texts for i in range(len(b) - depth + 1))
    out = []
    for d, b in texts:
        spans = []
        for i in range(len(b) - depth + 1):
            if times[b[i : i + depth]] > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + depth
                else:
                    spans.append([i, i + depth])
        edges = [0, *[x for s in spans for x in s], len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
        out.append((d, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


def corpus(seed, letters, n):
    """Texts from shared passages, some edited, with periodic stretches."""
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [make(rng.randint(10, 120)) for _ in range(6)] + [make(1) * 90, make(3) * 40]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(shared) if rng.random() < 0.5 else make(rng.randint(0, 60)) for _ in range(rng.randint(0, 8)))
        if text and rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(letters) + text[at + 1 :]
        rows += [(i, text)] * (1 if rng.random() < 0.9 else 3)
    return rows


@pytest.mark.parametrize("most", [1, 3, suffixes.MOST])
@pytest.mark.parametrize("letters, depth", [("ab", 24), ("abcdefgh é漢", 16), ("abcdefghijklmnopqrstuvwxyz ", 45)])
def test_equals_plain_search(spark, letters, depth, most):
    rows = corpus(depth, letters, 60)
    want = plain(rows, depth)
    assert sum(r[2] for r in want) and any(0 < r[2] < r[1] for r in want)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert collected(suffixes.summary(docs, depth, most)) == want


def test_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdef ", k=60_000))
    rows = [
        (1, None),
        (2, ""),
        (3, "x" * 199),
        (4, "x" * 200),
        (5, "y" * 201),
        (6, long),
        (7, "é" + long[1000:1300] + "漢字" * 80),
        (7, "é" + long[1000:1300] + "漢字" * 80),
        (None, long[59_800:]),
        (8, "word " * 5_000),
        (9, "\u0000🙂" * 60),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for clash in ("key", "uid", "runs", "gram", "kind", "n_bytes"):
        docs = docs.withColumn(clash, F.lit("clash"))
    want = plain(rows, 200)
    assert collected(suffixes.summary(docs)) == want
    assert {r[0] for r in want if r[2]} == {5, 6, 7, None, 8, 9}
    kept = {r.doc_id: (r.spans, r.kept) for r in suffixes.removed(docs).where("doc_id in (3, 6)").collect()}
    assert kept[3] == ([], b"x" * 199)
    assert [tuple(s) for s in kept[6][0]] == [(1000, 1300), (59_800, 60_000)]
    assert kept[6][1] == (long[:1000] + long[1300:59_800]).encode()


def test_empty_table(spark):
    assert collected(suffixes.summary(spark.createDataFrame([], DOCS))) == []


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_long_texts_in_pieces(monkeypatch, piece):
    """Each window is in one stretch, wherever a text is cut; equal windows have one gram."""
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    text = (b"abcab" * 30 + b"the quick brown fox jumps over it" * 4 + b"abcab" * 30).decode()
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 1]), pa.array([b"k", b"l"]), pa.array([text, "short"])], ["uid", "key", "text"]
    )
    depth, seen = 40, {}
    for out in suffixes._described(depth)([batch]):
        for row in out.to_pylist():
            first, last, at = suffixes.unpacked(np.array(row["place"]))
            for f, l, a, g in zip(first, last, at, row["gram"]):
                for i in range(f, l + 1):
                    assert i not in seen
                    seen[i] = (g, a - i)
    assert sorted(seen) == list(range(len(text) - depth + 1))
    by = {}
    for i, mark in seen.items():
        assert by.setdefault(text[i : i + depth], mark) == mark


def test_radix_groups():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    start = rng.choice(3900, 700, replace=False)
    group, times = start % 3, rng.integers(1, 3, 700)
    got = suffixes.radix_groups(data, start, group, times, 18)
    all_of = collections.Counter()
    for s, g, t in zip(start, group, times):
        all_of[g, data[s : s + 18].tobytes()] += t
    assert got.tolist() == [all_of[g, data[s : s + 18].tobytes()] > 1 for s, g in zip(start, group)]
