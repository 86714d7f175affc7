"""Spelling variants against a plain search for near words."""

import collections
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textbench.llm import spelling

DOCS = "doc_id long, text string"


def plain(rows, least=3):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if doc is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out, key=repr)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def collected(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("aabé", min_size=5, max_size=7), max_size=25))
def test_partitions_hold_each_near_pair_once(words):
    found = []
    parts = collections.defaultdict(list)
    for w in words:
        for m in (len(w), len(w) - 1):
            shared = (m - 1) // 2
            for back in (False, True):
                key = w[len(w) - shared :] if back else w[:shared]
                parts[m, back, key].append((w, 1, len(w) == m, True))
    for (m, back, _), rows in parts.items():
        found += spelling.solve(m, back, rows)
    want = {(a, b) for a in words for b in words if one_edit(a, b) and (len(a), a) < (len(b), b)}
    assert sorted(found) == sorted(want)


def test_acceptor_is_minimal():
    words = sorted({a + b for a in ("x", "y", "zz") for b in ("abe", "abes", "able", "ables")})
    acceptor = spelling.Acceptor(words)
    reached, todo = {0}, [0]
    while todo:
        for q in acceptor.arcs[todo.pop()].values():
            if q not in reached:
                reached.add(q)
                todo.append(q)
    accepted = []

    def walk(q, head):
        if q in acceptor.final:
            accepted.append(head)
        for c, p in acceptor.arcs[q].items():
            walk(p, head + c)

    walk(0, "")
    # Start, the second z, and one state each after x|y|zz, a, b, e|l(e), the last e and s.
    assert sorted(accepted) == words and len(reached) == 8


TEXTS = [
    (1, "Colour colour COLOUR colour colour colour color color color"),
    (2, None),
    (3, ""),
    (4, "12 -- 漢字 …"),
    (5, "naïve naïve naïve naive naive naive naive naive naive Ünïté"),
    (6, "colors colors colors colouur colouur colouur abcd abcd abcd abcde abcde abcde"),
    (6, "colors colors colors colouur colouur colouur abcd abcd abcd abcde abcde abcde"),
    (None, "colour colour nobody nobody nobody nobodi nobodi nobodi"),
    (7, "aaaaaa " * 3 + "aaaaa " * 6 + "aaaaaaa " * 3 + "÷÷÷÷÷ ×÷÷÷÷ " * 3),
    (8, "y" * 30_000 + " " + "y" * 30_000 + " " + ("y" * 30_001 + " ") * 3 + "y" * 30_000),
]


@pytest.mark.parametrize("piece", [1, 3, spelling.PIECE])
def test_odd_rows(spark, piece):
    docs = spark.createDataFrame(TEXTS, DOCS)
    for clash in ("word", "n", "run", "root", "_m"):
        docs = docs.withColumn(clash, F.lit("clash"))
    want = plain(TEXTS)
    assert collected(spelling.variants(docs, piece=piece)) == want
    forms = {w: f for w, _, _, f, _, _ in want}
    assert forms["color"] == "colour" and forms["aaaaaa"] == "aaaaa" and forms["naïve"] == "naive"


def test_long_chains_reach_the_last_form(spark):
    words = ["abcdefghij"[:i] + "xxxxxxxxxx"[i:] for i in range(11)]
    rows = [(1, " ".join(w for i, w in enumerate(words) for _ in range(3 * 2**i)))]
    got = collected(spelling.variants(spark.createDataFrame(rows, DOCS)))
    assert got == plain(rows) and sum(r[5] == words[-1] for r in got) > 6


def test_empty_table(spark):
    assert collected(spelling.variants(spark.createDataFrame([], DOCS))) == []
