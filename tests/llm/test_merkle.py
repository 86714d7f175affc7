"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textbench.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    framed = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)]
    return digest(*framed)


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = i // 16 * 16
        yield level[run:i], level[i + 1 : run + 16]
        i //= 16


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[s])):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            x = leaf(r, text)
            for a, b in path:
                x = digest(*a, x, *b)
            root = top[-1][0]
            out.append((r[0], own, trees[s][-1][0], root, digest(*[y for a, b in path for y in a + b]), x, x == root))
    return sorted(out, key=repr)


def collected(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (5, "Repeated Row", "en", "b", 12),
    (5, "Repeated Row", "en", "b", 12),
    (5, "Same id, another text", "en", "b", 21),
    (None, "No Id", "en", "b", 5),
    (None, None, None, None, None),
    (6, "Ünï çödé 漢字 🙂 \u0000 X", None, "é", 20),
    (7, "Long " * 40_000, "en", "Z", 200_000),
]


@pytest.mark.parametrize("name", ["odd", "sizes", "one", "one_source", "many_sources"])
def test_manifest_equals_plain_tree(spark, name):
    rows = {
        "odd": ODD,
        "sizes": [(i, f"Text {i}", "en", f"s{n}", i) for n in (1, 2, 15, 16, 17, 33, 256, 257) for i in range(n)],
        "one": [(3, "Alone", "en", "s", 5)],
        "one_source": [(-i, f"Text {i}", "en", "s", i) for i in range(300)],
        "many_sources": [(i, f"Text {i}", "en", f"host{i % 290}", i) for i in range(600)],
    }[name]
    docs = spark.createDataFrame(rows, DOCS)
    if name == "odd":
        for clash in ("_key", "_pos", "_n", "_node", "leaf", "root", "now", "_at"):
            docs = docs.withColumn(clash, F.lit("clash"))
    assert collected(merkle.summary(docs)) == plain(rows)


def test_empty_table_and_untouched_texts(spark):
    assert collected(merkle.summary(spark.createDataFrame([], DOCS))) == []
    docs = spark.createDataFrame([(i, f"Text {i}", "en", "s", 6) for i in range(40)], DOCS)
    assert {r.verified for r in merkle.manifest(docs).collect()} == {True}
    changed = merkle.manifest(docs, F.when(F.col("doc_id") == 7, F.lit("x")).otherwise(F.col("text")))
    assert [r.doc_id for r in changed.where("not verified").collect()] == [7]
