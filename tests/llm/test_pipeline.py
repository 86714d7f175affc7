"""The corpus pipeline against plain Python, and registered queries against SQL."""

import collections
import re

import pytest
from compare import connect, differences

import __spark_entry__ as entry
import corpus_pipeline
from textbench.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(queries()[name](spark, FOLDER), connect(FOLDER), oracle_sql()[name]) == []


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries()} <= names
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 14))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(input, output) rows of each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_stages_keep_columns(steps):
    for _, _, before, after in steps[:-1]:
        assert before == after
    assert steps[-1][3][-3:] == ["shard", "slot", "moved"]


def test_quality_stage(spark, steps):
    before, after, *_ = steps[0]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [r.doc_id in kept for r in before if marks.get(r.doc_id) == 1]
    bad = [r.doc_id in kept for r in before if marks.get(r.doc_id) == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.1 * len(bad)


def test_copies_stage(steps):
    before, after, *_ = steps[1]
    shingles = {}
    for r in before:
        w = (r.text or "").lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    kept = {r.doc_id for r in after}
    holders = collections.defaultdict(list)
    for i, s in shingles.items():
        for g in s:
            holders[g].append(i)
    shared = collections.Counter(
        (a, b) for h in holders.values() if len(h) < 50 for a in h for b in h if a < b
    )
    likeness = {(a, b): n / len(shingles[a] | shingles[b]) for (a, b), n in shared.items()}
    near = [ab for ab, j in likeness.items() if j >= 0.9]
    both = [ab for ab in near if kept.issuperset(ab)]
    assert near and len(both) <= 0.03 * len(near)
    # Whatever went has a near copy.
    best = collections.defaultdict(float)
    for (a, b), j in likeness.items():
        best[a], best[b] = max(best[a], j), max(best[b], j)
    assert all(best[i] > 0.55 for i in shingles.keys() - kept)


def test_decontamination_stage(spark, steps):
    before, after, *_ = steps[2]
    flat = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {r.doc_id for r in before if any(i in flat(r.text) for i in items)}
    kept = {r.doc_id for r in after}
    assert held and not held & kept
    # Others go only for near passages, which are few.
    assert len(before) - len(after) - len(held) <= 0.01 * len(before)


def test_mixing_stage(steps):
    before, after, *_ = steps[3]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        size[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    for r in after:
        taken[r.source] += words(r.text)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    level = sum(size.values()) / sum(weight.values())
    for s in size:
        if level * weight[s] < 3 * size[s]:
            assert -1 <= taken[s] - level * weight[s] * 0.98 and taken[s] <= level * weight[s] * 1.2 + longest[s]


def test_sharding_stage(steps):
    before, after, *_ = steps[4]
    assert len(before) == len(after)
    slots = collections.defaultdict(list)
    for r in after:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema)
