"""The splitting reader of JSON arrays against the reader of whole files."""

import json
import os
import random

import pytest

from textbench.sources import elements, readers


def _value(rng, k):
    text = "".join(rng.choice('ab,]}[{":\\\n é漢') for _ in range(rng.randint(0, 40)))
    return {"sample_id": f"s{k}", "t": text, "n": [1, [2, {"x": '],[\\"}'}]], "m": {"samples": [1, 2], "z": None}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, out = random.Random(5), tmp_path_factory.mktemp("arrays")
    rows = lambda n: [_value(rng, i) for i in range(n)]
    files = {
        "bare": json.dumps(rows(20)),
        "pretty": " \n" + json.dumps(rows(6), indent=2, ensure_ascii=False),
        "wrapped": json.dumps({"meta": {"samples": [1, 2]}, "o": [1, [2]], "samples": rows(9), "tail": [[9], 'x,"samples']}),
        "named": json.dumps({'x,"samples': [5], "samples": None, "interactions": rows(5)}, indent=1),
        "both": json.dumps({"interactions": [1, 2], "samples": [_value(rng, 1), "str,ing", 3, None, [1, 2]]}),
        "empty": "[ ]",
        "empty_named": '{"samples": []}',
        "neither": '{"a": [1,2], "b": {"samples": [3]}}',
        "scalars": '[1, "a,b", null, [], {}, true]',
        "blank": "",
        "long": json.dumps(["x" * 3000, "y,\\" * 500, {"k": ["[" * 300]}]),
    }
    for name, text in files.items():
        (out / f"{name}.json").write_text(text)
    return str(out)


def _rows(df):
    return sorted([(os.path.basename(r.path), r.layout, r.ord, r.raw) for r in df.collect()], key=repr)


@pytest.mark.parametrize("size, most", [("128m", 10), ("2k", 10**6), ("500", 10**6), ("500", 0)])
def test_equal_to_whole_files_for_every_split_size(spark, folder, size, most, monkeypatch):
    want = _rows(readers.normalize_container(readers.read_containers(spark, folder)))
    monkeypatch.setattr(elements, "MOST_BROADCAST", most)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = elements.read_elements(spark, folder)
        tasks = elements.fragments(spark, f"{folder}/bare.json").rdd.getNumPartitions()
        assert _rows(read) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 4 or size in ("128m", "2k")


def _passes(text, cuts):
    """The passes over ranges that begin at the given commas, in plain Python."""
    bounds = [0, *[i + 1 for i in cuts], len(text)]
    inside, depth, bare, got = False, 0, elements._bare(text), []
    for a, b in zip(bounds, bounds[1:]):
        arrays = elements.Arrays(a, inside, depth, bare)
        got += [(p, begun, ended) for _, _, p, begun, ended in arrays.feed(text[a:b])]
        got += [(p, begun, ended) for _, _, p, begun, ended in arrays.finish()]
        inside, depth = arrays.inside, arrays.depth
    out = []
    for piece, begun, ended in got:
        if begun:
            out.append(b"")
        out[-1] += piece
    return out


def test_any_comma_may_begin_a_range():
    rng = random.Random(2)
    for _ in range(60):
        rows = [_value(rng, i) for i in range(4)]
        text = json.dumps(rows).encode()
        commas = [i for i, x in enumerate(text) if x == 44]
        cuts = sorted(rng.sample(commas, rng.randint(0, len(commas))))
        assert [json.loads(x) for x in _passes(text, cuts)] == rows


def test_a_broken_element_leaves_the_others(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"sample_id": "a"}, {"sample_id": nope}, {"sample_id": "c"}]')
    got = readers.read_items(elements.read_elements(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r.ord, r.sample_id, r.is_complete) for r in got] == [(0, "a", False), (1, None, False), (2, "c", False)]
