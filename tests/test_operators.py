"""Operators against small plain-Python models, hot groups and file round trips."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textbench.operators import curate, ordinal, report, responses, score
from textbench.session import scratch_path
from textbench.sources import readers, writers
from textbench.streaming.scores import score_stream

# Wide gaps put neighbours into different pieces, as billions of rows would.
GAP = 40_000


def hot_items(spark, parts):
    """A third of all rows share one base id."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        base = "hot_a" if i % 3 == 0 else f"q{rng.randint(0, 60)}_b"
        rows.append((i * GAP, f"{base}_m{i}"))
    df = spark.createDataFrame(rows, "ord bigint, sample_id string")
    return rows, df.repartition(parts)


@pytest.mark.parametrize("parts", [1, 8])
def test_dedup_alternating_with_a_hot_group(spark, parts):
    rows, df = hot_items(spark, parts)
    groups = {}
    for order, name in rows:
        groups.setdefault(name.rsplit("_", 1)[0], []).append(order)
    want, k = set(), 0
    for members in groups.values():
        want.add(members[k % len(members)] if len(members) > 1 else members[0])
        k += len(members) > 1
    assert {r.ord for r in curate.dedup_alternating(df).collect()} == want
    assert {r.ord for r in curate.dedup_first(df).collect()} == {m[0] for m in groups.values()}


@pytest.mark.parametrize("parts", [1, 8])
def test_positions(spark, parts):
    rows, df = hot_items(spark, parts)
    keyed = df.withColumn("g", F.substring("sample_id", 1, 3))
    got = {r.ord: r.k for r in ordinal.with_position(keyed, "ord", "k", ["g"]).collect()}
    seen, want = {}, {}
    for order, name in rows:
        want[order] = seen.setdefault(name[:3], 0)
        seen[name[:3]] += 1
    assert got == want
    placed = ordinal.with_sorted_position(df, [F.col("sample_id").desc()], "k").collect()
    names = sorted((r[1] for r in rows), reverse=True)
    assert {r.sample_id: r.k for r in placed} == {n: i for i, n in enumerate(names)}


def test_failure_streaks_cross_pieces(spark):
    rng = random.Random(4)
    rows = [(e, i * GAP, rng.random() < 0.2) for e in range(20) for i in range(30)]
    want = {}
    for e in range(20):
        mine = [r for r in rows if r[0] == e]
        for before, now in zip(mine, mine[1:]):
            if before[2] and now[2]:
                want[e] = now[1]
                break
    df = spark.createDataFrame(rows, "e int, ord bigint, bad boolean").repartition(5)
    got = responses.failure_streaks(df, ["e"], F.col("bad")).collect()
    assert {r.e: r.stops_at for r in got} == want


def test_merge_takes_turns_and_keeps_the_last_duplicate(spark):
    schema = "sample_id string, ord bigint, v string"
    left = spark.createDataFrame([("b", 0, "l0"), ("a", 1, "l1"), ("b", 2, "l2"), ("", 3, "x"), (None, 4, "x")], schema)
    right = spark.createDataFrame([("c", 0, "r0"), ("b", 1, "r1"), ("a", 2, "r2")], schema)
    got = {r.sample_id: r.v for r in curate.merge_datasets(left, right, "_1", "_2").collect()}
    assert got == {"a_1": "l1", "b_2": "r1", "c_2": "r0"}


def test_quality_filter_needs_limits(spark):
    schema = "sample_id string, error_flag int, error_type string, error_sentence_id int, complete_accuracy double, detection_accuracy double"
    items = spark.createDataFrame([("a", 1, "t", 1, 0.5, 0.5), ("b", 1, "t", None, 0.5, 0.5), ("c", 0, None, None, None, None)], schema)
    kinds = "error_type string, stage1_min_models int, stage1_max_models int, stage2_max_diff double"
    limits = spark.createDataFrame([("default", 1, 7, 0.3)], kinds)
    got = {r.sample_id: (r.split, r.rejection_stage) for r in curate.quality_filter(items, limits, 11).collect()}
    assert got == {"a": ("adopted", None), "b": ("rejected", 3), "c": ("rejected", None)}
    with pytest.raises(Exception, match="no limits for t"):
        curate.quality_filter(items, spark.createDataFrame([("u", 1, 7, 0.3)], kinds), 11).collect()


def pairs(spark):
    rows = [
        (0, "d", "a b c", "a b d"),
        (1, "d", "PARSE_FAILED", "a b"),
        (2, "d", "", ""),
        (3, "d", "CORRECT", "NA"),
        (4, "d", "NA", "real text"),
        (5, "d", "real text", ""),
    ]
    return spark.createDataFrame(rows, "ord bigint, dataset string, prediction string, reference string")


def test_correction_scores(spark):
    total = score.correction_metrics(pairs(spark), ["dataset"], "ord").first()
    # An unreadable answer is compared in the aggregate and scores nothing.
    assert (total.total_samples, total.error_samples, total.correct_na, total.incorrect_na) == (6, 2, 1, 1)
    assert total.rouge_1_f == pytest.approx((2 / 3) / 2)
    assert total.composite_avg == pytest.approx((2 / 3 + 1) / 6)
    assert total.no_error_accuracy == 0.5
    items = score.correction_per_item(pairs(spark), ["dataset"], "ord").collect()
    got = {r.ord: (r.na.is_na, round(r.composite, 4)) for r in items}
    # ROUGE-1 2/3, ROUGE-2 1/2, ROUGE-L 2/3
    assert got == {0: (False, 0.6111), 1: (True, 0), 2: (True, 1), 3: (True, 1), 4: (True, 0), 5: (True, 0)}


def test_extra_scorer_joins_the_means(spark):
    def load():
        return lambda preds, refs: [2.0 for _ in preds]

    scored = score.apply_pair_scorer(pairs(spark), load, "learned")
    total = score.correction_metrics(scored, ["dataset"], "ord", scorers=["learned"]).first()
    assert total.learned == 1.0
    assert total.average_score == pytest.approx((1 + 1 / 3) / 2)
    assert total.composite_avg == pytest.approx(((2 / 3 + 1) / 6 + (2 + 1) / 6) / 2)


def test_leaderboard_and_counts_of_empty_metrics(spark):
    rows = [("m", "sentence_extraction", "sentence_extraction_total_samples", 7.0)]
    df = spark.createDataFrame(rows, "model string, category string, metric string, value double")
    got = report.sample_counts(df, ["model"], F.lit(10)).first()
    assert (got.processed, got.attempted, got.delta) == (7, 7, -3)
    assert report.displayed_metrics(df).count() == 0


def test_latest_run_rules(spark):
    rows = [("m", s, t) for s, t in [("20240101_000000", 9), ("20240231_000000", 1), ("x_y", 2), ("zz", 3)]]
    df = spark.createDataFrame(rows, "model string, run_ts string, modified int")
    got = {r: responses.latest_run(df, ["model"], r).first().run_ts for r in ("stamp", "underscore", "name", "mtime")}
    assert got == {"stamp": "20240101_000000", "underscore": "x_y", "name": "zz", "mtime": "20240101_000000"}


def test_responder_failures_are_rows(spark):
    def load():
        def respond(rows):
            raise RuntimeError("down")

        return respond

    df = spark.createDataFrame([(1, "p"), (2, "q")], "ord bigint, prompt string")
    got = responses.apply_responder(df, load, ["ord"]).collect()
    assert {(r.ord, r.content, r.error) for r in got} == {(1, None, "down"), (2, None, "down")}


def test_a_bad_row_fails_alone(spark):
    def load():
        def respond(rows):
            if any(r["prompt"] == "bad" for r in rows):
                raise RuntimeError("down")
            return [{"content": "ok"} for r in rows if r["prompt"] != "lost"]

        return respond

    df = spark.createDataFrame([(1, "p"), (2, "bad"), (3, "lost"), (4, "q")], "ord bigint, prompt string")
    got = {r.ord: (r.content, r.error) for r in responses.apply_responder(df, load, ["ord"]).collect()}
    assert got == {1: ("ok", None), 2: (None, "down"), 3: (None, "0 answers to 1 prompts"), 4: ("ok", None)}


def test_a_responder_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda rows: [{"content": "ok"} for _ in rows]

    df = spark.range(0, 320, 1, 64).select(F.col("id").alias("ord"))
    assert responses.apply_responder(df, load, ["ord"]).where("content = 'ok'").count() == 320
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 64


def test_positions_of_samples_keep_other_columns(spark):
    rows = [(k, f"s{k % 3}", None if k == 4 else k / 10, "text" * k) for k in range(6)]
    df = spark.createDataFrame(rows, "ord bigint, sample_id string, detection double, text string")
    got = report.sort_samples(df, "error_detection_desc").orderBy("place").collect()
    assert [r.ord for r in got] == [5, 3, 2, 1, 4, 0] and [r.place for r in got] == list(range(6))
    assert all(r.text == "text" * r.ord for r in got)
    with pytest.raises(Exception, match="position used twice"):
        report.sort_samples(df.union(df)).collect()


def test_an_unknown_choice_has_no_position(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z")], "ord bigint, choice string")
    assert curate.record_position(df.where("ord = 1")).first().ord == 5
    with pytest.raises(Exception, match="unknown choice: z"):
        curate.record_position(df).collect()


def test_rounds_start_from_an_earlier_run(spark):
    def load():
        return lambda rows: [{"content": "new"} for _ in rows]

    df = spark.createDataFrame([("m", 1), ("m", 2), ("m", 3)], "model string, ord bigint")
    old = spark.createDataFrame(
        [("m", 1, "old", None, None), ("m", 2, "", None, "timeout")],
        "model string, ord bigint, content string, reasoning string, error string",
    )
    merged, used = responses.resume_rounds(spark, df, load, ["model"], 3, existing=old)
    assert used == 1 and {r.ord: r.content for r in merged.collect()} == {1: "old", 2: "new", 3: "new"}
    merged, used = responses.resume_rounds(spark, df, load, ["model"], 0, existing=old)
    assert used == 0 and merged.count() == 2


def test_a_repeated_position_is_an_error(spark):
    df = spark.createDataFrame([("q1_a_m0", 0), ("q1_a_m1", 0)], "sample_id string, ord bigint")
    with pytest.raises(Exception, match="position used twice"):
        curate.dedup_first(df).collect()


def test_rounds_stop_when_nothing_is_left(spark):
    def load():
        return lambda rows: [{"content": "ok"} for _ in rows]

    df = spark.createDataFrame([("m", 1), ("m", 2)], "model string, ord bigint")
    merged, used = responses.resume_rounds(spark, df, load, ["model"], 5)
    assert used == 1 and merged.count() == 2


def test_readers_of_files(spark, tmp_path):
    item = {k: None for k in ("error_type", "error_sentence_id", "error_sentence", "corrected_sentence")}
    item |= {"sample_id": "s", "sentences": "1. a\n2. {b}", "error_flag": 0, "metadata": {"x": [1]}}
    short = {k: v for k, v in item.items() if k != "error_type"}
    (tmp_path / "items.json").write_text(json.dumps([item, short], indent=2))
    got = readers.read_items(readers.read_containers(spark, f"{tmp_path}/items.json")).collect()
    assert [(r.ord, r.sample_id, r.sentences, r.is_complete) for r in got] == [
        (0, "s", "1. a\n2. {b}", True),
        (1, "s", "1. a\n2. {b}", False),
    ]
    assert json.loads(got[0].metadata) == {"x": [1]}
    run = tmp_path / "out" / "find" / "ja" / "m1" / "t1" / "20240101_000000"
    run.mkdir(parents=True)
    body = {"metadata": {"task": "find"}, "interactions": [{"sample_data": {"sample_id": "s"}, "raw_response": {"content": "c"}}, {"sample_id": "u"}]}
    (run / "raw.json").write_text(json.dumps(body, indent=1))
    files = readers.read_containers(spark, f"{run}/raw.json")
    rows = readers.read_responses(files).collect()
    assert [(r.interaction_index, r.sample_id, r.content) for r in rows] == [("001", "s", "c"), ("002", "u", None)]
    key = readers.run_catalog(files).first()
    assert (key.task, key.dataset, key.model, key.template, key.run_ts) == ("find", "ja", "m1", "t1", "20240101_000000")
    meta = readers.container_fields(files, "metadata struct<task: string>").first()
    assert meta.metadata.task == "find"


def test_split_write_and_json_rows(spark):
    path = scratch_path(spark, "test")
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "split string, n int, t string")
    writers.split_write(df, path)
    assert {(r.split, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
    writers.write_json_rows(df, f"{path}-json")
    assert {r.value for r in spark.read.text(f"{path}-json").collect()} == {
        '{"split":"a","n":1}',
        '{"split":"b","n":2,"t":"x"}',
    }


def test_stream_scores_new_files_once(spark):
    source, target, marks = (scratch_path(spark, n) for n in ("in", "out", "marks"))
    schema = "task string, dataset string, model string, template string, run_ts string, ord bigint, sample_id string, error_flag int, error_sentence_id int, corrected_sentence string, content string"
    for i in range(2):
        row = ("t", "d", "m", "x", "r", i, f"s{i}", 1, 3, "c", "3: c")
        spark.createDataFrame([row], schema).write.mode("append").parquet(source)
        for _ in range(2):
            score_stream(spark, source, target, marks).awaitTermination()
        got = spark.read.parquet(target).collect()
        assert sorted(r.ord for r in got) == list(range(i + 1))
        assert all(r.is_correct and r.is_exact_match and r.ec_pred == "c" for r in got)
