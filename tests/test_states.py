"""Accuracy states of parts against the accuracies of the whole."""

import random

import pytest

from textbench.operators import curate, states
from textbench.session import scratch_path

SCHEMA = "sample_id string, model string, template string, error_flag int, error_sentence_id int, ed_pred int, se_pred bigint"
COLUMNS = ["sample_id", "models", "complete_models", "detection_models", "complete_accuracy", "detection_accuracy"]


def table(spark, models, rows=1500, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        flag, has = rng.randint(0, 1), rng.choice([1, 2, None])
        name = rng.choice([None, *[f"m{k}" for k in range(models)]])
        out.append((rng.choice(["a", "b", "c", None]), name, "t", flag, has if flag else None, rng.choice([0, 1, -1, None]), rng.randint(0, 2)))
    return spark.createDataFrame(out, SCHEMA)


def rows(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=repr)


@pytest.mark.parametrize("models", [3, 63, 64, 150])
def test_merged_parts_equal_the_whole(spark, models):
    preds = table(spark, models).cache()
    numbers = states.number_models(preds)
    parts = [preds.where(f"pmod(hash(*), 3) = {k}") for k in range(3)]
    merged = states.merge_states([states.accuracy_state(p, numbers) for p in parts])
    assert rows(states.accuracies_of(merged)) == rows(curate.item_accuracy(preds))
    twice = states.merge_states([merged, states.accuracy_state(parts[0], numbers)])
    assert rows(states.accuracies_of(twice)) == rows(curate.item_accuracy(preds))


def test_runs_are_added_without_reading_old_predictions(spark):
    path = scratch_path(spark, "states")
    old, new = table(spark, 5, 300, 2), table(spark, 70, 300, 3)
    states.add_run(old, path, "r1")
    assert rows(states.current_accuracies(spark, path)) == rows(curate.item_accuracy(old))
    for _ in range(2):
        states.add_run(new, path, "r2")
        assert rows(states.current_accuracies(spark, path)) == rows(curate.item_accuracy(old.union(new)))
    # A run that is written again with other rows is replaced.
    states.add_run(new, path, "r1")
    assert rows(states.current_accuracies(spark, path)) == rows(curate.item_accuracy(new))


def test_no_predictions(spark):
    none = table(spark, 2, 1).limit(0)
    assert states.accuracies_of(states.accuracy_state(none, states.number_models(none))).count() == 0
