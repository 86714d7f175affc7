"""Sinks that are repeated, fail half-way, or are written by two jobs."""

import pytest
from pyspark.sql import functions as F

from textbench.session import scratch_path
from textbench.sources import commits, writers

BY = ["model", "run_ts"]


def frames(spark, mark, models=("7", None, "a/b")):
    samples = spark.createDataFrame(
        [(m, "20240101_000000", i, mark) for m in models for i in range(3)], "model string, run_ts string, ord int, mark string"
    )
    metrics = samples.groupBy(*BY).agg(F.count("*").alias("n"), F.max("mark").alias("mark"))
    return samples, metrics


def seen(spark, path, table):
    return sorted([tuple(r) for r in commits.read_committed(spark, path, table).select("model", "mark").collect()], key=repr)


def test_a_repeated_write_leaves_each_row_once(spark):
    path = scratch_path(spark, "sink")
    samples, metrics = frames(spark, "x")
    for name in ("job", "job", None):
        writers.write_predictions(samples, metrics, path, BY, commit=name)
    assert seen(spark, path, "samples") == sorted([(m, "x") for m in ("7", None, "a/b")] * 3, key=repr)
    assert len(seen(spark, path, "metrics")) == 3
    assert dict(commits.read_committed(spark, path, "samples").dtypes)["model"] == "string"
    assert len(commits.committed(spark, path)) == 2


def test_a_failure_between_the_tables_leaves_nothing(spark, monkeypatch):
    path = scratch_path(spark, "sink")
    samples, metrics = frames(spark, "old", ["m"])
    writers.write_predictions(samples, metrics, path, BY)
    broken = metrics.withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        writers.write_predictions(frames(spark, "new", ["m"])[0], broken, path, BY, commit="job")
    assert seen(spark, path, "samples") == [("m", "old")] * 3
    # The repetition replaces the run, and the rows of the failed attempt stay out of sight.
    writers.write_predictions(*frames(spark, "new", ["m"]), path, BY, commit="job")
    assert seen(spark, path, "samples") == [("m", "new")] * 3 and seen(spark, path, "metrics") == [("m", "new")]
    gone = commits.vacuum(spark, path, ["samples", "metrics"])
    assert len(gone) == 3
    assert seen(spark, path, "samples") == [("m", "new")] * 3
    assert {r.mark for r in spark.read.parquet(f"{path}/samples").collect()} == {"new"}


def test_replacing_and_adding_by_key(spark):
    path = scratch_path(spark, "sink")
    for mark, models, replace in (("1", "ab", True), ("2", "b", True), ("3", "bc", False), ("4", "c", False)):
        commits.commit_tables({"samples": frames(spark, mark, list(models))[0]}, path, BY, replace=replace)
    want = [("a", "1")] * 3 + [("b", "2")] * 3 + [("b", "3")] * 3 + [("c", "3")] * 3 + [("c", "4")] * 3
    assert seen(spark, path, "samples") == want


def test_the_slower_of_two_attempts_is_dropped(spark, monkeypatch):
    path = scratch_path(spark, "sink")
    samples = frames(spark, "first", ["m"])[0]
    commits.commit_tables({"samples": samples}, path, BY, commit="job")
    # The second attempt looked before the first was done.
    monkeypatch.setattr(commits._Folder, "exists", lambda self, name: False if name.endswith("job") else True)
    commits.commit_tables({"samples": frames(spark, "second", ["m"])[0]}, path, BY, commit="job")
    monkeypatch.undo()
    assert seen(spark, path, "samples") == [("m", "first")] * 3


def test_other_runs_are_not_read(spark):
    path = scratch_path(spark, "sink")
    for mark in ("old", "new"):
        commits.commit_tables({"samples": frames(spark, mark, ["m", "n"])[0]}, path, BY)
    read = commits.read_committed(spark, path, "samples")
    assert {r.mark for r in read.collect()} == {"new"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "commit" in kept and kept.count("~") == 1


def test_nothing_committed(spark):
    with pytest.raises(ValueError, match="nothing is committed"):
        commits.read_committed(spark, scratch_path(spark, "sink"), "samples")


def test_split_write_twice(spark):
    path = scratch_path(spark, "sink")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "split string, n int")
    writers.split_write(rows, path)
    writers.split_write(rows, path)
    writers.split_write(rows.where("split = 'a'").withColumn("n", F.lit(5)), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("split", "n").collect()) == [("a", 5), ("b", 2)]
