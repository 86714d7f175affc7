"""The stateful stream against merging and scoring all answers at once."""

import random

from pyspark.sql import functions as F

from textbench.functions.answers import parse_answers
from textbench.operators import responses, score
from textbench.session import scratch_path
from textbench.streaming import metrics

BY = ["model", "template"]
SCHEMA = "model string, template string, run_ts string, ord bigint, error_flag int, content string"


def _rows(df):
    return sorted([tuple(r) for r in df.select(*BY, "tp", "fp", "tn", "fn", "n", "accuracy", "f1").collect()], key=repr)


def test_every_batch_equals_the_batch_job(spark, monkeypatch):
    rng = random.Random(4)
    source, target, marks = (scratch_path(spark, n) for n in ("in", "out", "marks"))
    merged = None
    for turn in range(4):
        rows = [
            (m, t, f"20240101_00000{turn}", o, o % 2, rng.choice(["CORRECT", "3: text", "CORRECT", "", "nonsense"]))
            for m in ("a", None)
            for t in ("x", "y")
            for o in rng.sample([*range(40), 4095, 4096, 10_000, 2**40], 20)
        ]
        arrived = spark.createDataFrame(rows, SCHEMA)
        arrived.repartition(2).write.mode("append").parquet(source)
        # Each call is a restart from the checkpoint; the second finds nothing new.
        for _ in range(2):
            metrics.metrics_stream(spark, source, target, marks, BY, SCHEMA).awaitTermination()
        values = arrived.drop("run_ts")
        merged = values if merged is None else responses.merge_responses(merged, values, BY)
        want = score.detection_metrics(parse_answers(merged), BY)
        assert _rows(metrics.current_metrics(spark, target, BY)) == _rows(want)
    assert [r.batch for r in spark.read.parquet(target).select("batch").distinct().orderBy("batch").collect()] == [0, 1, 2, 3]


def test_an_older_turn_does_not_replace_a_newer_one(spark):
    source, target, marks = (scratch_path(spark, n) for n in ("in", "out", "marks"))
    for stamp, content in (("20240103_000000", "CORRECT"), ("20240101_000000", "2: x"), (None, "2: x")):
        row = ("a", "x", stamp, 7, 0, content)
        spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(source)
        metrics.metrics_stream(spark, source, target, marks, BY, SCHEMA).awaitTermination()
        got = metrics.current_metrics(spark, target, BY).first()
        assert (got.tn, got.fp, got.n) == (1, 0, 1)
    first = metrics.current_metrics(spark, target, BY, up_to=0).where(F.col("tn") == 1)
    assert first.count() == 1
