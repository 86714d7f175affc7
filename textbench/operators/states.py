"""Item accuracies that follow new runs without reading old predictions.

"How many different models solve an item" is no sum: a model may answer an item in many runs and
templates. A state keeps the models themselves, as bits of 64-bit words per item:
who answered, who solved it whole, who saw whether there is an error. States of any parts merge by
OR, the counts are those of the bits, and an item has one row per 64 models.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textbench.operators.curate import accuracy_rates, answer_correctness
from textbench.sources.commits import commit_tables, committed, read_committed

MARKS = ("models", "complete_models", "detection_models")


def number_models(preds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(model, number): `known` numbers stay, new models follow them by name.

    A row per model; null is a model, too.
    """
    models = preds.select("model").distinct()
    if known is None:
        known = models.limit(0).withColumn("number", F.lit(0).cast("long"))
    same = F.col("m.model").eqNullSafe(F.col("k.model"))
    new = models.alias("m").join(known.alias("k"), same, "left_anti")
    first = known.agg(F.coalesce(F.max("number") + 1, F.lit(0).cast("long"))).first()[0]
    # As many rows as there are new models.
    rank = F.row_number().over(Window.orderBy(F.col("model").asc_nulls_first())) - 1
    return known.select("model", "number").unionByName(new.select("model", (rank + first).cast("long").alias("number")))


def accuracy_state(preds: DataFrame, numbers: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(by…, word, models, complete_models, detection_models): bits of the models of each item."""
    told = answer_correctness(preds).select(*by, "model", "complete", "detected")
    met = told.alias("t").join(numbers.alias("n"), F.col("t.model").eqNullSafe(F.col("n.model")))
    bit = F.expr("shiftleft(1L, CAST(n.number % 64 AS INT))")
    marks = dict(zip(MARKS, (F.lit(True), F.col("t.complete"), F.col("t.detected"))))
    return met.groupBy(*[F.col(f"t.{k}").alias(k) for k in by], F.floor(F.col("n.number") / 64).alias("word")).agg(
        *[F.bit_or(F.when(held, bit).otherwise(F.lit(0).cast("long"))).alias(name) for name, held in marks.items()]
    )


def merge_states(states: Sequence[DataFrame], by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """One state of the rows of all; a model that is in several of them counts once."""
    every = reduce(DataFrame.unionByName, [s.select(*by, "word", *MARKS) for s in states])
    return every.groupBy(*by, "word").agg(*[F.bit_or(m).alias(m) for m in MARKS])


def accuracies_of(state: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """`item_accuracy` of the predictions that the state has seen."""
    counts = state.groupBy(*by).agg(*[F.sum(F.bit_count(m)).alias(m) for m in MARKS])
    return accuracy_rates(counts)


def add_run(preds: DataFrame, path: str, run: str, by: Sequence[str] = ("sample_id",)) -> str:
    """Keep the state of a run's predictions below `path`; the same run again replaces it.

    One writer at a time: numbers of new models follow those that are committed.
    """
    spark = preds.sparkSession
    known = None
    if committed(spark, path):
        kept = read_committed(spark, path, "models").select("model", "number")
        known = kept.groupBy("model").agg(F.min("number").alias("number"))
    numbers = number_models(preds, known)
    named = {"run": F.lit(run)}
    tables = {"models": numbers.withColumns(named), "state": accuracy_state(preds, numbers, by).withColumns(named)}
    return commit_tables(tables, path, ["run"])


def current_accuracies(spark: SparkSession, path: str, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Accuracies over all runs that were added."""
    return accuracies_of(merge_states([read_committed(spark, path, "state")], by), by)
